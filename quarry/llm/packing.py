"""Best-fit packing planned on the histogram of lengths.

Documents longer than a sequence are cut into whole sequences, the remainder first. The plan is made on counts: best-fit
decreasing places all pieces of a length at once into open sequences grouped by the room they have left, so the plan has
at most one group for each room and its size depends on the sequence length, not on the documents. Pieces are ranked
within their length (by sums over hash buckets, so a length that holds a third of all rows is no single task) and take
the planned slot of that length and rank.

Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import hash_bucket, lean_batches, lean_worker, materialise, running, small, spread

SEQUENCE = 2048
#: Of a lean packing: bytes of a worker's cache, MB of its batches.
LEAN_CACHE, LEAN_BATCH = 24 << 20, 4


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Runs of slots (length, rank, n, sequence, offset): pieces rank..rank+n-1 of a length go to n sequences from sequence on.

    Lengths are taken from the longest; pieces of a length go to the open sequences with the least sufficient room, then
    to new ones (several to a sequence while it has room). A group of sequences is a list of runs of numbers.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first sequence, how many)
    out, opened = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, size) if rooms.get(r)), None)
            if room is None:  # new sequences: as many as hold the rest, filled to the brim but for the last
                each = size // length
                new = -(-left // each)
                runs, room, opened = [(opened, new)], size, opened + new
            else:
                runs = rooms.pop(room)
            back = []
            for first, n in runs:
                use = min(n, left)
                if use:
                    out.append((length, rank, use, first, size - room))
                    rooms[room - length].append((first, use))
                    rank, left = rank + use, left - use
                if use < n:
                    back.append((first + use, n - use))
            if back:
                rooms[room] += back
    return [x for x in out if x[2]]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, size: int = SEQUENCE, ids: bool = False, lean: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32; with ids, also the piece's ids.

    lean: workers hold less beside an executor whose heap has grown, and give back encoder and cache at a task's end; the rows are the same.
    """
    tokenizer = tokenizer or default_path()
    lean_batches(docs.sparkSession, *([LEAN_BATCH] if lean else []))

    def rows(batches):
        lean_worker(keep_encoders=True)
        enc = encoder(tokenizer, LEAN_CACHE if lean else None)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            out = []
            for i, found in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                all_ids = np.frombuffer(found + end, enc.kind)
                cuts = [0, *range(len(all_ids) % size or size, len(all_ids) + 1, size)] if len(all_ids) > size else [0, len(all_ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = all_ids[a:b].astype("<u4")
                    out.append((i, k, a, b - a, zlib.crc32(part.tobytes()), *([part] if ids else [])))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))
            if lean:
                del batch, out, columns
                lean_worker(keep_encoders=True)
        if lean:
            enc = None
            lean_worker()

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if ids else {})
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows_in.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def place(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """parts (stored; with doc_id, piece, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = Counter({r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()})  # one row a length
    runs = plan(counts, size)
    total = sum(counts.values())
    frame = pd.DataFrame(runs, columns=["length", "rank", "n", "sequence", "offset"], dtype="int64")
    table = spark.createDataFrame(frame, "length long, rank long, n long, sequence long, offset long")
    step = 1 << 16  # a run of any length is dealt out in steps of so many slots
    wide = table.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)"))).repartition("length", "from")
    slots = wide.withColumn("k", F.explode(F.expr(f"sequence(from, least(from + {step - 1}, n - 1))")))
    slots = slots.select("length", (F.col("rank") + F.col("k")).alias("rank"), (F.col("sequence") + F.col("k")).alias("sequence_id"), "offset")
    keyed = parts.withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_bucket", hash_bucket(F.col("_h"), spread(total)))
    ranked = running(keyed, ["length"], "_bucket", ["_h", "doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    return ranked.join(slots, ["length", "rank"]).drop("_h", "_bucket", "rank")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, size: int = SEQUENCE, lean: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = materialise(pieces(docs, id_col, text, tokenizer, end_id, size, lean=lean), "pieces")
    return place(parts, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """One row a sequence: sequence_id, ids (at most size of them), doc_ids of its pieces in order."""
    parts = materialise(pieces(docs, id_col, text, tokenizer, end_id, size, ids=True), "pieces")
    each = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = place(parts, size).groupBy("sequence_id").agg(each.alias("p"))  # a sequence holds size ids at most
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op8_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
