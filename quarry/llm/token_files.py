"""Token-ID files of patched frame-of-reference blocks.

A segment holds whole documents: a header, the documents' ids and places, the index of block starts, and blocks of 256
token ids. A block stores its minimum, the differences packed at the width that 90 % of them need, and the rest, with
their places, in an exception list. Segments are rows of a Parquet table written by Spark's committer (shard and part
give their order), so lost executors leave nothing half-written and any store that Spark knows will do.

Null and empty texts have the end id alone; repeated rows are written each; texts of any length are whole; an empty
table makes files without documents. Null doc_ids come first. Only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import fresh_path, lean_batches, running, small

MAGIC = b"PFR1"
BLOCK = 256
#: Share of a block's differences that the packed width must hold.
PERCENTILE = 0.9
#: A segment is closed once it has this many ids.
SEGMENT_IDS = 1 << 19
_HEAD = struct.Struct("<4sIIII")
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<u4"), ("n", "<u4")])
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed by each value; at least 1."""
    return np.maximum(1, np.ceil(np.log2(x.astype(np.float64) + 1))).astype(np.int64)


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """(rows, BLOCK) values below 2^w as (rows, w * BLOCK / 8) bytes: their bits one after another, the lowest first."""
    # 64 values of a width of w fill w words of 64 bits.
    by_place = np.ascontiguousarray(values.reshape(-1, 64).T, dtype=np.uint64)
    words = np.zeros((w, by_place.shape[1]), np.uint64)
    for i in range(64):
        at, shift = divmod(i * w, 64)
        words[at] |= by_place[i] << np.uint64(shift)
        if shift + w > 64:
            words[at + 1] |= by_place[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8).reshape(len(values), -1)


def _unpacked(packed: np.ndarray, w: int) -> np.ndarray:
    """(rows, BLOCK): what _packed took."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, w).T)
    out, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << w) - 1)
    for i in range(64):
        at, shift = divmod(i * w, 64)
        value = words[at] >> np.uint64(shift)
        if shift + w > 64:
            value |= words[at + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return out.T.reshape(len(packed), BLOCK)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of an array of ids below 2^32, and the index: where each starts and the last ends."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(1, "<u4")
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    k = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(rest.astype(np.uint16) if rest.max() < 1 << 16 else rest, k, axis=1)[:, k])
    # An exception list counts its entries in a byte: at most a tenth of a block, so it always can.
    most = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    row, place = np.nonzero(rest > most[:, None])
    exceptions = np.bincount(row, minlength=blocks)
    size = _BLOCK_HEAD.itemsize + width * (BLOCK // 8) + exceptions * 5
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    head = np.zeros(blocks, _BLOCK_HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, exceptions
    out[at[:-1, None] + np.arange(_BLOCK_HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, -1)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = _packed(rest[rows] & np.uint32((1 << w) - 1), w)
        for r, a in enumerate((at[rows] + _BLOCK_HEAD.itemsize).tolist()):
            out[a : a + packed.shape[1]] = packed[r]
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        base = at[row] + _BLOCK_HEAD.itemsize + width[row] * (BLOCK // 8)
        out[base + nth] = place
        values = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), at.astype("<u4")


def unpack(data: bytes, index: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default), through the index of block starts; n: ids in all blocks."""
    last = len(index) - 1 if last is None else last
    raw, at = np.frombuffer(data, np.uint8), index[first : last + 1].astype(np.int64)
    blocks = last - first
    if blocks <= 0:
        return np.zeros(0, np.uint32)
    head = raw[at[:-1, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    rest = np.empty((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows, size = np.flatnonzero(width == w), w * BLOCK // 8
        packed = np.empty((len(rows), size), np.uint8)
        for r, a in enumerate((at[rows] + _BLOCK_HEAD.itemsize).tolist()):
            packed[r] = raw[a : a + size]
        rest[rows] = _unpacked(packed, w)
    row = np.repeat(np.arange(blocks), exceptions)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        base = at[row] + _BLOCK_HEAD.itemsize + width[row] * (BLOCK // 8)
        values = raw[(base + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        rest[row, raw[base + nth]] = values
    rest += head["low"][:, None]
    return rest.reshape(-1)[: n - first * BLOCK]


def segment(docs: list[tuple[int | None, bytes]], kind: np.dtype) -> bytes:
    """A segment's bytes from (doc_id, ids) in order."""
    table = np.zeros(len(docs), _DOC)
    sizes = np.array([len(b) // kind.itemsize for _, b in docs], np.int64)
    table["doc_id"] = [0 if i is None else i for i, _ in docs]
    table["known"] = [i is not None for i, _ in docs]
    table["n"], table["start"] = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(docs) else 0
    blocks, index = pack(np.frombuffer(b"".join(b for _, b in docs), kind))
    return _HEAD.pack(MAGIC, len(docs), int(sizes.sum()), len(index) - 1, BLOCK) + table.tobytes() + index.tobytes() + blocks


class Segment:
    """Reads a segment; ids(k) decodes only the blocks that hold document k."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n, blocks, size = _HEAD.unpack_from(data)
        if magic != MAGIC or size != BLOCK:
            raise ValueError("not a segment of this format")
        at = _HEAD.size
        self.docs = np.frombuffer(data, _DOC, n_docs, at)
        at += n_docs * _DOC.itemsize
        self.index = np.frombuffer(data, "<u4", blocks + 1, at)
        self.data = memoryview(data)[at + 4 * (blocks + 1) :]

    def all_ids(self) -> np.ndarray:
        return unpack(self.data, self.index, self.n)

    def ids(self, k: int) -> np.ndarray:
        start, n = int(self.docs["start"][k]), int(self.docs["n"][k])
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        return unpack(self.data, self.index, self.n, first, last)[start - first * BLOCK :][:n]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs and write their segments under path in ascending id order, end_id after each document."""
    tokenizer = tokenizer or default_path()
    lean_batches(docs.sparkSession)

    def rows(batches):
        from pyspark import TaskContext

        shard, part, held, waiting = TaskContext.get().partitionId(), 0, 0, []
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()

        def closed():
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "n_docs": [len(waiting)], "n_ids": [held // enc.kind.itemsize], "payload": [segment(waiting, enc.kind)]})

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                waiting.append((i, ids + end))
                held += len(waiting[-1][1])
                if held >= segment_ids * enc.kind.itemsize:
                    yield closed()
                    part, held, waiting = part + 1, 0, []
        if waiting:
            yield closed()

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows of one id (or none) are told apart by their text and place, so that many of them are no single task.
    keyed = rows_in.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h", "_row").select("doc_id", "text")
    ordered.mapInArrow(rows, "shard long, part long, n_docs long, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array of the document's ids), from the files."""
    return _read(spark, path, "ids array<long>", lambda ids: ids.tolist())


def read_crc(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4", copy=False).tobytes()))


def _read(spark: SparkSession, path: str, field: str, of) -> DataFrame:
    files = spark.read.schema("shard long, part long, n_docs long, n_ids long, payload binary").parquet(path)
    parts = files.select("shard", "part", "n_ids").withColumn("all", F.lit(0))
    n = parts.count()
    base = running(parts, ["all"], "shard", ["part"], F.col("n_ids"), "base").select("shard", "part", "base")
    name = field.split()[0]
    lean_batches(spark)

    def rows(batches):
        for batch in batches:
            for shard, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seg = Segment(data)
                ids, docs = seg.all_ids(), seg.docs
                ends = docs["start"].astype(np.int64) + docs["n"]
                yield pa.RecordBatch.from_pydict({
                    "shard": np.full(len(docs), shard, np.int64), "part": np.full(len(docs), part, np.int64), "doc_id": pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0),
                    "at": docs["start"].astype(np.int64), "n_tokens": docs["n"].astype(np.int64), name: [of(ids[a:b]) for a, b in zip(docs["start"].tolist(), ends.tolist(), strict=True)],
                })

    found = files.select("shard", "part", "payload").mapInArrow(rows, f"shard long, part long, doc_id long, at long, n_tokens long, {field}")
    return found.join(small(base, n), ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", name)


def op6_token_files(spark, sf_dir):
    path = fresh_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_crc(spark, path)
