"""LM scoring by a gated recurrent language model with class-factored outputs, in numpy (see gated.py).

Counts of all tokens come from all training documents. Frequent words, more of them the larger the vocabulary is, have
classes of their own, cut by frequency; every other word falls into a class by its spelling. Within a class of rare words
a word has its smoothed count's share, with one share for all words never seen, so the probabilities of all tokens sum to
one. The recurrent weights start at the unigram model and are trained by truncated backpropagation on every training
document, each in one round, in replicas over equal blocks of documents whose weights are averaged after each round.
Scoring runs whole documents, carrying the state from window to window.

Texts are read and split once: a task cuts its documents into blocks of bounded size and keeps, for each block, its
distinct words and its documents as places among them. Counts come back to a block by place, and turn its documents into
codes, which training and scoring read. Nothing that grows with the vocabulary is broadcast or held by one task, but the
list of frequent words, which grows with a power of it (0.56).

Null and empty texts are the end token alone. Rows without an id train and score as any other; repeated rows each count.
An empty table gives no rows; without training documents all counts are 0 and the model is the untrained one. Only the
named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gated
from .common import discard, lean_batches, materialise

#: Every training document trains the recurrent weights in one of so many rounds, its block's.
ROUNDS = 2
#: Bytes of text in a block, at least, unless its task has no more; a block holds whole documents.
BLOCK_BYTES = 8_000_000
SPELLINGS = 27
#: Side * side frequent words: side is this power of the number of distinct tokens, and so much at least.
SIDE_POWER, LEAST_SIDE = 0.28, 8
#: Vectors of weights that one task adds up.
FAN_IN = 16
#: A long text is split into words in stretches of about so many bytes.
_STRETCH = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SMALL_ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1000"}


def tokens(text: bytes):
    """Lists of the text's words, A-Z in lower case, by stretches; the end token is not among them."""
    if len(text) <= 2 * _STRETCH:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _STRETCH)
        end = gap.end() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


_KIND = np.array([0 if k >= 128 or chr(k).isalnum() else 1 if chr(k) in ".!?" else 2 for k in range(256)], np.uint8)


def spellings(words: pa.Array) -> np.ndarray:
    """The class of each rare word, from 0: its first letter beyond ASCII, and how it ends."""
    if not len(words):
        return np.zeros(0, np.uint8)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    lead = np.append(np.flatnonzero(data >= 0xC0), len(data))
    first = lead[np.searchsorted(lead, starts)]
    letter = np.where(first < ends, 1 + data[np.minimum(first + 1, ends - 1)] % 8, 0)
    return (3 * letter + _KIND[data[ends - 1]]).astype(np.uint8)


class _Places(dict):
    """Words by the order of their first appearance."""

    def __missing__(self, word):
        place = self[word] = len(self)
        return place


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each by the first, second, ... bytes of its items: small numbers take little room."""
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    raw = b"".join([np.array([len(arrays), *map(len, parts)], np.int64).tobytes(), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(width, -1).T).view(kind).reshape(-1))
        at += size
    return out


#: A block's documents: ids, whether known, whether held out, words; then each word's spelling and the documents' places.
_LISTED = "block long, at int, word binary, n long, docs binary"
_DOCS = (np.int64, np.bool_, np.bool_, np.int64, np.uint8, np.int32)


def _listed(batches):
    """Rows of _LISTED: for each block its words with their training counts, then its documents."""
    from pyspark import TaskContext

    part, block = TaskContext.get().partitionId(), 0
    none = lambda kind, n: pa.nulls(n, kind)
    places, ids, known, held, runs, lengths, size = _Places(), [], [], [], [], [], 0

    def closed():
        number = pa.scalar((part << 32) + block, pa.int64())
        words, flat = pa.array(list(places), pa.binary()), np.concatenate(runs) if runs else np.zeros(0, np.int32)
        n = np.array(lengths, np.int64)
        counts = np.bincount(flat[np.repeat(~np.array(held, bool), n)], minlength=len(places)).astype(np.int64)
        for a in range(0, len(words), 1 << 16):
            some = words[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.repeat(number, len(some)), pa.array(np.arange(a, a + len(some), dtype=np.int32)), some, pa.array(counts[a : a + len(some)]), none(pa.binary(), len(some))], names=["block", "at", "word", "n", "docs"])
        docs = _pack(np.array(ids, np.int64), np.array(known, bool), np.array(held, bool), n, spellings(words), flat)
        yield pa.RecordBatch.from_arrays([pa.repeat(number, 1), none(pa.int32(), 1), none(pa.binary(), 1), none(pa.int64(), 1), pa.array([docs], pa.binary())], names=["block", "at", "word", "n", "docs"])

    for batch in batches:
        for i, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            mine = [np.fromiter(map(places.__getitem__, words), np.int32, len(words)) for words in tokens(text)]
            runs += mine
            ids.append(0 if i is None else i)
            known.append(i is not None)
            held.append(out)
            lengths.append(sum(map(len, mine)))
            size += len(text) + 1
            if size >= BLOCK_BYTES:
                yield from closed()
                block += 1
                places, ids, known, held, runs, lengths, size = _Places(), [], [], [], [], [], 0
    if ids:
        yield from closed()


class Vocabulary:
    """Frequent words by rank, the rest by spelling; counts of the training tokens."""

    def __init__(self, side: int, counts: list[int], shares: np.ndarray, n: int, v: int, ends: int):
        self.codes = gated.Codes(side, SPELLINGS)
        #: Counts of the frequent words, by rank.
        self.counts = np.array(counts + [0] * (self.codes.words - len(counts)), np.float64)
        #: By spelling: the sum of count + 0.5 over its rare words, and 0.5 for the never seen.
        self.shares = np.maximum(shares, 0.0) + 0.5
        self.n, self.v, self.ends = n, v, ends

    def initial(self) -> np.ndarray:
        return gated.initial(self.codes, self.counts, np.append(self.shares, self.ends + 0.5))


def vocabulary(counts: DataFrame, ends: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of counts (word, c), and its frequent words: word, rank."""

    def by_spelling(batches):
        for batch in batches:
            kind, c = spellings(batch.column(0)), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SPELLINGS, dtype=np.int32)), pa.array(np.bincount(kind, c, SPELLINGS).astype(np.int64)), pa.array(np.bincount(kind, minlength=SPELLINGS).astype(np.int64))], names=["kind", "n", "v"])

    seen = counts.filter("c > 0").select("word", "c")
    sums = seen.mapInArrow(by_spelling, "kind int, n long, v long").groupBy("kind").agg(F.sum("n"), F.sum("v")).collect()  # a row a spelling
    shares, n, v = np.zeros(SPELLINGS), ends, int(ends > 0)
    for kind, words_n, words_v in sums:
        shares[kind], n, v = words_n + 0.5 * words_v, n + words_n, v + words_v
    side = max(LEAST_SIDE, round(v**SIDE_POWER))
    frequent = [(bytes(r.word), r.c) for r in seen.orderBy(F.desc("c"), "word").limit(side * side).collect()]
    if frequent:
        np.subtract.at(shares, spellings(pa.array([w for w, _ in frequent], pa.binary())), np.array([c + 0.5 for _, c in frequent]))
    ranks = counts.sparkSession.createDataFrame([(bytearray(w), k) for k, (w, _) in enumerate(frequent)], "word binary, rank int")
    return Vocabulary(side, [c for _, c in frequent], shares, n, v, ends), ranks


_CODED = "block long, round int, codes binary, docs binary"
_SCORED = (np.int64, np.bool_, np.bool_, np.int64, np.int64, np.float64, np.float64)


def _coder(vocab: Vocabulary):
    """Turns a block's documents and the counts of its words into codes and what the counts alone say of each document."""
    codes, log_shares = vocab.codes, np.log(vocab.shares)
    scale = np.log10(vocab.n + 0.5 * (vocab.v + 1)) if vocab.n else 0.0

    def coded(listed: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for row in listed.select(["number", "docs"]).to_batches():
            for number, docs in zip(*(row.column(k).to_pylist() for k in range(2)), strict=True):
                ids, has_id, held, lengths, kinds, flat = _unpack(docs, *_DOCS)
                c = np.append(np.bincount(flat[np.repeat(~held, lengths)], minlength=len(kinds)), vocab.ends).astype(np.float64)
                code = np.append(codes.words + codes.side + kinds.astype(np.int32), np.int32(codes.end))
                at, rank = known.column("at").to_numpy(), known.column("rank").to_numpy()
                c[at] = known.column("c").to_numpy()
                ranked = rank >= 0
                code[at[ranked]] = rank[ranked]
                end = len(kinds)
                # The end follows each document's words.
                runs = np.insert(flat, np.cumsum(lengths), np.int32(end))
                lengths = lengths + 1
                firsts = np.cumsum(lengths) - lengths
                rare = np.zeros(len(c))
                spelt = (code >= codes.words) & (code < codes.end)
                rare[spelt] = np.log(c[spelt] + 0.5) - log_shares[code[spelt] - codes.words - codes.side]
                total = lambda x: np.add.reduceat(x[runs], firsts)
                of_counts = total(np.log10(c + 0.5)) - lengths * scale
                docs = _pack(ids, has_id, held, lengths, total((c > 0).astype(np.int64)), of_counts, total(rare))
                out.append((number, (number + (number >> 32)) % ROUNDS, _pack(code[runs].astype(np.uint16 if codes.inputs <= 1 << 16 else np.int32)), docs))
        return pa.table({k: pa.array([x[j] for x in out], kind) for j, (k, kind) in enumerate((("block", pa.int64()), ("round", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())))})

    return coded


def _block_codes(vocab: Vocabulary, data) -> np.ndarray:
    return _unpack(data, np.uint16 if vocab.codes.inputs <= 1 << 16 else np.int32)[0].astype(np.int32)


def _fitted(coded: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Weights after rounds of replicas, one a block of coded documents, averaged by the number of their tokens."""
    vector = vocab.initial()

    def trained(start: np.ndarray, rate: float):
        def replicas(batches):
            total, weight, number = np.zeros(len(start)), 0.0, 0
            for batch in batches:
                for block, data, docs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    tokens, (_, _, held, lengths, *_) = _block_codes(vocab, data), _unpack(docs, *_SCORED)
                    mine = tokens[np.repeat(~held, lengths)]
                    if len(mine):
                        total += len(mine) * gated.train(start, vocab.codes, mine, lengths[~held], rate).astype(np.float64)
                        weight, number = weight + len(mine), block
            if weight:
                yield pa.RecordBatch.from_pydict({"number": [number], "weight": [weight], "total": [total.tobytes()]})

        return replicas

    def added(batches):
        total, weight, number = 0.0, 0.0, 0
        for batch in batches:
            for number, w, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total, weight = total + np.frombuffer(data), weight + w
        if weight:
            yield pa.RecordBatch.from_pydict({"number": [number], "weight": [weight], "total": [total.tobytes()]})

    out = "number long, weight double, total binary"
    for k in range(ROUNDS):
        sums = materialise(coded.filter(F.col("round") == k).select("block", "codes", "docs").mapInArrow(trained(vector, 0.04 / (k + 1)), out), "weights")
        parts = sums.count()
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            before, sums = sums, materialise(sums.repartition(parts, F.xxhash64("number")).sortWithinPartitions("number").mapInArrow(added, out), "weights")
            discard(before)
        got = sums.orderBy("number").collect()  # at most FAN_IN vectors
        discard(sums)
        weight = sum(r.weight for r in got)
        if weight:
            vector = (sum(np.frombuffer(r.total) for r in got) / weight).astype(np.float32)
    return vector


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    held_out: a Column over doc_id; documents for which it isn't true are learnt from.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a small input in few files
        rows = rows.repartition(tasks, F.xxhash64("doc_id", "text"))
    listed = materialise(rows.mapInArrow(_listed, _LISTED), "blocks", _SMALL_ROW_GROUPS)
    words, blocks = listed.filter("at is not null").select("block", "at", "word", "n"), listed.filter("at is null").select(F.col("block").alias("number"), "docs")

    def ends_of(batches):
        for batch in batches:
            n = [int((~_unpack(docs, *_DOCS)[2]).sum()) for docs in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(n)], pa.int64())})

    ends = blocks.select("docs").mapInArrow(ends_of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "counts")
    vocab, ranks = vocabulary(counts, ends)
    # Words of one block alone have that block's own counts: only the others, and the frequent ones, come back.
    shared = counts.join(F.broadcast(ranks), "word", "left").filter("blocks > 1 or rank is not null").select("word", "c", F.coalesce("rank", F.lit(-1)).alias("rank"))
    known = words.join(shared, "word").filter("c <> n or rank >= 0").select("block", "at", "c", "rank")
    coded = materialise(blocks.groupBy("number").cogroup(known.groupBy("block")).applyInArrow(_coder(vocab), _CODED), "codes", _SMALL_ROW_GROUPS)
    discard(listed, counts)
    # Blocks are few bytes and much work: they are dealt out by number, not by size.
    coded = coded.repartitionByRange(max(1, min(coded.count(), 16 * tasks)), "block")
    vector = _fitted(coded, vocab)

    def scored(batches):
        w = gated.views(vector, vocab.codes)
        for batch in batches:
            for data, docs in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                ids, known, held, lengths, n_known, of_counts, rare = _unpack(docs, *_SCORED)
                net = gated.score_documents(w, vocab.codes, _block_codes(vocab, data), lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, mask=~known), "held_out": pa.array(held), "n_tokens": lengths, "n_known": n_known,
                    "train_tokens": np.full(len(ids), vocab.n, np.int64), "base_score": of_counts, "score": (net + rare) / np.log(10),
                })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.select("codes", "docs").mapInArrow(scored, out)


def op4_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
