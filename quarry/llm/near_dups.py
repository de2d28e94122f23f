"""Near duplicates by BagMinHash over word shingles, banded, with verified multiset overlap.

A document is the multiset of its five-word shingles (lower case). Its BagMinHash signature takes, for every shingle and
every unit of its count, the points of a Poisson process; counts are cut into octaves and each octave is a hierarchy of
halves, so a count in the thousands costs little, and a process stops once its points lie beyond all minima. Two
signatures agree at a place with a probability equal to the weighted Jaccard similarity.

Documents with the same words are one node. Nodes that agree on a band are compared by a 1-bit sketch of the signature;
pairs that may reach the threshold make candidate clusters, and in a cluster the multisets themselves decide. Tasks emit
spanning links of what they compared, never all pairs; buckets and clusters beyond a block are compared block against
block, so none is one task and none is capped. Classes are the connected components of the verified links.

A document of fewer than five words is one shingle; one without words (null, empty) is a class of its own. Rows of the
same id count as one document. An empty table gives no rows. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean_batches, lean_worker, materialise, small

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold agrees on no band once in 3000 cases, one at 0.85 once in 60,000.
BANDS, ROWS = 34, 7
PLACES = BANDS * ROWS
#: Differing sketch bits, at most, of a pair that is compared: 4.5 standard deviations beyond the threshold's mean.
SKETCH_DIFFERS = int(PLACES * (1 - THRESHOLD) / 2 + 4.5 * (PLACES * 0.09) ** 0.5)
#: Shingles that are signed together: enough for numpy, little memory.
_TOGETHER = 1 << 18
#: Documents of a bucket that are paired by a join; rows of a block of a bucket, and of a cluster; characters of a cluster's block.
_PAIRED, _BLOCK, _CLUSTER, _CLUSTER_BYTES = 16, 2048, 768, 8 << 20
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles, in text order, repeats included."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = _mix(out ^ h[j : j + n])
    return out


def bag_min_hash(docs: np.ndarray, items: np.ndarray, counts: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n_docs, places) of multisets given as rows (document, item hash, count): the least points, as bits."""
    sig = np.full(n_docs * places, np.inf)
    # Octave 0 is [0, 1), octave k is [2^(k-1), 2^k): a root for each octave that a count reaches into.
    octaves = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))), 0).astype(np.int64) + 1
    row = np.repeat(np.arange(len(items)), octaves)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    level = np.maximum(nth - 1, 0)
    low = np.where(nth > 0, np.int64(1) << level, 0)
    doc, count = docs[row], counts[row]
    node = _mix(items[row] ^ _mix(low.astype(np.uint64) * np.uint64(64) + level.astype(np.uint64)))
    item = items[row]
    x = _exponential(_mix(node)) / (places * (1 << level))
    step = np.zeros(len(row), np.uint64)
    while len(x):
        leaf = level == 0
        if leaf.any():
            at = leaf if not leaf.all() else slice(None)
            d, key, pos = doc[at], node[at], x[at]
            bits = _mix(key + (step[at] * np.uint64(2) + np.uint64(2)) * _GOLD)
            np.minimum.at(sig, d * places + (bits % np.uint64(places)).astype(np.int64), pos)
            after = pos + _exponential(_mix(bits)) / places
            parts = [(d, item[at], count[at], low[at], level[at], key, after, step[at] + np.uint64(1))]
        else:
            parts = []
        if not leaf.all():
            at = ~leaf
            key, half = node[at], level[at] - 1
            coin = (_mix(key ^ _MIX1) & np.uint64(1)).astype(bool)
            late = x[at] + _exponential(_mix(key ^ _MIX2)) / (places * (1 << half))
            for upper in (False, True):
                start = low[at] + (np.int64(1) << half if upper else 0)
                inside = start < count[at]
                pos = np.where(coin == upper, x[at], late)[inside]
                start, lv, it = start[inside], half[inside], item[at][inside]
                child = _mix(it ^ _mix(start.astype(np.uint64) * np.uint64(64) + lv.astype(np.uint64)) ^ _MIX1)
                parts.append((doc[at][inside], it, count[at][inside], start, lv, child, pos, np.zeros(len(it), np.uint64)))
        doc, item, count, low, level, node, x, step = (np.concatenate(p) for p in zip(*parts, strict=True))
        least = sig.reshape(n_docs, places).max(axis=1)
        on = x < least[doc]
        doc, item, count, low, level, node, x, step = (a[on] for a in (doc, item, count, low, level, node, x, step))
    return sig.view(np.uint64).reshape(n_docs, places)


def bands_and_sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n, BANDS) and 1-bit sketches (n, 4 words)."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        h = _mix(h ^ parts[:, :, j])
    bits = (_mix(sig) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 256 - PLACES))), axis=1)
    return h.view(np.int64), np.ascontiguousarray(packed).view(np.int64)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets (sorted distinct hashes, counts, total)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[2] + b[2] - both))


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def by_key(batches, key: list[str]):
    """The groups of rows with equal keys from a partition sorted by key, across batches; one group is held at a time."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            held = pdf
            continue
        values = pdf[key].to_numpy()
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1)]
        for a, b in zip(starts, starts[1:], strict=False):
            yield pdf.iloc[a:b]
        held = pdf.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held


def _links(frame: pd.DataFrame, side: np.ndarray | None, judge) -> list[tuple[int, int]]:
    """Spanning links of a group: rows whose sketches may reach the threshold and which judge(i, j) confirms, likest first.

    side: 0 or 1 by row, if only pairs across sides are to be compared.
    """
    n = len(frame)
    words = np.array(frame["sketch"].tolist(), np.int64).view(np.uint64)
    forest = Forest(n)
    for a in range(n - 1):
        others = np.arange(a + 1, n)
        if side is not None:
            others = others[side[a + 1 :] != side[a]]
        differs = np.bitwise_count(words[others] ^ words[a]).sum(axis=1)
        near = np.flatnonzero(differs <= SKETCH_DIFFERS)
        for k in near[np.argsort(differs[near], kind="stable")]:
            b = int(others[k])
            if forest.root(a) != forest.root(b) and judge(a, b):
                forest.join(a, b)
    return forest.links


def _in_blocks(rows: DataFrame, node: str, blocks) -> DataFrame:
    """rows for block-against-block comparison: columns one, two, side. blocks: of the row's group, a Column.

    A group of one block is compared with itself; of more, block i meets every block j.
    """
    blocks = F.greatest(F.ceil(blocks), F.lit(1)).cast("long")
    mine = F.pmod(F.xxhash64(node, F.lit(3)), blocks)
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumns({"one": F.least("_mine", "_other"), "two": F.greatest("_mine", "_other"), "side": (F.col("_mine") > F.col("_other")).cast("int")}).drop("_mine", "_other")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node) of each connected component of edges (a, b), by alternating large and small stars."""
    n = edges.count()  # the stars of n edges are n at most
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", most=n)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a")
        star = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b")
        last, edges = edges, materialise(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", most=n)
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def signatures(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Stored: doc_id, words_a, words_b (128 bits of the word sequence), bytes, bands (null without words), sketch."""
    lean_batches(docs.sparkSession, 8)

    def signed_together(ids: list, texts: list, runs: list) -> pa.RecordBatch:
        # Distinct shingles with counts, of all texts at once.
        doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        h = np.concatenate(runs)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
        sig = bag_min_hash(doc[new], h[new], np.diff(np.r_[new, len(h)]).astype(np.int64), len(runs))
        bands, sketch = bands_and_sketch(sig)
        words = np.frombuffer(b"".join(xxhash.xxh128_digest(" ".join(t.lower().split())) for t in texts), ">i8").astype(np.int64).reshape(-1, 2)
        lists = lambda x, none=None: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()), mask=none)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), pa.array([len(t) for t in texts], pa.int64()), lists(bands, pa.array([not len(r) for r in runs])), lists(sketch)],
            names=["doc_id", "words_a", "words_b", "bytes", "bands", "sketch"],
        )

    def rows(batches):
        ids = texts = runs = batch = None
        for batch in batches:
            lean_worker()
            ids, texts, runs, held = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                runs.append(shingles(t))
                held += len(runs[-1]) + 64
                if held >= _TOGETHER:
                    yield signed_together(ids, texts, runs)
                    ids, texts, runs, held = [], [], [], 0
            if ids:
                yield signed_together(ids, texts, runs)
        ids = texts = runs = batch = None  # workers take turns: what an idle one holds adds to those at work
        lean_worker()

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(rows_in.filter("doc_id is not null").mapInArrow(rows, "doc_id long, words_a long, words_b long, bytes long, bands array<long>, sketch array<long>"), "signatures")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span the pairs which share a band and whose sketches may reach the threshold."""
    rows = nodes.select("node", "sketch", F.posexplode("bands").alias("band", "value")).select("node", "sketch", F.xxhash64("band", "value").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = materialise(rows.join(sizes, "bucket"), "buckets")
    few = rows.filter(f"n <= {_PAIRED}")
    a, b = few.select("bucket", F.col("node").alias("a"), F.col("sketch").alias("x")), few.select("bucket", F.col("node").alias("b"), F.col("sketch").alias("y"))
    differs = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(1, 4)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    pairs = a.join(b, "bucket").filter((F.col("a") < F.col("b")) & (differs <= SKETCH_DIFFERS)).select("a", "b")

    def spanned(batches):
        lean_worker()
        for g in by_key(batches, ["bucket", "one", "two"]):
            across = g["one"].iloc[0] != g["two"].iloc[0]
            links = _links(g, g["side"].to_numpy() if across else None, lambda i, j: True)
            ids = g["node"].to_numpy()
            yield pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    many = _in_blocks(rows.filter(f"n > {_PAIRED}"), "node", F.col("n") / _BLOCK).repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    found = materialise(pairs.unionByName(many.select("bucket", "one", "two", "side", "node", "sketch").mapInPandas(spanned, "a long, b long")).distinct(), "candidates")
    discard(rows)
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of docs with an id: doc_id, class_id (least id of its class), n_links (verified links kept for its node)."""
    sigs = signatures(docs, id_col, text)
    # Copies meet by a partial aggregate; only groups of two or more come back to their documents.
    heads = materialise(sigs.filter("bands is not null").groupBy("words_a", "words_b").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "heads", most=sigs.count())
    headed = sigs.join(small(heads, heads.count()), ["words_a", "words_b"], "left").withColumn("node", F.coalesce("head", "doc_id"))
    same = headed.select("doc_id", "node")
    nodes = headed.filter("bands is not null and doc_id = node").dropDuplicates(["doc_id", "words_a", "words_b"]).select("node", "bands", "sketch", "bytes")
    nodes = materialise(nodes, "nodes")
    clusters = components(candidate_edges(nodes))
    sizes = clusters.join(nodes.select("node", "bytes"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    clusters = materialise(clusters.join(sizes, "root"), "clusters", most=nodes.count())
    some = clusters.count()

    def verified(batches):
        lean_worker()
        for g in by_key(batches, ["root", "one", "two"]):
            across = g["one"].iloc[0] != g["two"].iloc[0]
            texts, ids, bags = g["text"].to_numpy(), g["node"].to_numpy(), {}

            def bag(k):
                if k not in bags:
                    h, c = np.unique(shingles(texts[k]), return_counts=True)
                    bags[k] = (h, c, int(c.sum()))
                return bags[k]

            def linked(i, j):
                a, b = bag(i), bag(j)
                return min(a[2], b[2]) >= threshold * max(a[2], b[2]) - 1e-9 and overlap(a, b) >= threshold - 1e-9

            links = _links(g, g["side"].to_numpy() if across else None, linked)
            yield pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    texts = texts.join(small(clusters, some), "node").join(small(nodes.select("node", "sketch").join(clusters.select("node"), "node", "left_semi"), some), "node")
    grouped = _in_blocks(texts, "node", F.greatest(F.col("n") / _CLUSTER, F.col("bytes") / _CLUSTER_BYTES)).repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")
    links = materialise(grouped.select("root", "one", "two", "side", "node", "text", "sketch").mapInPandas(verified, "a long, b long").filter("a <> b").distinct(), "links")
    classes = components(links).withColumnRenamed("root", "class_id")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    out = same.join(small(classes, some), "node", "left").join(small(ends, some), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op10_near_duplicates(spark, sf_dir):
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_dedup_stage(spark, docs, sf_dir):
    """docs with one document of each class, the one of the least id; of rows with the same id, one. Null ids stay."""
    rows = docs.count()
    dropped = materialise(near_classes(docs).filter("doc_id <> class_id").select("doc_id").distinct(), "dropped", most=rows)
    kept = docs.join(small(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)
    again = materialise(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "again", most=rows)
    n = again.count()
    if not n:
        return kept
    return kept.join(small(again, n), "doc_id", "left_anti").unionByName(kept.join(small(again, n), "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
