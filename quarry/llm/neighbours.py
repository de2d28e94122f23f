"""Approximate nearest neighbours for the largest inner product, by score-aware (anisotropic) product quantisation.

Codebooks of 16 centroids for each pair of dimensions are fitted on a bounded sample; their loss weighs the part of a
residual that is parallel to its vector more than the rest, as that part is what changes large inner products. Every
vector is coded, four bits a subspace, and the norm of what its code leaves out is stored. A query's product with a code
is off by at most the query's norm times that residual norm: every vector whose coded score and bound reach the query's
k-th exact score so far is scored on the original, in double precision. So nothing is missed, at any size of the table
and among near copies that share a code; the codes only save exact products.

Queries and vectors meet in blocks: a task holds one block of queries and streams blocks of vectors past it, keeping the
best of each query. Equal vectors are coded once and their least ids listed, so that many copies of one vector neither
crowd out others nor fall to one task.

Vectors that are null, zero, or that hold null or non-finite components take no part. Vectors of different lengths have
no product: each length has its own codebooks and is searched alone. Ties go to smaller ids; a repeated row is one candidate; fewer candidates than asked for are
all returned; an empty table gives no rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean_batches, materialise

#: Vectors, least by hash, that the codebooks are fitted on.
SAMPLE = 8192
#: Best by code in a query's first block, scored first for a k-th score to start from; no limit on what is scored.
RERANK = 256
#: Parallel error below this cosine counts less; sets the weight of parallel residuals.
THRESHOLD = 0.2
SUB = 2
CENTROIDS = 16
#: Vectors (of up to WIDE components) in a block, queries in a block (16 times as many where queries are many), blocks in
#: a group, and queries scored side by side.
CODE_BLOCK, QUERY_BLOCK, GROUP, WIDE, LANES = 1 << 15, 512, 16, 64, 128


def anisotropy(d: int, threshold: float = THRESHOLD) -> float:
    """How much more a parallel residual weighs than an orthogonal one."""
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def _subspaces(x: np.ndarray) -> np.ndarray:
    """(n, m, SUB), with zeros behind odd dimensions so that two codes fill a byte."""
    pad = -x.shape[1] % (2 * SUB)
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, m): coordinate descent on eta * parallel^2 + orthogonal^2 residuals, from the nearest centroids."""
    parts = _subspaces(x)
    unit = _subspaces(x / np.linalg.norm(x, axis=1, keepdims=True))
    n, m, _ = parts.shape
    codes = np.empty((n, m), np.uint8)
    plain = np.empty((m, n, CENTROIDS), np.float32)
    along = np.empty((m, n, CENTROIDS), np.float32)
    for j in range(m):
        rest = parts[:, j, None, :] - books[j][None]
        plain[j] = (rest**2).sum(-1)
        along[j] = (rest * unit[:, j, None, :]).sum(-1)
        codes[:, j] = plain[j].argmin(1)
    rows = np.arange(n)
    total = sum(along[j][rows, codes[:, j]] for j in range(m))
    for _ in range(sweeps):
        for j in range(m):
            others = total - along[j][rows, codes[:, j]]
            cost = plain[j] + (eta - 1.0) * (others[:, None] + along[j]) ** 2
            codes[:, j] = cost.argmin(1)
            total = others + along[j][rows, codes[:, j]]
    return codes


def fit(x: np.ndarray, eta: float | None = None, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Codebooks (m, 16, SUB) that lower the anisotropic loss over x, by turns of coding and solving for the centroids."""
    eta = anisotropy(x.shape[1]) if eta is None else eta
    parts, unit = _subspaces(x), _subspaces(x / np.linalg.norm(x, axis=1, keepdims=True))
    n, m, _ = parts.shape
    rnd = np.random.default_rng(seed)
    books = np.stack([parts[rnd.choice(n, CENTROIDS, replace=n < CENTROIDS), j] for j in range(m)])
    for k in range(rounds):
        codes = encode(x, books, 1.0 if k < rounds // 2 else eta, 1)  # plain at first: a better start
        w = 1.0 if k < rounds // 2 else eta
        total = sum(((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(-1) for j in range(m))
        for j in range(m):
            now = ((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(-1)
            goal = (w - 1.0) * (total - now + (parts[:, j] * unit[:, j]).sum(-1))
            for c in range(CENTROIDS):
                at = codes[:, j] == c
                if at.any():
                    u = unit[at, j]
                    left = at.sum() * np.eye(SUB) + (w - 1.0) * u.T @ u
                    books[j, c] = np.linalg.solve(left, parts[at, j].sum(0) + (goal[at, None] * u).sum(0))
            total += ((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(-1) - now
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, (m / 2, n): a scan reads one subspace pair of all vectors after another."""
    return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)


def decoded(bytes_: np.ndarray, books: np.ndarray, d: int) -> np.ndarray:
    """(n, d): the vectors that packed codes stand for; a query's products with them are its table scores."""
    codes = np.empty((2 * len(bytes_), bytes_.shape[1]), np.uint8)
    codes[::2], codes[1::2] = bytes_ & 15, bytes_ >> 4
    return np.stack([book[c] for book, c in zip(books, codes, strict=True)], 1).reshape(bytes_.shape[1], -1)[:, :d]


def bounds(x: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """By how much, for a query of norm 1, a vector's product can exceed its code's; rounding included."""
    rest, own = np.linalg.norm(x - coded, axis=1), np.linalg.norm(x, axis=1)
    return rest + 1e-14 * x.shape[1] * (own + rest)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to smaller ids; by falling score."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component on: the same to the last bit whatever else is in the block."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def meet(queries: np.ndarray, best: list, ids: np.ndarray, x: np.ndarray, coded: np.ndarray, bound: np.ndarray, k: int, start: int) -> int:
    """Brings each query's (ids, scores) of the k best up to date with a block; the number of exact products by the bound."""
    norms, longest, scored = np.linalg.norm(queries, axis=1), np.linalg.norm(x, axis=1).max(initial=0.0), 0
    for a in range(0, len(queries), LANES):
        q, qn = queries[a : a + LANES], norms[a : a + LANES]
        close = 1e-14 * x.shape[1] * qn * longest  # how far matrix products are from sums in order
        table = q @ coded.T
        least = np.array([b[1][-1] if len(b[0]) >= k else -np.inf for b in best[a : a + LANES]])
        for i in np.flatnonzero(np.isneginf(least)) if len(ids) >= max(k, start) else ():
            first = np.argpartition(table[i], len(ids) - max(k, start))[-max(k, start) :]
            least[i] = np.partition(x[first] @ q[i], len(first) - k)[len(first) - k] - close[i]
        table += qn[:, None] * bound
        reach = ~(table < least[:, None])
        scored += int(reach.sum())
        some = np.flatnonzero(reach.any(0))
        near = np.where(reach[:, some], q @ x[some].T, -np.inf)
        if len(some) > k:
            least = np.fmax(least, np.partition(near, len(some) - k, axis=1)[:, len(some) - k] - close)
        mine, at = np.nonzero(reach[:, some] & ~(near < (least - close)[:, None]))
        at = some[at]
        exact = _in_order(q[mine], x[at])
        ends = np.searchsorted(mine, np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            new, old = slice(ends[i], ends[i + 1]), best[a + i]
            best[a + i] = _best(np.concatenate([old[0], ids[at[new]]]), np.concatenate([old[1], exact[new]]), k)
    return scored


def valid_vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def fit_lengths(vectors) -> dict[int, np.ndarray]:
    """Codebooks by vector length, from a sample; lengths of few samples have none, and their vectors are scored exactly."""
    by_length: dict[int, list] = {}
    for v in vectors:
        by_length.setdefault(len(v), []).append(v)
    return {d: fit(np.stack(some).astype(np.float64)) for d, some in sorted(by_length.items()) if len(some) >= CENTROIDS}


def search(table: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """The k nearest other rows of each row for which is_query (a Column over vec_id): query_id, rank, vec_id, score.

    The codebooks are fitted on at most sample vectors; every row is coded, and the result is that of exact search.
    """
    spark = table.sparkSession
    lean_batches(spark)
    rows = materialise(valid_vectors(table, id_col, vector).dropDuplicates(["vec_id", "vector"]), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    # Of equal vectors, the k + 1 least ids are enough for any query, itself left out.
    few = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    reps = materialise(few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "reps")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    n, n_queries = reps.count(), queries.count()
    fitted = reps.select("vector").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()["vector"]
    books = fit_lengths(fitted)
    widest = max(map(len, fitted), default=1)
    number = np.float32 if "float" in table.schema[vector].dataType.simpleString() else np.float64
    n_blocks = max(1, -(-n // max(1, min(CODE_BLOCK, CODE_BLOCK * WIDE // widest))))
    n_parts = max(1, -(-n_queries // (QUERY_BLOCK * min(16, max(1, n_queries // (64 * QUERY_BLOCK))))))
    groups = -(-n_blocks // GROUP)

    def coded(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        d = x.shape[1]
        own = books.get(d)
        codes = packed(encode(x, own, anisotropy(d))) if own is not None else np.zeros((0, len(x)), np.uint8)
        left = bounds(x, decoded(codes, own, d) if own is not None else np.zeros_like(x))
        return pd.DataFrame({"d": [d], "block": pdf["block"].iloc[:1], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "left": [left.tobytes()], "vectors": [x.astype(number).tobytes()]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [len(pdf["query"].iloc[0])], "part": pdf["part"].iloc[:1], "query_ids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "queries": [np.stack(pdf["query"].to_numpy()).astype(np.float64).tobytes()]})

    blocks = reps.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)))
    blocks = materialise(blocks.groupBy(F.size("vector").alias("d"), "block").applyInPandas(coded, "d int, block long, ids binary, codes binary, left binary, vectors binary"), "codes")
    parts = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)))
    parts = materialise(parts.groupBy(F.size("query").alias("d"), "part").applyInPandas(gathered, "d int, part long, query_ids binary, queries binary"), "queries")
    met = blocks.withColumn("group", F.expr(f"block div {GROUP}L")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    met = met.join(parts.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), ["d", "part", "group"])

    def scanned(batches):
        at, asked, best = None, (), []

        def done():
            return pd.DataFrame({"query_id": asked, "found": [[{"less": -float(s), "rep": int(i)} for i, s in zip(*b, strict=True)] for b in best]})

        for pdf in batches:
            for d, part, group, ids, codes, left, vectors, query_ids, found in zip(*(pdf[c] for c in ("d", "part", "group", "ids", "codes", "left", "vectors", "query_ids", "queries")), strict=True):
                if at != (d, part, group):
                    if best:
                        yield done()
                    at, asked = (d, part, group), np.frombuffer(query_ids, np.int64)
                    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors, number).reshape(len(ids), d).astype(np.float64)
                coded_ = decoded(np.frombuffer(codes, np.uint8).reshape(-1, len(ids)), books[d], d) if d in books else np.zeros_like(x)
                meet(np.frombuffer(found, np.float64).reshape(len(asked), d), best, ids, x, coded_, np.frombuffer(left, np.float64), k + 1, rerank)
        if best:
            yield done()

    met = met.repartition("d", "part", "group").sortWithinPartitions("d", "part", "group")
    near = met.select("d", "part", "group", "ids", "codes", "left", "vectors", "query_ids", "queries").mapInPandas(scanned, "query_id long, found array<struct<less:double,rep:long>>")
    near = near.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    near = near.select("query_id", F.explode("found").alias("one")).select("query_id", F.col("one.rep").alias("rep"), (-F.col("one.less")).alias("score"))

    scored = near.join(reps.select("rep", "ids"), "rep")
    by_query = Window.partitionBy("query_id")
    each = scored.withColumn("vec_id", F.explode("ids")).filter("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
