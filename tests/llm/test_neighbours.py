import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import neighbours as nn

VECTORS = "vec_id long, embedding array<float>, label int, vector string, rep int, query int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3) for i, v in rows], VECTORS)


def brute(rows, k=20, step=20):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in (i for i in good if i % step == 0):
        found = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in table.collect()])
    got = result(nn.search(table, F.col("vec_id") % 20 == 0))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and len(found) == 20
    best = {q: dict(v) for q, v in want.items()}
    assert all(s == pytest.approx(best[q][i], rel=1e-12) for q, v in got.items() for i, s in v if i in best[q])


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=5).tolist()) for i in range(100)] + [(i, [3.0] * 5) for i in range(200, 260)]
    rows += [(300, None), (320, [0.0] * 5), (340, [1.0, None, 1.0, 1.0, 1.0]), (360, [float("nan")] * 5), (380, [float("inf")] * 5), (400, [])]
    got = result(nn.search(frame(spark, [*rows, rows[150], rows[7]]), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0])], [(20, None)]])
def test_small_tables(spark, rows):
    got = result(nn.search(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == ({0: [(1, 4.0)]} if len(rows) == 2 else {})


def test_blocks_and_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(nn, "CODE_BLOCK", 64)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(nn, "GROUP", 2)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(600)]
    got, want = result(nn.search(frame(spark, rows), F.col("vec_id") % 20 == 0, rerank=64)), brute(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.93 * 20 * len(want)


def test_parallel_errors_weigh_more():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(2000, 16))
    lost = {}
    for eta in (1.0, 4.0):
        books = nn.fit(x, eta)
        codes = nn.encode(x, books, eta)
        rest = x - np.stack([books[j][codes[:, j]] for j in range(8)], 1).reshape(2000, 16)
        lost[eta] = np.abs((rest * x).sum(1)).mean()
    assert lost[4.0] < 0.9 * lost[1.0]


def test_whole_among_200k_rows_a_third_near_copies():
    """The blocks as search() forms them, against brute force: near copies share codes, and true neighbours may come last."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(200_000, 64))
    x[::3] = x[0] + 1e-3 * rnd.normal(size=(len(x[::3]), 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    asked = rnd.choice(len(x), 60, replace=False)
    eta = nn.anisotropy(64)
    books = nn.fit(x[rnd.choice(len(x), 4096, replace=False)], eta, rounds=2)
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
    for a in range(0, len(x), nn.CODE_BLOCK):
        block = x[a : a + nn.CODE_BLOCK]
        coded = nn.decoded(nn.packed(nn.encode(block, books, eta, 1)), books, 64)
        nn.meet(x[asked], best, np.arange(a, a + len(block)), block, coded, nn.bounds(block, coded), 21, nn.RERANK)
    for q, (ids, scores) in zip(asked, best, strict=True):
        want = nn._best(np.arange(len(x)), nn._in_order(np.broadcast_to(x[q], x.shape), x), 21)
        assert ids.tolist() == want[0].tolist() and scores.tolist() == want[1].tolist()


def test_more_near_copies_than_are_scored_first(spark):
    rnd = np.random.default_rng(6)
    centre = rnd.normal(size=16)
    rows = [(i, (centre + 1e-3 * rnd.normal(size=16)).tolist()) for i in range(3000)] + [(i, rnd.normal(size=16).tolist()) for i in range(3000, 4000)]
    got, want = result(nn.search(frame(spark, rows), F.col("vec_id") % 200 == 0)), brute(rows, step=200)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_vectors_of_other_lengths_are_searched_among_themselves(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(100)] + [(100 + i, rnd.normal(size=3).tolist()) for i in range(30)] + [(140, [1.0, 2.0]), (2**53 + 1, rnd.normal(size=6).tolist())]
    got = result(nn.search(frame(spark, rows), F.col("vec_id") % 20 == 0))
    want = {}
    for d in (6, 3, 2):
        want |= brute([(i, v) for i, v in rows if len(v) == d])
    assert got == {q: [(i, pytest.approx(s, rel=1e-12)) for i, s in v] for q, v in want.items() if v}
