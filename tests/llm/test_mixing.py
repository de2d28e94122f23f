import re
from collections import defaultdict

import pytest

from quarry.llm import mixing

DOCS = "doc_id long, text string, source string, size int, src string, target int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], DOCS)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        out = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in stopped and out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        stopped |= over


@pytest.fixture(scope="module")
def rows():
    out = [(k, " ".join(["w"] * (k * 37 % 90)), f"s{min(k % 13, 6)}") for k in range(3000)]
    return out + [(5000, None, "s1"), (5001, "", None), (5002, "a b\tc\x0bd e", None), (5003, "x " * 20_000, "s2"), (5004, "tiny", "zz"), (5004, "tiny", "zz"), (5005, "y", "\U0001f600")]


def test_targets_and_bounds(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    sizes, taken, by_id = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for r in got:
        sizes[by_id[r.doc_id]] += r.size
        taken[by_id[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-6)
    assert {tuple(r) for r in mixing.mix(frame(spark, rows)).collect()} == {tuple(r) for r in got}


def test_each_stretch_of_the_schedule_follows_the_weights(spark, rows):
    table = mixing.targets(mixing.sized(frame(spark, rows), "doc_id", "text", "source"))
    share = {r.src: r.target for r in table.collect()}
    slots = sorted((r.slot, r.src, r.rank) for r in mixing.schedule(table, 16).collect())
    total, seen = sum(share.values()), defaultdict(int)
    for k, (_, src, rank) in enumerate(slots):
        assert rank == seen[src]
        seen[src] += 1
        if k in (500, 1500, 4000):
            assert all(abs(seen[s] - (k + 1) * t / total) < 12 for s, t in share.items())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "", "b")], [(1, "one", "a")], [(None, "two words", "a"), (None, "two words", "a")]])
def test_small_tables(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(r.size for r in got)
