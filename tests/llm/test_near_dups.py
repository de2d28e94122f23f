import os
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_dups as nd

DOCS = "doc_id long, text string, node long, sketch string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], DOCS)


def bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(rows):
    bags = {}
    for i, t in rows:
        bags.setdefault(i, bag(t))
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if root(i) != root(j) and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def edited(words, rate, rnd):
    return [w if rnd.random() > rate else f"z{rnd.randint(0, 10**6)}" for w in words]


def corpus(seed=0, groups=14, size=12):
    rnd, rows, k = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([3, 40, 150, 400]))]
        if g % 4 == 0:
            base = base[:20] * 12  # a multiset with large counts
        for _ in range(size):
            rows.append((k, " ".join(edited(base, rnd.choice([0, 0, 0.004, 0.01, 0.03, 0.08]), rnd))))
            k += 1
    rows += [(k + i, " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(60))) for i in range(50)]
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus() + [(9000, None), (9001, ""), (9002, "  "), (9003, "One two"), (9004, "one  TWO"), (9005, "x " * 30_000), (9006, "x " * 29_000), (9007, "x " * 9_000)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_blocks_give_the_same_classes(spark, monkeypatch):
    for name, value in (("_PAIRED", 2), ("_BLOCK", 5), ("_CLUSTER", 4), ("_CLUSTER_BYTES", 200), ("_TOGETHER", 300)):
        monkeypatch.setattr(nd, name, value)
    rows = corpus(5, 5, 30)
    got = {r.doc_id: r.class_id for r in nd.near_classes(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(1)
    for _ in range(6):
        items = rnd.integers(1, 2**63, 80).astype(np.uint64)
        a, b = rnd.integers(0, 2, 80) * rnd.integers(1, 900, 80), rnd.integers(0, 2, 80) * rnd.integers(1, 900, 80)
        b = np.where(rnd.random(80) < 0.7, a, b)
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = nd.bag_min_hash(doc, np.r_[items[a > 0], items[b > 0]], np.r_[a[a > 0], b[b > 0]].astype(np.int64), 2, 4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=5 * (0.25 / 4096) ** 0.5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c"), (1, "a b c"), (2, "a b c")], [(None, "a"), (3, "a")]])
def test_small_tables(spark, rows):
    got = nd.near_classes(frame(spark, rows)).collect()
    assert len(got) == sum(i is not None for i, _ in rows)
    assert {r.class_id for r in got} <= {1, 3}


def test_stage_keeps_one_of_each_class(spark):
    rows = corpus(2, 4, 8)
    classes = brute(rows)
    out = nd.near_dedup_stage(spark, frame(spark, rows + rows[:3]), None)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(classes.values()))
    assert out.columns == ["doc_id", "text", "node", "sketch", "n"]


def test_tables_of_few_rows_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: each file of a local disk costs three processes that Hadoop starts."""
    files = []

    def counted(df, name, *args, plain=nd.materialise, **options):
        out = plain(df, name, *args, **options)
        files.append((name, sum(f.startswith("part-") for f in os.listdir(out.stored_at.removeprefix("file:")))))
        return out

    monkeypatch.setattr(nd, "materialise", counted)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [(k, " ".join(f"t{k // 2}w{j}" for j in range(9))) for k in range(200)]
        found = nd.near_dedup_stage(spark, frame(spark, rows), None)
        assert sorted(r.doc_id for r in found.collect()) == list(range(0, 200, 2))
        roots = {r.node: r.root for r in nd.components(spark.createDataFrame([(k, k + 3) for k in range(300)], "a long, b long")).collect()}
        assert roots == {k: k % 3 for k in range(303)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    few = [n for name, n in files if name in ("heads", "edges", "clusters", "dropped", "again")]
    assert len(few) > 8 and max(few) == 1
