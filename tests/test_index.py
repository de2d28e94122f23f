"""Search through the stored index gives what search over all records gives."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import index
from quarry.operators.storage import fresh_path
from quarry.plans import search

NAMES = ["Alpha Report.md", "alpha-beta.txt", "gamma.pdf", "Screenshot 12.png", "delta repotr.md", "notes", "beta", "Projects", "zeta alphabet.md", "reprot.doc"]
RECORDS = "volume long, node long, path string, name string, kind string, len long, created timestamp, modified timestamp, changed timestamp, tags array<string>, finder_comment string"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(1 + k % 2, k, f"/users/u{k % 3}/{'developer' if k % 5 == 0 else 'docs'}/{NAMES[k % 10]}", NAMES[k % 10], "dir" if k % 10 in (5, 6, 7) else "file", k * 100, None, None, None, ["red", "beta"] if k % 4 == 0 else None, "about alpha things" if k % 6 == 0 else None) for k in range(80)]
    records = spark.createDataFrame(rows, RECORDS).withColumn("modified", F.when(F.col("node") % 3 == 0, F.timestamp_seconds(F.lit(1767000000) - F.col("node") * 86400)))
    content = spark.createDataFrame([(1 + k % 2, k, " ".join(["alpha"] * (k % 4) + ["beta", "gamma", "report of the alpha"][: k % 5] + ["the end"] * (k % 3))) for k in range(0, 80, 2)], "volume long, node long, text string")
    columns = index.record_columns(records)
    path = fresh_path(spark, "test-index")
    index.write_index(path, columns, content)
    return columns.cache(), index.content_postings(content).cache(), index.open_index(spark, path)


QUERIES = [
    "report", "reprot", "alpha beta", "alpha -beta", "beta or gamma", "alpha not beta", '"alpha report"', '"report of the"', "near:3:alpha,report or zeta", "ext:pdf or alpha", "name:alpha", "screenshot", "(alpha or ext:pdf) beta", "phabe", "path:developer alpha",
    'tag:red or "of the"', "missingword", "not (alpha or beta)", "near:3:alpha,report",
]


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_hits_are_those_of_the_scan(tables, k):
    columns, postings, stored = tables
    options = {"limit": 200, "deep": k % 5 != 4, "as_of": "2026-01-01", "substring_fallback": ("always", "never")[k % 2]}
    want = search.ranked(columns, QUERIES[k], postings, **options).collect()
    assert search.ranked(None, QUERIES[k], index=stored, **options).collect() == want


def test_lookups_prune_and_nothing_shuffles_the_records(tables):
    stored = tables[2]
    plan = search.ranked(None, "alpha report", index=stored, fuzzy=False, substring_fallback="never")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "In(term, [alpha,report])" in plan
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_positions_are_whole(spark):
    rows = spark.createDataFrame([(1, 1, "b a b a b"), (1, 2, ""), (1, 3, None), (1, 4, "Zz.zz x")], "volume long, node long, text string")
    got = sorted(map(tuple, index.content_postings(rows).select("node", "term", "positions").collect()))
    assert got == [(1, "a", [1, 3]), (1, "b", [0, 2, 4]), (4, "x", [2]), (4, "zz", [0, 1])]
