import pytest
from pyspark.sql import functions as F

from quarry.operators import admin as A
from quarry.plans import search


def test_inspect_and_migrate(spark, tmp_path):
    old, new = "a long, b string", "a long, b string, c int"
    spark.createDataFrame([(1, "x")], old).write.parquet(str(tmp_path / "t"))
    assert A.inspect(spark, str(tmp_path / "t"), new, (old,)) == "legacy"
    assert A.inspect(spark, str(tmp_path / "t"), old) == "current"
    assert A.inspect(spark, str(tmp_path / "t"), "z long") == "unsupported"
    assert A.inspect(spark, str(tmp_path / "none"), old) == "missing"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"junk")
    assert A.inspect(spark, str(tmp_path / "bad"), old) == "unreadable"
    A.migrate(spark.read.parquet(str(tmp_path / "t")), new, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first() == (1, "x", None)


def test_routes_and_cleanup(spark):
    rows = spark.createDataFrame([("missing", False, False), ("legacy", True, True), ("current", True, True), ("current", True, False), ("current", False, False)], "r string, s boolean, c boolean")
    assert [r[0] for r in rows.select(A.rebuild_route(F.col("r"), F.col("s"), F.col("c"))).collect()] == ["blocked", "migrate", "recover", "rebuild", "ready"]
    retired = spark.createDataFrame([("a", 5), ("b", 6)], "path string, bytes long")
    assert A.cleanup_plan(retired, min_count=3, min_bytes=100).count() == 0
    assert [r.path for r in A.cleanup_plan(retired, 1, 0, retired.filter("path = 'a'")).collect()] == ["b"]
    assert A.checkpoint_row(spark, volume=1, seen=7).first().asDict() == {"seen": 7, "volume": 1}
    assert A.fifo(spark.createDataFrame([(k,) for k in range(9)], "arrival long"), 3).count() == 3
    assert A.summed(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")).first() == (4, 6)
    assert A.density(spark.createDataFrame([("t", 1000)], "table_name string, bytes long"), 3).first().bytes_per_record == 333
    assert spark.createDataFrame([("on", "on"), ("on", "off"), ("on", "disabled")], "a string, b string").select(A.invalidation(F.col("a"), F.col("b"))).collect() == [("none",), ("metadata",), ("all",)]


def test_sessions_run_queries(spark):
    s = A.Session(spark, "user")
    assert s.run(lambda: spark.range(3)) and s.run(lambda: spark.range(2)) == spark.range(2).collect()


def test_plan_shape(spark):
    """A term search reads candidates from name and content postings by key, then only their records and positions, then a top-k."""
    from quarry import catalog

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    df = catalog.found(read, "that with -this")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("FileScan parquet") == 4 and plan.count("PushedFilters: [In(term, ") + plan.count("In(term, [that,this,with])") >= 2
    assert "LeftSemi, BuildRight" in plan and "Or(" in plan.split("DataFilters", 1)[1]
    assert search.ranked(catalog.doc_columns(read), "", None).count() == 0


@pytest.mark.parametrize("volumes", [[1], [2]])
def test_volume_scope(spark, volumes):
    from quarry import catalog

    rows = search.ranked(catalog.index.record_columns(catalog.parts(lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet"))), "bolt", None, deep=False, volumes=volumes)
    assert {r.volume for r in rows.collect()} == set(volumes)
