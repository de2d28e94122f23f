"""Plans and reports whose rules have cases that the catalog's tables do not meet."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import admin as A
from quarry.operators import index
from quarry.operators import tables as T
from quarry.operators.ordering import numbered
from quarry.operators.storage import fresh_path
from quarry.sources import tree
from quarry.streaming import events as V

OBSERVED = "root string, records string, state string, state_root string, records_path string, state_records_path string, record_count long, state_record_count long, suspended boolean"


@pytest.mark.parametrize(
    ("row", "action", "reason"),
    [
        (("/", "current", "current", "/", "r", "r", 3, 3, False), "ready", "healthy"), (("/", "missing", "current", "/", "r", "r", None, 3, True), "ready", "suspended-admission"),
        (("/", "missing", "current", "/x", "r", "r", None, 3, True), "rebuild-records-and-state", "missing-records"), (("/", "unreadable", "missing", None, "r", None, None, None, None), "quarantine-records-and-rebuild", "unreadable-records"),
        (("/", "current", "missing", None, "r", None, 3, None, None), "rebuild-state", "missing-state"), (("/", "current", "unsupported", None, "r", None, 3, None, None), "migrate-state", "unsupported-state-schema"),
        (("/", "current", "current", None, "r", "r", 3, 3, None), "rebuild-state", "root-mismatch"), (("/", "current", "current", "/", "r", "s", 3, 3, None), "rebuild-state", "records-path-mismatch"), (("/", "current", "current", "/", "r", "r", 3, None, None), "rebuild-state", "record-count-mismatch"),
    ],
)
def test_index_recovery(spark, row, action, reason):
    assert [tuple(r) for r in A.index_recovery(spark.createDataFrame([row], OBSERVED)).collect()] == [("/", action, reason)]


RECORDS = "volume long, node long, parent_node long, path string, name string, len long"


def test_paired_renames(spark):
    rows = spark.createDataFrame([(1, 1, 9, "/a", "a", 0), (1, 2, 1, "/a/x", "x", 5), (1, 3, 9, "/ab", "ab", 7), (1, 4, None, None, None, None)], RECORDS)
    fresh = spark.createDataFrame([(1, 77, 8, "/b", "b", 42)], RECORDS)
    after, report = V.correlated_rename(rows, "/a", "/b", fresh)
    assert {(r.node, r.parent_node, r.path, r.name, r.len) for r in after.collect()} == {(1, 9, "/b", "b", 42), (2, 1, "/b/x", "x", 5), (3, 9, "/ab", "ab", 7), (4, None, None, None, None)}
    assert tuple(report.first()) == ("/a", "/b", 2, 2, 2)
    after, report = V.correlated_rename(rows, "/nothing", "/b", fresh)
    assert after.count() == 5 and tuple(report.first())[2:] == (0, 1, 0)
    after, report = V.correlated_rename(rows, "/a", "/b", fresh.limit(0))
    assert after.count() == 2 and tuple(report.first())[2:] == (2, 0, 0)


def test_trash_and_jobs(spark):
    rows = spark.createDataFrame([("B", "/2", 5, "p1"), ("a", "/1", None, "p2"), ("c", "/1", 9, "p3")], "name string, original_path string, deleted_at long, path string")
    order = lambda sort: [r.path for r in T.trash_view(rows, sort).collect()]
    assert (order("deleted"), order("name"), order("location")) == (["p3", "p1", "p2"], ["p2", "p1", "p3"], ["p2", "p3", "p1"])
    jobs = spark.createDataFrame([(1, 5), (2, 9), (0, 9)], "id long, priority int")
    assert [r.id for r in T.job_order(jobs).collect()] == [0, 2, 1]


def test_numbered_over_many_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g")).repartition(9)
    got = numbered(rows, ["g"], ["x"]).collect()
    for g in (None, "hot"):
        mine = sorted((r.x, r.nth) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert sorted(r.nth for r in numbered(rows, [], ["x"], "nth").collect()) == list(range(3000))


def test_inspection_and_bytes(spark):
    columns = index.record_columns(spark.createDataFrame([(1, k, f"/d/{k}", f"n{k} alpha", "file", 1, None, None, None, ["t"], None) for k in range(20)], "volume long, node long, path string, name string, kind string, len long, created timestamp, modified timestamp, changed timestamp, tags array<string>, finder_comment string"))
    path = fresh_path(spark, "inspected")
    index.write_index(path, columns, spark.createDataFrame([(1, 1, "b a b"), (1, 2, "a")], "volume long, node long, text string"))
    assert tuple(A.inspect_content(spark, f"{path}/content").select("terms", "postings", "positions", "records").first()) == (2, 3, 4, 2)
    sizes = {r.table_name: r for r in A.index_bytes(spark, path, target=10).collect()}
    on_disk = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if not f.endswith(".crc"))
    assert sizes["total"].bytes == sum(r.bytes for n, r in sizes.items() if n != "total") == on_disk
    assert sizes["total"].bytes_per_record == on_disk // 20 and sizes["total"].dense


def test_extended_attributes(spark, tmp_path):
    file = tmp_path / "f.txt"
    file.write_text("x")
    plain = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}[str(file)]
    assert plain.tags == [] and plain.finder_comment is None
    try:
        os.setxattr(file, "user.xdg.tags", b"red, blue")
        os.setxattr(file, "user.xdg.comment", b"about it")
    except OSError:
        pytest.skip("no extended attributes here")
    marked = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}[str(file)]
    assert (marked.tags, marked.finder_comment) == (["red", "blue"], "about it") and marked.xattrs_digest != plain.xattrs_digest
