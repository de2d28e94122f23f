import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.operators import tables as T
from quarry.sources import extract as E
from quarry.streaming import events as V


def event(seq, path, kind="modify", lane="background", **more):
    return {"seq": seq, "path": path, "kind": kind, "lane": lane, "from": "", "to": "", **more}


def drained(events, **options):
    q = V.Queue(**options)
    for e in events:
        q.add(e)
    return q, [(e["path"], e["kind"]) for e in q.drain()]


def test_queue_coalesces_and_drops():
    q, out = drained([event(1, "/a", "create"), event(2, "/a"), event(3, "/b", "metadata"), event(4, "/b"), event(5, "/a", "remove", "visible")])
    assert out == [("/a", "remove"), ("/a", "create"), ("/b", "modify")] and q.coalesced == 2 and not q.repair
    q, out = drained([event(k, f"/{k}") for k in range(5)], room=3)
    assert [p for p, _ in out] == ["/2", "/3", "/4"] and q.dropped == 2 and q.repair
    q, out = drained([event(1, "/a"), event(2, "/b", lane="visible"), event(3, "/r", "rescan")])
    assert out == [("/r", "rescan")] and q.dropped == 2 and q.repair
    q, out = drained([event(1, "/a", "rename", **{}) | {"from": "/a", "to": "/b"}, event(2, "/a", "rename") | {"from": "/a", "to": "/c"}])
    assert len(out) == 2


def test_drain_is_fair():
    _, out = drained([event(k, f"/v{k}", lane="visible") for k in range(5)] + [event(9 + k, f"/b{k}") for k in range(3)], burst=2)
    assert [p for p, _ in out] == ["/v0", "/v1", "/b0", "/v2", "/v3", "/b1", "/v4", "/b2"]


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(k, f"/p{k * 7 % 11}", ("create", "modify", "remove")[k % 3]) for k in range(60)]
    events = spark.createDataFrame(rows, "seq long, path string, kind string")
    for k in range(3):
        events.filter(F.floor(F.col("seq") / 20) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("seq long, path string, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = V.maintain(stream, str(tmp_path / "table"), str(tmp_path / "state"))
    q.awaitTermination(120)
    versions = sorted((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))
    got = spark.read.parquet(str(versions[-1]))
    last = lambda df: {r.path: r.seq for r in df.collect()}
    assert last(got) == last(V.latest_by_path(events)) and len(versions) == 3


def test_segments_keep_postings_of_the_tombstones_segment(spark):
    p = spark.createDataFrame([("a", 1, 1, 1, [1]), ("a", 1, 1, 2, [5]), ("b", 1, 1, 1, [2]), ("a", 1, 2, 1, [3])], "term string, volume long, node long, seq long, positions array<int>")
    t = spark.createDataFrame([(1, 1, 2)], "volume long, node long, seq long")
    assert sorted((r.term, r.node, r.positions) for r in T.compact(p, t).collect()) == [("a", 1, [5]), ("a", 2, [3])]


def test_merge_plans(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, bytes long, tombstones long")
    assert T.merge_plan(frame([(f"s{k}", 1000, 0) for k in range(3)]))["reason"] == "below-threshold"
    assert T.merge_plan(frame([(f"s{k}", 1000, 0) for k in range(4)]))["segments"] == ["s0", "s1", "s2", "s3"]
    got = T.merge_plan(frame([("big", 100 << 20, 2), ("s", 10, 0), ("c", 30 << 20, 0)]), "elevated")
    assert got["segments"] == ["big"] and got["action"] == "throttle" and got["tier"] == "cold"


@pytest.mark.parametrize("segments, rows", [(4, 2_000_000), (4, 7_000_000), (3, 100)])
def test_merge_plan_query_against_its_sql_beyond_a_merge(spark, tmp_path, segments, rows):
    """Fewer than four of a tier fit into one merge, or no tier has four: the query has its SQL's rows, the plan defers."""
    spark.range(segments * rows).selectExpr(f"cast(id % {segments} + 1 as int) l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["merge_plan"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.execute(catalog.ORACLE["merge_plan"])
    assert [d[0] for d in want.description] == got.columns and sorted(want.fetchall()) == sorted(map(tuple, got.collect()))
    plan = T.merge_plan(spark.createDataFrame([(f"s{k}", rows * 10, 0) for k in range(segments)], "path string, bytes long, tombstones long"))
    assert (plan["segments"], plan["bytes"], plan["reason"], plan["action"]) == ([], 0, "below-threshold", "defer")


def test_removals_take_subtrees(spark):
    r = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/ab", 3), ("/c", 4)], "path string, node long")
    e = spark.createDataFrame([(1, "remove", "/a", 0), (2, "modify", "/c", 9), (3, "create", "/n", 5)], "seq long, kind string, path string, node long")
    assert sorted(tuple(x) for x in V.applied(r, e).collect()) == [("/ab", 3), ("/c", 9), ("/n", 5)]


def test_resume_plan(spark):
    rows = spark.createDataFrame([("a", 7, 1, 1, 1, 1, 1, 1, 1, 1, False), ("b", None, 1, 1, 1, 1, 1, 1, 1, 1, False), ("c", 7, 1, 2, 1, 1, 1, 1, 1, 1, False), ("d", 7, 1, 1, 1, 1, 1, 1, 1, 1, True)], "stream string, last_event long, schema int, current_schema int, volume int, current_volume int, mount int, current_mount int, epoch int, current_epoch int, repair boolean")
    assert {r.stream: (r.action, r.reason, r.from_event) for r in V.resume_plan(rows).collect()} == {"a": ("continue", None, 8), "b": ("rescan", "missing-cursor", None), "c": ("rescan", "schema", None), "d": ("rescan", "repair-required", None)}


def test_quarantine_and_cache(spark):
    files = spark.sql("select '/a.txt' path, 5L length, timestamp'2024-01-01' modificationTime union all select '/b.pdf', 6L, timestamp'2024-01-02'")
    key = files.select(E.quarantine_key(files).alias("key"), "path").filter("path = '/b.pdf'").first().key
    bad = spark.createDataFrame([(key, 3)], "key string, failures long")
    assert [r.path for r in E.due(files, bad).collect()] == ["/a.txt"]
    hits, misses = E.cached(files, spark.createDataFrame([(key, "t")], "key string, text string"))
    assert (hits.count(), misses.count()) == (1, 1)
    queue = spark.createDataFrame([("/x.pdf", "image-only-pdf"), ("/Screenshot 1.png", "binary"), ("/y.png", "binary")], "path string, reason string")
    assert sorted(r.path for r in E.ocr_queue(queue).collect()) == ["/Screenshot 1.png", "/x.pdf"]
