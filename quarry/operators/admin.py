"""Administration of the index tables: versions, recovery plans, incremental builds, manifests and external metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.index import ID, content_postings
from quarry.operators.ordering import numbered
from quarry.operators.tables import delta

#: Records of one batch of an incremental build.
BATCH = 1024


# ---- Versions and recovery


def inspect(spark: SparkSession, path: str, current: str, legacy: tuple[str, ...] = ()) -> str:
    """current, legacy, unsupported, missing or unreadable: the schema of a stored table against those that are known."""
    try:
        stored = spark.read.parquet(path).schema
    except Exception as e:
        return "missing" if "PATH_NOT_FOUND" in str(e) else "unreadable"
    shape = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s)
    known = [shape(spark.createDataFrame([], s).schema) for s in (current, *legacy)]
    found = shape(stored)
    return "current" if found == known[0] else "legacy" if found in known[1:] else "unsupported"


def migrate(table: DataFrame, schema: str, path: str) -> None:
    """The table in a newer schema at a new path: missing columns are null, the old version stays as the backup."""
    target = table.sparkSession.createDataFrame([], schema).schema
    cols = [(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target]
    table.select(*cols).write.parquet(path)


def sidecar_plan(observed: DataFrame) -> DataFrame:
    """sidecar, action, reason by state (from inspect) and counts: columns sidecar, state, keys, expected_keys."""
    reason = F.when(F.col("state") == "missing", "missing").when(F.col("state") == "unreadable", "unreadable").when(F.col("state") == "unsupported", "unsupported-schema").when(F.col("state") == "legacy", "legacy-schema").when(F.col("keys") != F.col("expected_keys"), "count-mismatch")
    action = F.when(reason.isNull(), "keep").when(F.col("state") == "legacy", "migrate").otherwise("rebuild")
    return observed.select("sidecar", action.alias("action"), reason.alias("reason"))


def rebuild_route(records_state: Column, sidecars_bad: Column, content_bad: Column) -> Column:
    """ready, migrate, rebuild, recover or blocked for a whole archive."""
    return F.when(records_state.isin("missing", "unreadable", "unsupported"), "blocked").when(records_state == "legacy", "migrate").when(content_bad, "recover").when(sidecars_bad, "rebuild").otherwise("ready")


def index_recovery(observed: DataFrame) -> DataFrame:
    """root, action, reason of each persistent index, by what was observed of its records and state.

    Columns: root, records and state (current, missing, unreadable; state also unsupported), state_root, records_path,
    state_records_path, record_count, state_record_count, suspended. A suspended admission is ready whatever its records
    are, if its state can be read and is of this root and these records; then records are judged, then the state.
    """
    own = (F.col("state") == "current") & F.col("state_root").eqNullSafe(F.col("root")) & F.col("state_records_path").eqNullSafe(F.col("records_path"))
    reason = (
        F.when(own & F.coalesce("suspended", F.lit(False)) & (F.col("records") != "unreadable-path"), "suspended-admission").when(F.col("records") == "missing", "missing-records").when(F.col("records") != "current", "unreadable-records")
        .when(F.col("state") == "missing", "missing-state").when(F.col("state") == "unsupported", "unsupported-state-schema").when(F.col("state") != "current", "unreadable-state")
        .when(~F.col("state_root").eqNullSafe(F.col("root")), "root-mismatch").when(~F.col("state_records_path").eqNullSafe(F.col("records_path")), "records-path-mismatch")
        .when(~F.col("state_record_count").eqNullSafe(F.col("record_count")), "record-count-mismatch").otherwise("healthy")
    )
    action = (
        F.when(F.col("reason").isin("healthy", "suspended-admission"), "ready").when(F.col("reason") == "missing-records", "rebuild-records-and-state").when(F.col("reason") == "unreadable-records", "quarantine-records-and-rebuild")
        .when(F.col("reason") == "unsupported-state-schema", "migrate-state").otherwise("rebuild-state")
    )
    return observed.withColumn("reason", reason).select("root", action.alias("action"), "reason")


def compaction_action(reason: Column, io: Column, thermal: Column, battery: Column, activity: Column) -> Column:
    """defer, throttle or run for a compaction with this reason (of merge_plan, or index-density) under this pressure."""
    return (
        F.when(reason.isin("below-threshold", "no-segments") | (io == "saturated") | (thermal == "critical"), "defer")
        .when((io == "elevated") | (thermal == "serious") | (battery == "low") | (activity == "active"), "throttle").otherwise("run")
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def inspect_records(spark: SparkSession, path: str) -> DataFrame:
    """One row on a stored table of records: bytes, records, files, directories, symlinks, hidden, tagged."""
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    rows = spark.read.parquet(path)
    kinds = (("files", "file"), ("directories", "dir"), ("symlinks", "link"))
    return rows.agg(F.lit(stored_bytes(spark, path)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("records"), *(count(F.col("kind") == k, name) for name, k in kinds), count(F.col("hidden"), "hidden"), count(F.size("tags") > 0, "tagged"))


def inspect_content(spark: SparkSession, path: str) -> DataFrame:
    """One row on stored content postings: bytes, terms, postings, positions, records."""
    rows = spark.read.parquet(path)
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).alias("p")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum("p"), F.lit(0)).alias("positions"))
    ids = rows.select(*ID).distinct().agg(F.count(F.lit(1)).alias("records"))
    return terms.join(F.broadcast(ids), F.lit(True)).withColumn("bytes", F.lit(stored_bytes(spark, path)).cast("long"))  # a row each


def index_bytes(spark: SparkSession, path: str, target: int = 512) -> DataFrame:
    """table_name, bytes, bytes_per_record (integer division) of a stored index's tables and, named total, of all; dense: above the target."""
    names = [x.getPath().getName() for x in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if x.isDirectory()]
    sizes = {n: stored_bytes(spark, f"{path}/{n}") for n in sorted(names)}
    rows = spark.createDataFrame([*sizes.items(), ("total", sum(sizes.values()))], "table_name string, bytes long")
    records = spark.read.parquet(f"{path}/columns").count()
    return density(rows, records, "bytes").withColumn("dense", F.col("bytes_per_record") > target)


def manifest_recovery(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    """path, action, reason: manifest entries that segments (path, state, postings) bear out are kept, others dropped; strays are listed."""
    s = segments.select(F.col("path").alias("_path"), F.col("state"), F.col("postings").alias("_postings"))
    rows = manifest.join(s, manifest["path"] == s["_path"], "full_outer")
    reason = F.when(F.col("_path").isNull(), "missing").when(F.col("path").isNull(), "not-in-manifest").when(F.col("state") != "current", F.col("state")).when(F.col("postings") != F.col("_postings"), "count-mismatch")
    return rows.select(F.coalesce("path", "_path").alias("path"), F.when(reason.isNull(), "keep").when(F.col("path").isNull(), "ignore").otherwise("drop").alias("action"), reason.alias("reason"))


def cleanup_plan(retired: DataFrame, min_count: int = 1, min_bytes: int = 0, protect: DataFrame | None = None) -> DataFrame:
    """Retired segments (path, bytes) to delete once they are so many or so large together; protected paths stay."""
    rows = retired if protect is None else retired.join(protect.select("path"), "path", "left_anti")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows if n and (n >= min_count or size >= min_bytes) else rows.limit(0)


def checkpoint_row(spark: SparkSession, **state) -> DataFrame:
    """One row of scan progress or index state, columns by name."""
    return spark.createDataFrame([tuple(state[k] for k in sorted(state))], sorted(state))


# ---- Incremental builds


def incremental_segment(previous: DataFrame, current: DataFrame, content: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """Postings (with seq and batch) of new and changed records, and tombstones of changed and deleted ones."""
    changes = delta(previous, current, ID)
    todo = changes.filter(F.col("change").isin("new", "changed")).select(*ID)
    todo = numbered(todo, ["volume"], ["node"]).select(*ID, F.floor(F.col("nth") / BATCH).cast("long").alias("batch"))
    postings = content_postings(content.join(todo.select(*ID), ID, "left_semi")).join(todo, ID).withColumn("seq", F.lit(seq).cast("long"))
    return postings, changes.filter("tombstone").select(*ID, F.lit(seq).cast("long").alias("seq"))


def fifo(cache: DataFrame, most: int = 4096) -> DataFrame:
    """The newest entries of a cache by arrival."""
    return cache.orderBy(F.desc("arrival")).limit(most)


# ---- External metadata and volumes


def reconciled(primary: DataFrame, snapshot: DataFrame, key: str, fields: tuple) -> DataFrame:
    """key, field, primary_value, snapshot_value, state (same, differs, missing, extra) of each field."""
    s = snapshot.select(F.col(key), *(F.col(f).cast("string").alias(f"_s_{f}") for f in fields))
    rows = primary.select(F.col(key), *(F.col(f).cast("string").alias(f"_p_{f}") for f in fields)).join(s, key)
    each = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_p_{f}").alias("primary_value"), F.col(f"_s_{f}").alias("snapshot_value")) for f in fields))).alias("x")).select(key, "x.*")
    state = F.when(F.col("primary_value").eqNullSafe(F.col("snapshot_value")), "same").when(F.col("snapshot_value").isNull(), "missing").when(F.col("primary_value").isNull(), "extra").otherwise("differs")
    return each.withColumn("state", state)


def ingestion_plan(items: DataFrame, stale: Column, least_bps: int = 5000, cap: int = 512) -> DataFrame:
    """Items to take: a volume whose healthy share (in basis points) is too small is quarantined, others give so many rows in order."""
    health = items.groupBy("volume").agg((F.sum((~stale).cast("long")) * 10_000 / F.count(F.lit(1))).cast("long").alias("healthy_bps"))
    rows = items.filter(~stale).join(health, "volume").withColumn("rn", F.row_number().over(Window.partitionBy("volume").orderBy("path")))
    return rows.withColumn("action", F.when(F.col("healthy_bps") < least_bps, "quarantine").otherwise("ingest")).filter((F.col("action") == "quarantine") | (F.col("rn") <= cap))


def volume_changes(before: DataFrame, after: DataFrame, fields: tuple) -> DataFrame:
    """path, event (added, removed, changed), fields: a field changes when a known value is lost or differs."""
    b = before.select(F.col("path").alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in fields))
    a = after.select(F.col("path").alias("_a"), *(F.col(f).alias(f"_a_{f}") for f in fields))
    rows = b.join(a, b["_b"] == a["_a"], "full_outer")
    diff = F.array_compact(F.array(*(F.when(F.col(f"_b_{f}").isNotNull() & ~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), F.lit(f)) for f in fields)))
    event = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(diff) > 0, "changed")
    return rows.select(F.coalesce("_a", "_b").alias("path"), event.alias("event"), F.when(event == "changed", diff).alias("fields"), event.isin("removed", "changed").alias("invalidate_admission"), event.isin("added", "changed").alias("rescan")).filter("event is not null")


def invalidation(before: Column, after: Column) -> Column:
    """What a provider's state change does to what is cached of it: none, metadata or all."""
    return F.when(before.eqNullSafe(after), "none").when(after.isin("signed-out", "disabled"), "all").otherwise("metadata")


def outside(records: DataFrame, excluded: list[str]) -> DataFrame:
    """Records that are neither at nor below an excluded path."""
    tests = [(F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/")) for p in excluded]
    return records.filter(~reduce(lambda a, b: a | b, tests, F.lit(False)))


# ---- Telemetry


def summed(counters: DataFrame, group: str | None = None) -> DataFrame:
    """All numeric columns summed, by group or over all."""
    cols = [f.name for f in counters.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name != group]
    return (counters.groupBy(group) if group else counters).agg(*(F.sum(c).alias(c) for c in cols))


def counter_deltas(before: DataFrame, after: DataFrame, key: str, fields: tuple) -> DataFrame:
    """Growth of counters, never below 0."""
    b = before.select(key, *(F.col(f).alias(f"_b_{f}") for f in fields))
    return after.join(b, key, "left").select(key, *(F.greatest(F.col(f) - F.coalesce(f"_b_{f}", F.lit(0)), F.lit(0)).alias(f) for f in fields))


def resource_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """group, samples, total, peak and average (integer division)."""
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.sum(value).alias("total"), F.max(value).alias("peak"), F.floor(F.sum(value) / F.count(F.lit(1))).cast("long").alias("average"))


def density(footprint: DataFrame, records: int, *keep: str) -> DataFrame:
    """table_name, the kept columns, bytes_per_record (integer division) of tables with a column bytes."""
    return footprint.select("table_name", *keep, F.expr(f"bytes div {max(1, records)}L").alias("bytes_per_record"))


def cancelled(jobs: DataFrame, **match) -> DataFrame:
    """Jobs with state cancelled where all the given columns match."""
    hit = reduce(lambda a, kv: a & F.col(kv[0]).eqNullSafe(F.lit(kv[1])), match.items(), F.lit(True))
    return jobs.withColumn("state", F.when(hit, "cancelled").otherwise(F.col("state")))


def recovered_operations(journal: DataFrame, retry_failed: bool = False) -> DataFrame:
    """id, action (replay, resume, retry, none), started: from the last status of each operation."""
    last = journal.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "started").alias("started"))
    failed = "retry" if retry_failed else "none"
    return last.select("id", F.when(F.col("status") == "started", "replay").when(F.col("status") == "paused", "resume").when(F.col("status") == "failed", failed).otherwise("none").alias("action"), "started")


class Session:
    """A search session of one user: a new query cancels the one before it, wherever it has got to."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.turn = spark, name, 0

    def run(self, make):
        """Rows of make() under this turn's tag."""
        self.spark.interruptTag(f"{self.name}-{self.turn}")
        self.turn += 1
        tag = f"{self.name}-{self.turn}"
        self.spark.addTag(tag)
        try:
            return make().collect()
        finally:
            self.spark.removeTag(tag)
