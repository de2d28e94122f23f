"""Analytics over the engine's own tables: deltas, segments, jobs, operations, telemetry, views and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import numbered

ID = ["volume", "node"]

# ---- Incremental content index

DELTA_SIGNATURE = ("kind", "len", "modified", "changed", "version")


def delta(previous: DataFrame, current: DataFrame, key: list[str], signature: tuple = DELTA_SIGNATURE) -> DataFrame:
    """key, change (new, changed, deleted, unchanged) and tombstone: full outer join of two versions, null-safe."""
    p = previous.select(*(F.col(k).alias(f"p_{k}") for k in key), *(F.col(c).alias(f"p_{c}_s") for c in signature), F.lit(True).alias("_p"))
    c = current.select(*(F.col(k).alias(f"c_{k}") for k in key), *(F.col(x).alias(f"c_{x}_s") for x in signature), F.lit(True).alias("_c"))
    on = [F.col(f"p_{k}") == F.col(f"c_{k}") for k in key]
    same = F.lit(True)
    for x in signature:
        same = same & F.col(f"p_{x}_s").eqNullSafe(F.col(f"c_{x}_s"))
    change = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    was_file = F.col("p_kind_s") == "file" if "kind" in signature else F.lit(True)
    rows = p.join(c, on, "full_outer").select(*(F.coalesce(f"c_{k}", f"p_{k}").alias(k) for k in key), change.alias("change"), F.coalesce(was_file, F.lit(False)).alias("_file"))
    return rows.withColumn("tombstone", F.col("change").isin("changed", "deleted") & F.col("_file")).drop("_file")


def compact(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """term, volume, node, positions of segments (column seq) in order: a tombstone removes postings of earlier segments only."""
    last = tombstones.groupBy(*ID).agg(F.max("seq").alias("_gone"))
    left = postings.join(last, ID, "left").filter(F.col("_gone").isNull() | (F.col("seq") >= F.col("_gone")))
    return left.groupBy("term", *ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


# Bounds of the tiers and of a merge.
HOT_BYTES, WARM_BYTES, MIN_MERGE, MAX_MERGE, MERGE_BYTES = 1 << 20, 16 << 20, 4, 16, 64 << 20


def tier(size: Column) -> Column:
    return F.when(size <= HOT_BYTES, "hot").when(size <= WARM_BYTES, "warm").otherwise("cold")


def merge_plan(manifest: DataFrame, pressure: str = "none", least: int = MIN_MERGE) -> dict:
    """What to merge of a segment manifest (path, bytes, tombstones), and whether: the manifest is small and planned on the driver.

    Segments with tombstones go first; the rest come from one tier of MIN_MERGE or more, smallest first, while the bytes
    fit. Without tombstones nothing is merged if fewer than least fit.
    """
    order = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    rows = manifest.withColumn("tier", tier(F.col("bytes"))).orderBy((F.col("tombstones") == 0), order, "bytes", "path").collect()
    marked = [r for r in rows if r.tombstones]
    counts = {t: sum(r.tier == t and not r.tombstones for r in rows) for t in ("hot", "warm", "cold")}
    wanted = marked[0].tier if marked else next((t for t, n in counts.items() if n >= MIN_MERGE), None)
    chosen, size = [], 0
    for r in rows:
        if not r.tombstones and r.tier != wanted or len(chosen) == MAX_MERGE:
            continue
        if not r.tombstones and size + r.bytes > MERGE_BYTES:
            continue
        chosen.append(r.path)
        size += r.bytes
    if not marked and len(chosen) < least:
        chosen, size = [], 0
    reason = "no-segments" if not rows else "tombstones" if marked else "tier-pressure" if chosen else "below-threshold"
    action = "defer" if not chosen or pressure == "saturated" else "throttle" if pressure == "elevated" else "run"
    return {"segments": sorted(chosen), "retained": sorted(r.path for r in rows if r.path not in chosen), "bytes": size, "tier": wanted or "hot", "reason": reason, "action": action, "max_bytes": {"run": MERGE_BYTES, "throttle": MERGE_BYTES // 2, "defer": 0}[action]}


# ---- Jobs and operations

CLASSES = ("interactive", "visible", "background", "maintenance", "idle")
QUOTAS = (3, 3, 1, 1, 1)
# Words of a failure's message, in this precedence.
FAILURES = (
    ("offline-volume", "offline|not mounted|unmounted|ejected|network is down|network is unreachable|device not configured|stale file handle"),
    ("permission", "permission|denied|not permitted|tcc"),
    ("missing-file", "missing|not found|no such file"),
    ("corrupt-file", "corrupt|checksum|crc|malformed"),
    ("transient", "temporary|transient|timed out|timeout|busy|again|resource temporarily unavailable|interrupted system call|source does not exist"),
)


def failure_class(message: Column) -> Column:
    out = F
    for name, words in FAILURES:
        out = out.when(F.lower(message).rlike(words), name)
    return out.otherwise("permanent")


def retry_delay(attempts: Column, base: Column) -> Column:
    """base doubled for each attempt after the first, eight times at most."""
    return (base * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(8)))).cast("long")


def latest_state(journal: DataFrame, keep_messages: bool = True) -> DataFrame:
    """id, status of the last row by seq, attempts, and its message."""
    out = journal.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("attempt").alias("attempts"), F.max_by(F.coalesce("message", F.lit("")), "seq").alias("message"))
    return out if keep_messages else out.drop("message")


def recoverable(journal: DataFrame, most: int = 3) -> DataFrame:
    """id, attempts, failure, decision (retry, give-up, resume, done) of each job."""
    rows = latest_state(journal).withColumn("failure", F.when(F.col("status") == "failed", failure_class(F.col("message"))))
    again = F.col("failure").isin("transient", "offline-volume") & (F.col("attempts") < most)
    decision = F.when(F.col("status") == "failed", F.when(again, "retry").otherwise("give-up")).when(F.col("status").isin("started", "paused", "running", "queued"), "resume").otherwise("done")
    return rows.select("id", "attempts", "failure", decision.alias("decision"))


def fair_order(jobs: DataFrame) -> DataFrame:
    """jobs (class, arrival) with turn: rounds over the classes, each taking its quota in order of arrival."""
    rank = F.coalesce(*(F.when(F.col("class") == c, k) for k, c in enumerate(CLASSES)), F.lit(len(CLASSES)))
    quota = F.coalesce(*(F.when(F.col("class") == c, q) for c, q in zip(CLASSES, QUOTAS, strict=True)), F.lit(1))
    return numbered(jobs, ["class"], ["arrival"]).withColumns({"round": F.floor(F.col("nth") / quota).cast("long"), "class_rank": rank})


def blocked(jobs: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """id, missing and failed dependencies (sorted) of jobs that wait; completed and failed have a column id."""
    deps = jobs.select("id", F.explode("dependencies").alias("dep")).join(completed.select(F.col("id").alias("dep")), "dep", "left_anti")
    deps = deps.join(failed.select(F.col("id").alias("dep"), F.lit(True).alias("bad")), "dep", "left")
    return deps.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("bad").isNull(), F.col("dep")))).alias("missing"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("dep")))).alias("failed"))


def restored(progress: DataFrame, payloads: DataFrame) -> DataFrame:
    """id, state (planned and running become paused), readiness: ready or missing-payload."""
    rows = progress.join(payloads.select("id", F.lit(True).alias("_has")), "id", "left")
    state = F.when(F.col("state").isin("planned", "running"), "paused").otherwise(F.col("state"))
    detail = F.when(F.col("state").isin("planned", "running"), F.concat(F.lit("interrupted:"), F.col("detail"))).otherwise(F.col("detail"))
    return rows.select("id", state.alias("state"), detail.alias("detail"), F.when(F.col("_has"), "ready").otherwise("missing-payload").alias("readiness"))


def conflicts(operations: DataFrame, targets: DataFrame, policy: str = "keep-both", overrides: DataFrame | None = None) -> DataFrame:
    """to, conflict, policy: targets that exist, and what to do with each; overrides (to, policy) win over the default."""
    rows = operations.join(targets.select(F.col("path").alias("to"), F.col("kind").alias("_kind")).distinct(), "to", "left")
    if overrides is not None:
        rows = rows.join(overrides.select("to", F.col("policy").alias("_own")), "to", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("string"))
    return rows.select("to", F.col("_kind").isNotNull().alias("conflict"), F.when(F.col("_kind").isNotNull(), F.coalesce("_own", F.lit(policy))).alias("policy"))


def pressure_decision(thermal: Column, battery: Column, activity: Column, io: Column) -> Column:
    """run, throttle or defer."""
    stop = (thermal == "critical") | (io == "saturated")
    slow = (thermal == "serious") | (battery == "low") | (activity == "active") | (io == "elevated")
    return F.when(stop, "defer").when(slow, "throttle").otherwise("run")


# ---- Telemetry

# Upper bounds of the latency buckets in microseconds.
LATENCY_US = (100, 250, 500, 1_000, 2_000, 4_000, 8_000, 12_000, 16_000, 25_000, 33_000, 50_000, 75_000, 100_000, 150_000, 250_000, 500_000, 1_000_000, 2_000_000, 4_000_000, 8_000_000, 16_000_000, 32_000_000)


def bucket_of(us: Column) -> Column:
    """The upper bound of a duration's bucket; null beyond the last."""
    out = F
    for b in LATENCY_US:
        out = out.when(us <= b, b)
    return out.otherwise(F.lit(None)).cast("long")


def histogram(rows: DataFrame, group: str, us: str) -> DataFrame:
    """group, bound (null: overflow), n."""
    return rows.withColumn("bound", bucket_of(F.col(us))).groupBy(group, "bound").agg(F.count(F.lit(1)).alias("n"))


def bucket_percentiles(rows: DataFrame, group: str, us: str, percents: tuple = (50, 95, 99)) -> DataFrame:
    """group, p50, …: the bound of the bucket that holds rank max(1, ceil(n p / 100)), or the maximum in the overflow."""
    counts = rows.withColumn("bound", F.coalesce(bucket_of(F.col(us)), F.lit(1 << 60))).groupBy(group, "bound").agg(F.count(F.lit(1)).alias("n"), F.max(us).alias("top"))
    w = Window.partitionBy(group).orderBy("bound")
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("all") * p / 100))
    shown = F.when(F.col("bound") == 1 << 60, F.col("top")).otherwise(F.col("bound"))
    return counts.groupBy(group).agg(*(F.min_by(shown, F.when(F.col("upto") >= rank(p), F.col("bound"))).cast("long").alias(f"p{p}") for p in percents))


def violations(observed: DataFrame, budgets: DataFrame) -> DataFrame:
    """metric, quantile, observed, budget of what is over; both sides have metric, quantile, value; what wasn't observed is passed over."""
    return observed.withColumnRenamed("value", "observed").join(budgets.withColumnRenamed("value", "budget"), ["metric", "quantile"]).filter("observed > budget")


def throughput_class(size: Column, ns: Column) -> Column:
    rate = (size.cast("decimal(38,0)") * 1_000_000_000 / F.greatest(ns, F.lit(1))).cast("double")
    return F.when(size == 0, F.lit(None)).when(rate < 16 << 20, "slow").when(rate < 96 << 20, "constrained").otherwise("full-speed")


def gaps(events: DataFrame, cursor: int | None = None) -> DataFrame:
    """seq, event_id, expected where an event id jumps beyond the one before it."""
    before = F.lag("event_id").over(Window.partitionBy("stream").orderBy("seq"))
    if cursor is not None:
        before = F.coalesce(before, F.lit(cursor))
    return events.withColumn("expected", before + 1).filter(F.col("event_id") > F.col("expected")).select("stream", "seq", "event_id", "expected")


def longest_run(rows: DataFrame, group: str, order: str, hit: Column) -> DataFrame:
    """group, longest: the longest stretch of rows without a hit."""
    w = Window.partitionBy(group).orderBy(order)
    islands = rows.withColumn("_hit", hit.cast("int")).withColumn("_island", F.sum("_hit").over(w)).filter("_hit = 0").groupBy(group, "_island").agg(F.count(F.lit(1)).alias("n"))
    return islands.groupBy(group).agg(F.max("n").alias("longest"))


def capped(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first rows of each group, in order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= most)


# ---- Views

SORTS = {
    "name": [(F.desc, "_dir"), (F.asc, "_lower"), (F.asc, "path")], "kind": [(F.asc, "kind"), (F.asc, "_lower"), (F.asc, "path")],
    "modified": [(F.desc_nulls_last, "modified"), (F.asc, "path")], "size": [(F.desc, "len"), (F.asc, "path")],
}


def view(records: DataFrame, sort: str = "name", show_hidden: bool = False, start: int = 0, rows: int | None = None) -> DataFrame:
    """A window of a sorted listing."""
    out = records if show_hidden else records.filter(~F.col("hidden"))
    out = out.withColumns({"_dir": F.col("kind") == "dir", "_lower": F.lower("name")}).orderBy(*(f(c) for f, c in SORTS[sort])).drop("_dir", "_lower")
    out = out.offset(start) if start else out
    return out if rows is None else out.limit(rows)


TRASH = {"deleted": [(F.desc_nulls_last, "deleted_at"), (F.asc, "_lower")], "name": [(F.asc, "_lower")], "location": [(F.asc_nulls_first, "original_path"), (F.asc, "_lower")]}


def trash_view(rows: DataFrame, sort: str = "deleted", ties: str = "path") -> DataFrame:
    """Trash rows (name, original_path, deleted_at) by time of deletion, newest first, by name or by original location."""
    return rows.withColumn("_lower", F.lower("name")).orderBy(*(f(c) for f, c in TRASH[sort]), ties).drop("_lower")


def job_order(jobs: DataFrame) -> DataFrame:
    """Jobs (priority, id) in the order they run: the highest priority first, then the least id."""
    return jobs.orderBy(F.desc("priority"), "id")


def grouped_window(hits: DataFrame, key: str) -> DataFrame:
    """group_key, n, first_index of a visible window (column index)."""
    return hits.groupBy(F.col(key).alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first_index"))


def merged_batches(batches: DataFrame) -> DataFrame:
    """The best hit of each id over batches (columns batch, score): the first batch wins ties."""
    best = F.row_number().over(Window.partitionBy(*ID).orderBy(F.desc("score"), "batch"))
    return batches.withColumn("_rn", best).filter("_rn = 1").drop("_rn")


def privacy_export(table: DataFrame, blocked_columns: tuple) -> DataFrame:
    return table.drop(*blocked_columns)


def plan_totals(records: DataFrame, root: str) -> DataFrame:
    """items and bytes below a root; links are not followed."""
    below = records.filter((F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/")))
    return below.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("len"))), F.lit(0)).alias("bytes"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: tuple) -> DataFrame:
    """key and the names of the fields that differ, null-safe; rows without a difference are left out."""
    b = before.select(F.col(key), *(F.col(f).alias(f"_b_{f}") for f in fields))
    rows = after.join(b, key)
    diff = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields)))
    return rows.select(key, diff.alias("fields")).filter(F.size("fields") > 0)


def volume_policy(volumes: DataFrame) -> DataFrame:
    """path, action (include, defer, disable) and throttle by mount state, reachability and class."""
    action = F.when(F.col("mount_state") != "mounted", "disable").when(~F.coalesce("reachable", F.lit(True)), "defer").when(F.col("class").isin("network", "cloud"), "defer").otherwise("include")
    throttle = F.when(F.col("class") == "internal", 100).when(F.col("class") == "external", 50).otherwise(25)
    return volumes.select("path", action.alias("action"), F.when(action == "include", throttle).otherwise(0).cast("long").alias("throttle"))


def admitted(items: DataFrame, top: int, bottom: int, margin: int, visible: int = 64, prefetch: int = 128) -> DataFrame:
    """Previews by place: visible, prefetch or background; caps by class in order of y, x, generation; one row a key, the newest."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("generation")))
    rows = items.withColumn("_n", newest).filter("_n = 1").drop("_n")
    lane = F.when((F.col("y") + F.col("height") > top) & (F.col("y") < bottom), "visible").when((F.col("y") + F.col("height") > top - margin) & (F.col("y") < bottom + margin), "prefetch").otherwise("background")
    rows = rows.withColumn("lane", lane)
    by = Window.partitionBy("lane").orderBy("y", "x", "generation")
    first = lambda name, most: rows.filter(F.col("lane") == name).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most)  # noqa: E731  each task sends its first ones only
    rest = rows.filter("lane = 'background'").withColumn("rn", F.lit(None).cast("int"))
    return first("visible", visible).unionByName(first("prefetch", prefetch)).unionByName(rest)
