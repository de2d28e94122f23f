"""File events: a coalescing queue, fair draining, subtree renames and repair plans; in batch and as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X

QUEUED = "slot long, seq long, lane string, path string, kind string, dropped long, coalesced long, repair boolean"


class Queue:
    """Two lanes of pending events with room for so many: the ordered fold that both forms share."""

    def __init__(self, room: int = 1024, burst: int = 8):
        self.room, self.burst = room, burst
        self.pending: dict[str, dict[str, dict]] = {"visible": {}, "background": {}}
        self.dropped = self.coalesced = 0
        self.repair = False

    def _key(self, e: dict) -> str:
        return f"{e['from']}->{e['to']}" if e["kind"] == "rename" else e["path"]

    def size(self) -> int:
        return sum(map(len, self.pending.values()))

    def _drop_first(self, lane: str) -> None:
        self.pending[lane].pop(next(iter(self.pending[lane])))
        self.dropped += 1
        self.repair = True

    def add(self, e: dict) -> None:
        lane = self.pending[e["lane"]]
        key = self._key(e)
        if e["kind"] == "rescan":
            self.dropped += self.size()
            self.pending = {"visible": {}, "background": {key: e}}
            self.repair = True
        elif key in lane:
            old, new = lane[key]["kind"], e["kind"]
            kind = "create" if old == "create" and new in ("metadata", "modify") else "modify" if {old, new} == {"metadata", "modify"} else new
            lane[key] = {**e, "kind": kind}
            self.coalesced += 1
        else:
            if self.size() >= self.room:
                if self.pending["background"]:
                    self._drop_first("background")
                elif e["lane"] == "visible" and len(self.pending["visible"]) > self.burst:
                    self._drop_first("visible")
            if self.size() >= self.room:
                self.dropped += 1
                self.repair = True
            else:
                lane[key] = e

    def drain(self, most: int | None = None) -> list[dict]:
        out, credit = [], 0
        seen, rest = list(self.pending["visible"].values()), list(self.pending["background"].values())
        while (seen or rest) and (most is None or len(out) < most):
            if seen and (credit < self.burst or not rest):
                out.append(seen.pop(0))
                credit += 1
            else:
                out.append(rest.pop(0))
                credit = 0
        self.pending = {"visible": {self._key(e): e for e in seen}, "background": {self._key(e): e for e in rest}}
        return out


def folded(events: DataFrame, key: str, room: int = 1024, burst: int = 8) -> DataFrame:
    """The drained queue of each key (a volume or stream): slot is the place in draining order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        q = Queue(room, burst)
        for e in pdf.sort_values("seq").to_dict("records"):
            q.add(e)
        dropped, coalesced, repair = q.dropped, q.coalesced, q.repair
        rows = [(pdf[key].iloc[0], k, e["seq"], e["lane"], e["path"], e["kind"], dropped, coalesced, repair) for k, e in enumerate(q.drain())]
        return pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in QUEUED.split(", "))])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandas(fold, f"{key} {kind}, {QUEUED}")


def latest_by_path(events: DataFrame) -> DataFrame:
    """path, kind, seq: a create stays a create under later changes of its file; else the last kind counts."""
    last = events.groupBy("path").agg(F.max_by("kind", "seq").alias("last"), F.min_by("kind", "seq").alias("first"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("events"))
    kind = F.when((F.col("first") == "create") & F.col("last").isin("metadata", "modify"), "create").otherwise(F.col("last"))
    return last.select("path", kind.alias("kind"), "seq", "events")


def renamed_subtree(records: DataFrame, old: str, new: str) -> DataFrame:
    """records with the subtree at old moved to new; ids stay."""
    path = X.renamed(F.col("path"), F.lit(old), F.lit(new))
    return records.withColumn("path", path).withColumn("name", X.basename(F.col("path")))


def correlated_rename(records: DataFrame, old: str, new: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records after a rename whose two halves are paired, and one row on it: removed, inserted, preserved.

    The subtree at old moves to new and keeps its ids; its root takes the fresh record of new (at most one row of the
    records' columns) but keeps its id and parent. Without a record at or below old the fresh one is inserted; without a
    fresh one (new is gone again) the subtree is removed.
    """
    inside = (F.col("path") == old) | F.startswith("path", F.lit(old.rstrip("/") + "/"))
    inside = F.coalesce(inside, F.lit(False))
    keep, moved = records.filter(~inside), renamed_subtree(records.filter(inside), old, new)
    removed, has_fresh = moved.count(), bool(fresh.take(1))
    fresh = fresh.select(*records.columns)
    if not removed:
        after, inserted = keep.unionByName(fresh), int(has_fresh)
    elif not has_fresh:
        after, inserted = keep, 0
    else:
        root = moved.filter(F.col("path") == new)
        ids = [c for c in ("volume", "node", "parent_node") if c in records.columns]
        at = root.select(*(F.col(c).alias(f"_{c}") for c in ids)).limit(1)
        renewed = fresh.drop(*ids).join(F.broadcast(at), F.lit(True)).withColumnsRenamed({f"_{c}": c for c in ids}).select(*records.columns)  # a row each
        after, inserted = keep.unionByName(moved.filter(F.col("path") != new)).unionByName(renewed), removed
    report = records.sparkSession.createDataFrame([(old, new, removed, inserted, inserted if removed else 0)], "`from` string, `to` string, removed long, inserted long, preserved long")
    return after, report


def applied(records: DataFrame, events: DataFrame) -> DataFrame:
    """records after a batch of events (seq, kind, path, and the record's fields for upserts), last event by path wins."""
    last = events.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).filter("_rn = 1").drop("_rn")
    # A removed folder takes everything below it: ancestors of a record are few, so this is an equi-join on them.
    gone = last.filter("kind = 'remove'").select(F.col("path").alias("_gone"))
    above = records.select("path", F.explode(F.concat(X.ancestors(F.col("path")), F.array("path"))).alias("_gone")).join(gone, "_gone", "left_semi").select("path").distinct()
    keep = records.join(above, "path", "left_anti").join(last.select("path"), "path", "left_anti")
    changed = last.filter("kind <> 'remove'").select(*records.columns)
    return keep.unionByName(changed)


def repair_plan(events: DataFrame) -> DataFrame:
    """path: subtrees to scan again, none below another; events have path and repair."""
    wanted = events.filter("repair").select("path").distinct()
    covered = wanted.select("path", F.explode(X.ancestors(F.col("path"))).alias("above")).join(wanted.select(F.col("path").alias("above")), "above", "left_semi").select("path")
    return wanted.join(covered, "path", "left_anti")


def resume_plan(cursors) -> DataFrame:
    """stream, action, reason by a when chain over cursor rows (stored and current schema, volume, mount, epoch, repair)."""
    reason = (
        F.when(F.col("last_event").isNull(), "missing-cursor").when(F.col("schema") != F.col("current_schema"), "schema").when(F.col("volume") != F.col("current_volume"), "volume")
        .when(F.col("mount") != F.col("current_mount"), "mount").when(F.col("epoch") != F.col("current_epoch"), "epoch").when(F.col("repair"), "repair-required")
    )
    return cursors.select("stream", F.when(reason.isNull(), "continue").otherwise("rescan").alias("action"), reason.alias("reason"), F.when(reason.isNull(), F.col("last_event") + 1).alias("from_event"))


def newest_version(spark, table_path: str, epoch: int) -> int | None:
    """The newest version before this epoch, if any; an epoch without rows leaves none behind on some sources."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [x.getPath().getName()[1:] for x in found]
    return max((int(n) for n in names if n.isdigit() and int(n) < epoch), default=None)


def maintain(stream: DataFrame, table_path: str, checkpoint: str):
    """A running query that keeps the latest kind of each path as a table, by merging each micro-batch into it."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("path", "kind", "seq")
        version = newest_version(spark, table_path, epoch)
        # An error here fails the batch, which is then tried again: an old table that can't be read isn't an empty one.
        old = new.limit(0) if version is None else spark.read.parquet(f"{table_path}/v{version}").select("path", "kind", "seq")
        latest_by_path(old.unionByName(new)).select("path", "kind", "seq").write.mode("overwrite").parquet(f"{table_path}/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
