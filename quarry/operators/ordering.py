"""Numbering in order without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """rows with their place (from 0) in order within their group; group may be empty.

    Rows are dealt into sampled ranges of (group, order); a range's rows are numbered alone, after the counts of the
    ranges before it. The counts are one row a range and group. Rows that tie in order are numbered either way.
    """
    dealt = stored(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)), F.col("_range") == F.col("_r"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(counts, same).withColumn(name, (F.col("_base") + F.col(name)).cast("long")).select(*rows.columns, name)
