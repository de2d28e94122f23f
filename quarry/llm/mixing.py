"""Mixing sources to target weights by a low-discrepancy schedule.

Weights become cumulative intervals of [0, 1). Slot k of N = 2^m gets the van der Corput point of k (its bits reversed),
and the source whose interval holds the point; the first N points are the N grid points in another order, so each source
gets its share of slots to within one, and any stretch of the schedule is close to the shares. Slots are ranked within
their source. The documents of a source, shuffled by a hash, form a stream of words that repeats; the slot of rank r
takes the r-th of the source's equal blocks of that stream. What a document gives is the sum of its overlaps.

Null texts have size 0 and are never taken; null sources are one source, the last. Repeated rows count as documents of
their own. An empty table gives no rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, hash_bucket, materialise, running, small, spread

#: Words in a block, at most.
BLOCK_WORDS = 256
#: A source gives at most this many times its size.
REPEATS = 3
_CHUNK_BITS = 12


def sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """doc_id, source and size (words of the text)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))


def targets(rows: DataFrame, weights: tuple = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """One row a source: src (number from 0 by code point, null last), source, source_size, weight, target, docs.

    Targets share the sum of all sizes by weight; one that would pass repeats times its size stops there, and the excess
    is shared by weight among the rest, until none is above. Each round is one aggregate over the table of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    table = table.withColumn("src", F.row_number().over(order).cast("long") - 1)
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int")))
    table = materialise(table, "sources")
    cap = F.col("source_size") * float(repeats)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap if capped >= 0 else F.lit(False)
        total, stopped, weight, n = table.agg(F.sum("source_size"), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if not total or not weight or n == capped:
            break
        capped, level = n, (total - stopped) / weight
    return table.withColumn("target", F.least(cap, F.col("weight") * level))


def schedule(table: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot (order in the mix), src, rank (from 0 within the source), begin and end in the source's stream.

    A source whose interval holds no point but whose target is a word or more gets one slot of its own, after the rest.
    """
    total = table.agg(F.sum("target")).first()[0] or 0.0
    bits = max(1, (max(1, int(total) // block_words)).bit_length())
    points, n_src = 1 << bits, table.count()
    share = F.col("target") * (points / total if total else 0.0)
    up_to = F.sum(share).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda x: F.least(F.ceil(F.round(x, 6)), F.lit(points)).cast("long")
    spans = table.select("src", "target", at(up_to - share).alias("low"), at(up_to).alias("high"))
    spans = materialise(spans.withColumn("slots", F.greatest(F.col("high") - F.col("low"), F.when(F.col("target") >= 1, 1).otherwise(0)).cast("long")), "spans")

    cells = min(bits, (4 * n_src).bit_length())  # a cell of points meets an interval or two
    width = points >> cells
    wide = spans.filter("high > low").withColumn("cell", F.explode(F.expr(f"sequence(low div {width}L, (high - 1) div {width}L)")))
    reverse = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    slots = table.sparkSession.range(points).withColumnRenamed("id", "slot").withColumn("point", reverse)
    slots = slots.withColumn("cell", F.expr(f"point div {width}L")).join(small(wide, 5 * n_src + (1 << cells)), "cell").filter("point >= low and point < high")
    slots = slots.select("slot", "src", F.shiftright("slot", _CHUNK_BITS).alias("chunk"))
    ranked = running(slots, ["src"], "chunk", ["slot"], F.lit(1), "rank").select("slot", "src", "rank")
    alone = spans.filter("slots = 1 and high <= low").select((F.lit(points) + F.col("src")).alias("slot"), "src", F.lit(0).cast("long").alias("rank"))
    ranked = ranked.unionByName(alone).join(small(spans.select("src", "target", "slots"), n_src), "src")
    edge = lambda r: F.floor(F.floor("target") * r / F.col("slots")).cast("long")
    return ranked.select("slot", "src", "rank", edge(F.col("rank")).alias("begin"), edge(F.col("rank") + 1).alias("end"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (1, 2, 3), repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = 5) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = materialise(sized(docs, id_col, text, source), "sized")
    table = targets(rows, weights, repeats)
    n, n_src = table.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count(F.lit(1))).first()
    slots = schedule(table, block_words)

    key = table.select(F.col("source").alias("_source"), "src", "source_size", "target")
    rows = rows.join(small(key, n_src), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", hash_bucket(F.col("h"), spread(n)))
    shuffled = running(rows.filter("size > 0"), ["src"], "bucket", ["h", "doc_id", "size"], F.col("size"), "at")

    counts = table.sparkSession.createDataFrame([], "src long, slots long") if not n_src else slots.groupBy("src").agg(F.count(F.lit(1)).alias("slots"))
    passes = shuffled.join(small(counts, n_src), "src", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    passes = passes.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("from", F.col("pass") * F.col("source_size") + F.col("at"))
    passes = passes.withColumn("to", F.col("from") + F.col("size")).filter("slots > 0 and from < floor(target)")
    # The slots whose blocks meet [from, to); one more on either side, as edges are rounded down.
    rank = lambda x: F.floor(x * F.col("slots") / F.floor("target")).cast("long")
    ranks = F.sequence(F.greatest(rank(F.col("from")) - 1, F.lit(0)), F.least(rank(F.col("to") - 1) + 1, F.col("slots") - 1))
    pieces = passes.withColumn("rank", F.explode(ranks)).select("src", "at", "from", "to", "rank")
    part = F.greatest(F.least("to", "end") - F.greatest("from", "begin"), F.lit(0))
    taken = pieces.join(slots.select("src", "rank", "begin", "end"), ["src", "rank"]).groupBy("src", "at").agg(F.sum(part).alias("taken"))
    given = shuffled.join(taken, ["src", "at"], "left")
    none = rows.filter("size <= 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return given.select(*cols).unionByName(none.select(*cols))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows of docs: each as often as the mix takes it whole.

    The mix takes a source's shuffled documents in whole passes and one part of a pass, so all but the one document of a
    source at the end of that part are taken a whole number of times; that one is rounded. Documents without words stay
    once. Rows that share an id and a size are taken alike.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.lit(1)).cast("int")
    taken = mix(docs, id_col, text, source, **options).groupBy("doc_id", "size").agg(F.max(times).alias("_times"))
    taken = materialise(taken.filter("_times > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_times"), "times", most=docs.count())
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("_words", size).join(small(taken, taken.count()), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")))
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)


def op5_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
