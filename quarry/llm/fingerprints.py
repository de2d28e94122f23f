"""Document fingerprints: canonical exact digests, in Spark's own expressions.

A text is normalised (NFKC), case-folded, normalised again, and its white space runs become single spaces; the digest is
128 bits of xxhash64 under two seeds. Rows that share a digest are compared byte by byte (least against greatest
canonical text of the bucket, a partial aggregate); where a bucket holds different texts, the fingerprint gets the
SHA-256 of the canonical text, so that different texts never share one. Edited texts join the comparison by that SHA-256.

Null and empty texts are the empty text; repeated rows and copies share a fingerprint; an empty table gives no rows.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small, spread

_SPACE = r"(?U)[\s\p{Z}\p{Cc}]+"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC, white space folded and trimmed; null gives ''. ICU's own functions, called in the JVM."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.btrim(F.regexp_replace(compose(fold), _SPACE, " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: xxhash64 of the canonical text under two seeds."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2))))


def split_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Digests (column digest) that different canonical texts share: the byte comparison inside equal buckets.

    Only buckets of two rows or more are compared, and each task sends two texts a bucket at most.
    """
    rows = docs.select(canonical(F.col(text)).alias("canon")).withColumn("digest", digest(F.col("canon")))
    repeated = materialise(rows.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    again = rows.join(small(repeated, repeated.count()), "digest", "left_semi")
    return again.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low <> high").select("digest")


def fingerprint(digest_: Column, canon: Column, shared: Column) -> Column:
    return F.when(shared, F.concat(digest_, F.lit("-"), F.sha2(canon, 256))).otherwise(digest_)


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint, class_id (least id with that fingerprint), n_copies."""
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text)).alias("canon")).withColumn("digest", digest(F.col("canon")))
    bad = materialise(split_digests(docs, text), "split").withColumn("shared", F.lit(True))
    if bad.isEmpty():
        rows = rows.select("id", F.col("digest").alias("fingerprint"))
    else:
        rows = rows.join(bad, "digest", "left").select("id", fingerprint(F.col("digest"), F.col("canon"), F.coalesce("shared", F.lit(False))).alias("fingerprint"))
    rows = materialise(rows, "fingerprints")
    groups = rows.groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return rows.join(groups, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "class_id", "n_copies")


#: Cells that a range of ids is cut into by its quantiles, twice over.
_CELLS = 64


def _bounds() -> Column:
    """The quantiles of x, ascending and distinct, for an aggregate."""
    at = [k / _CELLS for k in range(1, _CELLS)]
    return F.array_sort(F.array_distinct(F.percentile_approx("x", at, 10_000)))


def _cell(bounds: Column, x: Column) -> Column:
    """How many bounds lie at or below x: comparisons in generated code, no lambda."""
    return reduce(operator.add, (F.coalesce((x >= F.get(bounds, F.lit(k))).cast("int"), F.lit(0)) for k in range(_CELLS - 1)))


def id_ranges(docs: DataFrame, id_col: str, per_range: int = 256) -> DataFrame:
    """docs with _range: ranges of ids in ascending order of about per_range rows each, null ids first (-1).

    Ids are cut at their quantiles, each cell at its own, and each small cell into equal widths, so a few ids far from all
    others change nothing but their own cell. The cells are few: their table is broadcast.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("x")).filter("x is not null")
    n = ids.count()
    top = ids.agg(F.coalesce(_bounds(), F.array().cast("array<long>")).alias("b")).first().b  # at most 63 numbers
    top = F.array(*map(F.lit, top)).cast("array<long>")
    cells = materialise(ids.withColumn("c", _cell(top, F.col("x"))).groupBy("c").agg(_bounds().alias("b")), "cells")
    fine = ids.withColumn("c", _cell(top, F.col("x"))).join(F.broadcast(cells), "c").withColumn("f", _cell(F.col("b"), F.col("x")))
    fine = fine.groupBy("c", "f").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    table = materialise(fine.select("c", "f", "low", (F.expr("cast(high as decimal(20,0)) - low") / F.greatest(F.col("n") / per_range, F.lit(1)) + 1).cast("double").alias("step")), "fine")
    width = 1 << (max(1, n // per_range).bit_length() + 1)
    x = F.col(id_col).cast("long")
    rows = docs.withColumn("_c", _cell(top, x)).join(F.broadcast(cells.withColumnsRenamed({"c": "_c", "b": "_b"})), "_c", "left")
    rows = rows.withColumn("_f", _cell(F.col("_b"), x)).join(F.broadcast(table.withColumnsRenamed({"c": "_c", "f": "_f", "low": "_low", "step": "_step"})), ["_c", "_f"], "left")
    inside = F.floor((x.cast("decimal(20,0)") - F.col("_low")).cast("double") / F.col("_step")).cast("long")
    number = (F.col("_c").cast("long") * _CELLS + F.col("_f")) * width + F.least(inside, F.lit(width - 1))
    return rows.withColumn("_range", F.coalesce(number, F.lit(-1))).drop("_c", "_b", "_f", "_low", "_step")


def with_next(docs: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """docs with next_<column> for each of keep: of the row that follows in descending id order; the first follows the last.

    Ids are cut into ranges; each range is ordered alone and gets a copy of the first row of the range below it, so one
    shuffle is enough and no task holds more than its range. Null ids come last; ties follow the kept columns.
    """
    n, n_ids = docs.agg(F.count(F.lit(1)), F.count(id_col)).first()
    rows = id_ranges(docs, id_col)
    heads = rows.groupBy("_range").agg(F.max(id_col).alias("_head"))
    # The range above takes this range's first row; the topmost range's first row follows the last of all.
    heads = materialise(heads, "ranges")
    # A range looks for its neighbour among those of its own and the next higher stretch of ranges: no task orders them all.
    lowest = F.lit(-1 if n_ids < n else 0)
    stretch = lambda r: F.floor((r + 1) / 4096).cast("long")
    by = Window.partitionBy("_stretch").orderBy("_range")
    firsts = heads.groupBy(stretch(F.col("_range")).alias("_stretch")).agg(F.min("_range").alias("_first"))
    firsts = firsts.withColumn("_then", F.lead("_first").over(Window.orderBy("_stretch")))
    heads = heads.withColumn("_stretch", stretch(F.col("_range"))).join(firsts, "_stretch")
    bottom = heads.agg(F.min("_range")).first()[0]
    above = F.coalesce(F.lead("_range").over(by), F.col("_then"), F.lit(bottom if bottom is not None else lowest))
    heads = materialise(heads.select("_range", "_head", above.alias("_above")), "heads")
    rows = rows.join(small(heads, heads.count()), "_range")
    first = F.col(id_col).eqNullSafe(F.col("_head"))
    places = F.when(first, F.array(F.struct(F.lit(0).alias("copy"), F.col("_range").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("_above").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("_range").alias("at"))))
    rows = rows.withColumn("_place", F.explode(places)).withColumns({"_copy": F.col("_place.copy"), "_at": F.col("_place.at")})
    order = Window.partitionBy("_at").orderBy("_copy", F.col(id_col).desc_nulls_last(), *keep)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in keep})
    return rows.filter("_copy = 0").drop("_range", "_head", "_above", "_place", "_copy", "_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (its last half replaced by the start of the next text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bad = materialise(split_digests(rows), "split")
    rows = with_next(rows, "doc_id", ["text"])
    n = F.char_length("text").cast("long")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    for c, t in (("", "text"), ("edited_", "edited"), ("next_", "next_text")):
        rows = rows.withColumn(f"{c}canon", canonical(F.col(t)))
        rows = rows.withColumns({f"{c}digest": digest(F.col(f"{c}canon")), f"{c}sha": F.sha2(f"{c}canon", 256)})
    kinds = ("", "edited_", "next_")
    rows = materialise(rows.select("doc_id", "n_chars", "edited_sha256", *(f"{c}{x}" for c in kinds for x in ("digest", "sha"))), "digests")
    both = rows.select("digest", "sha").unionByName(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))
    mixed = both.groupBy("digest").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).filter("low <> high").select("digest")
    bad = materialise(bad.unionByName(mixed).distinct(), "split")
    if bad.isEmpty():
        rows = rows.withColumns({f"{c}fingerprint": F.col(f"{c}digest") for c in kinds})
    else:
        for c in kinds:
            flag = bad.select(F.col("digest").alias(f"{c}digest"), F.lit(True).alias(f"{c}shared"))
            rows = rows.join(flag, f"{c}digest", "left").withColumn(f"{c}fingerprint", F.when(F.col(f"{c}shared"), F.concat(f"{c}digest", F.lit("-"), f"{c}sha")).otherwise(F.col(f"{c}digest")))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"))


def op7_fingerprints(spark, sf_dir):
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
