"""Record columns and posting tables: the index as plain tables, each built by one pass over its source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X

from .ordering import numbered

ID = ["volume", "node"]
BLOCK = 128


def record_columns(records: DataFrame) -> DataFrame:
    """The normalised projection of records that search reads, with the plain columns that its filters need."""
    return records.select(
        *ID, "path", "name", "kind", "len", "created", "modified", "changed",
        X.normalize(F.col("name")).alias("name_norm"), X.normalize(F.col("path")).alias("path_norm"), X.normalize(X.extension(F.col("path"))).alias("ext"),
        F.coalesce(F.transform("tags", X.normalize), F.array().cast("array<string>")).alias("tags_norm"), X.normalize(F.col("finder_comment")).alias("comment_norm"),
    ).withColumns({"name_tokens": X.tokens(F.col("name_norm")), "path_tokens": X.tokens(F.col("path_norm")), "comment_tokens": X.tokens(F.col("comment_norm"))})


def name_postings(columns: DataFrame, kind: str) -> DataFrame:
    """key, volume, node for kind exact, term, prefix, gram, path, extension, kind, tag or comment."""
    keys = {
        "exact": F.array("name_norm"), "term": F.array_distinct("name_tokens"), "prefix": F.array_distinct(F.flatten(F.transform("name_tokens", X.prefixes))), "gram": X.grams(F.col("name_norm")),
        "path": F.array_distinct("path_tokens"), "extension": F.array("ext"), "kind": F.array("kind"), "tag": F.array_distinct("tags_norm"), "comment": F.array_distinct("comment_tokens"),
    }[kind]
    return columns.select(F.explode(keys).alias("key"), *ID).filter("key is not null")


def metadata_postings(columns: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """field (tag, comment), term, volume, node of records and of secondary records (tags, comments)."""
    parts = [columns.select(F.lit(f).alias("field"), F.explode(c).alias("term"), *ID) for f, c in (("tag", "tags_norm"), ("comment", "comment_tokens"))]
    if secondary is not None:
        parts.append(secondary.select(F.lit("tag").alias("field"), F.explode(F.transform("tags", X.normalize)).alias("term"), *ID))
        parts.append(secondary.select(F.lit("comment").alias("field"), F.explode(F.flatten(F.transform("comments", X.tokens))).alias("term"), *ID))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def fuzzy_postings(columns: DataFrame) -> DataFrame:
    """key, term: up to two deletions of each distinct fuzzy name token."""
    terms = columns.select(F.explode("name_tokens").alias("term")).distinct().filter(X.is_fuzzy_term(F.col("term")))
    return terms.select(F.explode(X.deletion_keys(F.col("term"))).alias("key"), "term")


def fuzzy_candidates(fuzzy: DataFrame, names: DataFrame, queries: DataFrame) -> DataFrame:
    """query, term, volume, node: queries (column query) meet terms on a deletion key and are verified by edit distance."""
    keys = queries.select("query", F.explode(X.deletion_keys(F.col("query"))).alias("key"))
    near = keys.join(fuzzy, "key").select("query", "term").distinct().filter(F.levenshtein("term", "query", 2) >= 0)
    return near.join(names.withColumnRenamed("key", "term"), "term")


def substring_candidates(grams: DataFrame, columns: DataFrame, needle: str) -> DataFrame:
    """Ids of names that hold all the needle's 3-grams and, verified, the needle."""
    wanted = sorted({needle[k : k + 3] for k in range(len(needle) - 2)})
    hits = grams.filter(F.col("key").isin(wanted)).groupBy(*ID).agg(F.countDistinct("key").alias("n")).filter(F.col("n") == len(wanted))
    return columns.join(hits.select(*ID), ID, "left_semi").filter(F.contains("name_norm", F.lit(needle))).select(*ID, "name_norm")


def token_positions(content: DataFrame) -> DataFrame:
    """term, volume, node, pos of every token of content (volume, node, text)."""
    return content.select(*ID, F.posexplode(X.tokens(F.col("text"))).alias("pos", "term"))


def content_postings(content: DataFrame) -> DataFrame:
    """term, volume, node, positions (ascending): grouped within each document's row, so nothing is shuffled.

    A document's tokens are sorted with their places; a term's positions are the stretch between two changes of the term.
    A volume and node are expected once.
    """
    places = F.sort_array(F.transform(X.tokens(F.col("text")), lambda t, k: F.struct(t.alias("term"), k.alias("pos"))))
    rows = content.select(*ID, places.alias("places")).filter(F.size("places") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("places")), lambda k: (k == 1) | (F.element_at("places", k)["term"] != F.element_at("places", F.greatest(k - 1, F.lit(1)))["term"]))
    rows = rows.withColumn("starts", F.concat(starts, F.array(F.size("places") + 1)))
    runs = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda k: F.struct(F.element_at("starts", k).alias("a"), F.element_at("starts", k + 1).alias("b")))
    rows = rows.select(*ID, "places", F.explode(runs).alias("run"))
    return rows.select(F.element_at("places", F.col("run.a"))["term"].alias("term"), *ID, F.slice("places", F.col("run.a"), F.col("run.b") - F.col("run.a"))["pos"].alias("positions"))


def term_frequency(postings: DataFrame) -> DataFrame:
    """term, df (records that hold it), occurrences."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("occurrences"))


def merged_postings(*tables: DataFrame) -> DataFrame:
    """Postings of several archives: positions of a term and id united, sorted, without repeats."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("term", *ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def imported_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """An import: new positions of a term and id replace the old ones."""
    return old.join(new.select("term", *ID), ["term", *ID], "left_anti").unionByName(new)


def limited(postings: DataFrame, limit: int) -> DataFrame:
    """The first ids of each term in id order, with rn, total and truncated."""
    by = Window.partitionBy("term")
    total = postings.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    few = postings.withColumn("rn", F.row_number().over(by.orderBy(*ID))).filter(F.col("rn") <= limit)
    return few.join(total, "term").withColumn("truncated", F.col("total") > limit)


def block(postings: DataFrame, k: int) -> DataFrame:
    """Block k of each term's ids, BLOCK at a time."""
    rn = F.row_number().over(Window.partitionBy("term").orderBy(*ID))
    return postings.withColumn("rn", rn).filter((F.col("rn") > k * BLOCK) & (F.col("rn") <= (k + 1) * BLOCK))


def dictionary(columns: DataFrame) -> DataFrame:
    """ordinal, term, kinds (sorted) of all distinct terms: names, kinds, paths, components, shared ancestors, extensions, tags, comments."""
    shared = columns.select(F.explode(X.ancestors(F.col("path_norm"))).alias("term")).groupBy("term").count().filter("count > 1").select("term")
    one = lambda kind, c: columns.select(c.alias("term")).withColumn("class", F.lit(kind))
    parts = [one("name", F.col("name_norm")), one("kind", F.col("kind")), one("path", F.col("path_norm")), one("component", F.explode(X.components(F.col("path_norm")))), one("extension", F.col("ext")), one("tag", F.explode("tags_norm")), one("comment", F.explode("comment_tokens")), shared.withColumn("class", F.lit("prefix"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    terms = out.filter("term is not null and term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return numbered(terms, [], ["term"], "ordinal").select("ordinal", "term", "classes")


NAME_KINDS = ("exact", "term", "prefix", "gram", "path", "extension", "kind", "tag", "comment")


@dataclass(frozen=True)
class Index:
    """The stored tables of an index: record columns; names (kind, key, ids); content (term, ids, positions); fuzzy (key, term); terms (kind, key, df)."""

    columns: DataFrame
    names: DataFrame
    content: DataFrame | None
    fuzzy: DataFrame
    terms: DataFrame


def write_index(path: str, columns: DataFrame, content: DataFrame | None = None) -> None:
    """Writes the index of record columns and content (volume, node, text) under path.

    Postings lie sorted by key over ranges of keys, so that a lookup reads the row groups of its keys only.
    """
    columns.write.parquet(f"{path}/columns")
    columns = columns.sparkSession.read.parquet(f"{path}/columns")
    names = None
    for kind in NAME_KINDS:
        part = name_postings(columns, kind).withColumn("kind", F.lit(kind))
        names = part if names is None else names.unionByName(part)
    names.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key", *ID).write.option("parquet.block.size", 16 << 20).parquet(f"{path}/names")
    names = columns.sparkSession.read.parquet(f"{path}/names")
    fuzzy_postings(columns).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/fuzzy")
    terms = names.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("df"))
    if content is not None:
        content_postings(content).repartitionByRange("term").sortWithinPartitions("term", *ID).write.option("parquet.block.size", 16 << 20).parquet(f"{path}/content")
        found = columns.sparkSession.read.parquet(f"{path}/content")
        terms = terms.unionByName(found.groupBy(F.col("term").alias("key")).agg(F.count(F.lit(1)).alias("df")).withColumn("kind", F.lit("content")))
    terms.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/terms")


def open_index(spark: SparkSession, path: str, content: bool = True) -> Index:
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(table("columns"), table("names"), table("content") if content else None, table("fuzzy"), table("terms"))


def hydrate(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the ids; repeated ids count once."""
    return records.join(ids.select(*ID), ID, "left_semi")


def missing(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that no record has."""
    return ids.select(*ID).distinct().join(records.select(*ID), ID, "left_anti")


def subtree(records: DataFrame, root: str) -> DataFrame:
    """The record at root and all below it."""
    return records.filter((F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/")))


def footprint(**tables: DataFrame) -> DataFrame:
    """table, row_count and distinct keys (column key or term) of each index table."""
    out = None
    for name, t in sorted(tables.items()):
        key = next((c for c in ("key", "term") if c in t.columns), None)
        row = t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), (F.countDistinct(key) if key else F.lit(0)).cast("long").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out
