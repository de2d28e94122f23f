"""Ids that no double can hold come back as they are, beside null ids in the same batch."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints, html_text, language_model, mixing, near_dups, packing, quality, secrets, token_files
from quarry.llm.common import fresh_path

IDS = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1, 5, 2**62 + 1]


def written(docs):
    path = fresh_path(docs.sparkSession, "ids")
    token_files.write(docs, path)
    return token_files.read_crc(docs.sparkSession, path)


def scored(docs):
    host = F.lit("h")
    labels = docs.sparkSession.createDataFrame([(IDS[0], 1, 0), (IDS[1], 0, 0)], "doc_id long, quality int, toxic int")
    model, sites = quality.train(docs, labels, host, host)
    return quality.score(docs, model, sites, host, host, labels=labels)


@pytest.mark.parametrize(
    ("of", "nulls"),
    [(lambda d: html_text.extract(d, "doc_id", "source", "text").withColumnRenamed("page_id", "doc_id"), True), (lambda d: language_model.lm_scores(d, F.col("doc_id") % 5 == 1), True), (mixing.mix, True), (written, True), (fingerprints.edited_fingerprints, True), (packing.pack, True), (secrets.scan, True), (near_dups.near_classes, False), (scored, True)],
    ids=["html", "lm", "mix", "files", "fingerprints", "packing", "secrets", "near_dups", "quality"],
)
def test_ids_are_exact(spark, of, nulls):
    rows = [(i, f"text {k}! with a token=abcdefgh{k} " * (k + 1), "s") for k, i in enumerate(IDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    want = [i for i in IDS if nulls or i is not None]
    assert sorted(str(r.doc_id) for r in of(docs).select("doc_id").collect()) == sorted(map(str, want))
