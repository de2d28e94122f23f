from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarry.llm import mixing
from quarry.llm.common import WORD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixed_documents_are_whole_and_near_their_targets(spark):
    import re

    rows = [(k, " ".join(["w"] * (1 + k * 37 % 50)), "en", f"s{min(k % 13, 6)}", 1) for k in range(2000)] + [(9000, "", "en", "s1", 0), (9001, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got, want = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        n = len(re.findall(WORD, t or ""))
        assert times[i] <= 3 if n else times[i] == 1
        got[s] += n * times[i]
        want[s] = taken[i].target
    assert all(abs(got[s] - want[s]) <= 50 for s in want)


def test_stages_on_their_own_inputs(spark, tmp_path):
    """Quality on labelled junk, one of each copy, redaction, whole mix, whole packing: counts and columns after each stage."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != "pack":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, kept = {i for i, q in labels.items() if q == 1}, ids[1]
    assert len(good - kept) <= 0.01 * len(good) and not {i for i, q in labels.items() if q == 0} & kept
    assert ids[2] == ids[3] and ids[4] == ids[5]


def test_run_and_empty_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, None, None, None)], [(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (2, "token=abcdefghij", None, None, None)]])
def test_nulls_pass_through(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
