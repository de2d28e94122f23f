import pytest

from quarry.streaming import events as V


def run(spark, tmp_path):
    stream = spark.readStream.schema("path string, kind string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    V.maintain(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination(60)


def test_an_old_version_that_cannot_be_read_fails_the_batch(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "path string, kind string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows(("/a", "upsert", 1))
    run(spark, tmp_path)
    files = list((tmp_path / "table/v0").glob("part-*"))
    held = {f: f.read_bytes() for f in files}
    for f in (tmp_path / "table/v0").glob(".*.crc"):
        f.unlink()
    for f in files:
        f.write_bytes(b"broken")
    rows(("/b", "upsert", 2))
    with pytest.raises(Exception):
        run(spark, tmp_path)
    for f, data in held.items():
        f.write_bytes(data)
    run(spark, tmp_path)
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "table/v1")).collect()) == ["/a", "/b"]
