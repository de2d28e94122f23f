import gc
import weakref

import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import bpe, near_dups, packing
from quarry.llm.common import lean_worker


def test_encoders_and_their_caches_are_given_back():
    enc = bpe.encoder(bpe.default_path())
    ids = enc.batch(["some words of a text"])
    held = weakref.ref(enc)
    del enc
    lean_worker(keep_encoders=True)
    assert held() is bpe.encoder(bpe.default_path()) and held().cache
    lean_worker()
    gc.collect()
    assert held() is None and bpe.encoder(bpe.default_path()).batch(["some words of a text"]) == ids


def test_pipeline_workers_hold_no_cache_between_tasks(spark, monkeypatch):
    """Workers take turns at tasks: what an idle one keeps adds to the memory of those at work."""

    class Caught(Exception):
        pass

    def caught(self, rows, schema):
        raise Caught(rows)

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k, k + 1], "text": [f"some words {k}, of a text", "word " * 3000]}) for k in (0, 2)]
    out = []
    for planned in (lambda: corpus_pipeline.pack_stage(spark, docs, None), lambda: packing.pieces(docs)):
        with pytest.raises(Caught) as found:
            planned()
        bpe.forget()
        out.append([r for b in found.value.args[0](iter(batches)) for r in b.to_pylist()])
        enc = bpe.encoder(bpe.default_path())
        assert (not enc.cache and not enc.held) == (len(out) == 1)
    assert out[0] == out[1] and len(out[0]) > 4


def test_a_cache_may_be_given_less():
    bpe.forget()
    enc = bpe.encoder(bpe.default_path(), 1000)
    texts = [" ".join(f"w{k}" for k in range(a, a + 50)) for a in range(0, 500, 50)]
    few = [enc.batch([t]) for t in texts]
    assert len(enc.cache) < 100
    assert few == [bpe.encoder(bpe.default_path()).batch([t]) for t in texts] and len(enc.cache) > 100


class Caught(Exception):
    pass


def test_pipeline_workers_give_back_at_a_tasks_end(spark, monkeypatch):
    """Signing frees its memory after the last batch, and packing keeps no encoder: else a worker at rest holds them."""

    def caught(self, rows, schema):
        raise Caught(rows)

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words of a text, and of one more"]})
    with pytest.raises(Caught) as found:
        near_dups.signatures(docs, "doc_id", "text")
    freed = []
    monkeypatch.setattr(near_dups, "lean_worker", lambda: freed.append(len(freed)))
    assert sum(b.num_rows for b in found.value.args[0](iter([batch, batch]))) == 2 and len(freed) == 3
    with pytest.raises(Caught) as found:
        corpus_pipeline.pack_stage(spark, docs, None)
    assert sum(b.num_rows for b in found.value.args[0](iter([batch, batch]))) == 2
    assert not bpe._encoders
