import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import token_files as tf
from quarry.llm.bpe import default_path, encoder

DOCS = "doc_id long, text string, shard string, n_ids int"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n \nb", "a \n b", "a \n \n b ", "\n", "\n\n x", "it's I'll 'tis we've", "x<|endoftext|>y <|endoftext|> z", "a b   c d", "é ñ 漢字 かな 😀😀 x", "tab\t tab \tend", "1234 12a4 $$$ ### a.b,c", "a\x1c b\x1d c", "w" * 5000, "\r\n \r\n  a"]


def library(text):
    return encoder(default_path()).library.encode(text, add_special_tokens=False).ids


def mine(text):
    enc = encoder(default_path())
    return np.frombuffer(enc.ids(text), enc.kind).tolist()


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(text):
    assert mine(text) == library(text)
    assert mine("lead " + text + " tail") == library("lead " + text + " tail")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", "\n", "\t", "a", "Bc", "1", "'s", "é", " ", "　", ".", "漢", "\x85", "\x1f"]), max_size=25).map("".join))
def test_ids_on_random_white_space(text):
    assert mine(text) == library(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1500), st.integers(1, 32), st.integers(0, 10**6))
def test_blocks_round_trip(n, bits, seed):
    rnd = np.random.default_rng(seed)
    ids = (rnd.integers(0, 1 << bits, n) >> rnd.integers(0, bits, n)).astype(np.uint32)
    data, index = tf.pack(ids)
    assert len(index) == -(-n // tf.BLOCK) + 1
    assert tf.unpack(data, index, n).tolist() == ids.tolist()
    if len(index) > 3:
        assert tf.unpack(data, index, n, 1, 3).tolist() == ids[256:768].tolist()


def test_segments_give_single_documents():
    docs = [(i if i else None, np.arange(i * 97 % 600, dtype="<u2").tobytes()) for i in range(20)]
    seg = tf.Segment(tf.segment(docs, np.dtype("<u2")))
    for k, (_, b) in enumerate(docs):
        assert seg.ids(k).tolist() == np.frombuffer(b, "<u2").tolist()


def test_query_against_the_library(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(ODD) + " ".join(rnd.choice(ODD) for _ in range(i % 9)), "s", 1) for i in range(-5, 300)] + [(1000, None, "s", 1), (1001, "long words here " * 40_000, "s", 1)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in tf.op6_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, t, *_ in sorted(rows):
        ids = [*library(t or ""), 0]
        want = (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(got[i]) == want
        start += len(ids)
    assert len(got) == len(rows)


def test_small_tables(spark, tmp_path):
    for k, rows in enumerate([[], [(None, "x", "s", 1), (7, "y", "s", 1), (7, "y", "s", 1)]]):
        tf.write(spark.createDataFrame(rows, DOCS), str(tmp_path / str(k)), segment_ids=1)
        got = sorted(tf.read(spark, str(tmp_path / str(k))).collect(), key=lambda r: r.start)
        assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(i, 2 * n, 2) for n, (i, *_) in enumerate(rows)]
