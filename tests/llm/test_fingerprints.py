import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp

DOCS = "doc_id long, text string, source string, _range int, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7, 7) for i, t in rows], DOCS)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)))
    return out


def test_edited_against_brute_force(spark):
    rows = [(k * 3, f"Text {k % 7} é" + "x" * (k % 11)) for k in range(900)] + [(5, None), (7, ""), (8, "Straße  ﬁn X"), (10, "STRASSE fin x"), (2**62, "😀ab😀"), (-(2**62), "éa")]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fp.edited_fingerprints(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_equal_texts_share_fingerprints_and_nothing_else_does(spark):
    rows = [(1, "Café au  lait"), (2, "café AU\nlait "), (3, "cafe au lait"), (4, None), (5, "  "), (6, "x" * 200_000), (7, "x" * 199_999)]
    got = {r.doc_id: r for r in fp.fingerprint_groups(frame(spark, rows)).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[4].fingerprint == got[5].fingerprint and got[6].fingerprint != got[7].fingerprint
    assert (got[2].class_id, got[2].n_copies, got[3].n_copies) == (1, 2, 1)


def test_digest_shared_by_different_texts_is_split(spark, monkeypatch):
    monkeypatch.setattr(fp, "digest", lambda canon: F.substring(canon, 1, 1))
    got = {r.doc_id: r for r in fp.fingerprint_groups(frame(spark, [(1, "ab"), (2, "ac"), (3, "ab"), (4, "z"), (5, "z")])).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[4].fingerprint == "z"
    out = {r.doc_id: r for r in fp.edited_fingerprints(frame(spark, [(1, "ab"), (2, "ac"), (3, "ab")])).collect()}
    assert out[1].fingerprint == out[3].fingerprint != out[2].fingerprint


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(1, "same"), (1, "same"), (2, None)]])
def test_small_tables(spark, rows):
    assert fp.edited_fingerprints(frame(spark, rows)).count() == len(rows)
    assert fp.fingerprint_groups(frame(spark, rows)).count() == len(rows)
