import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import gated
from quarry.llm import language_model as lm

DOCS = "doc_id long, text string, word string, block int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], DOCS)


def scores(spark, rows):
    return lm.lm_scores(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("stretch", [1 << 20, 50])
def test_base_scores_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(lm, "_STRETCH", stretch)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    rows = [(k, " ".join(f"W{(k * j) % 37}É." for j in range(k % 23)) + "\x0b x\x1cy") for k in range(400)] + [(1000, None), (1001, ""), (1002, "new " * 9000), (7, "repeated row")]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not out[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, r.base_score) for r in scores(spark, rows))
    want = sorted((i, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), out[i], n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for i, t in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_learns_more_than_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    got = lm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).filter("held_out").toPandas()
    assert len(got) > 500 and got.score.sum() > 0.95 * got.base_score.sum()
    assert (got.score / got.n_tokens).mean() > (got.base_score / got.n_tokens).mean() + 0.15


def test_words_of_their_own_follow_the_vocabulary(spark):
    """The network tells apart words that grow with the vocabulary's power of 0.56 and hold two tokens in five of Zipf counts."""
    words = []
    for v in (20_000, 300_000):
        counts = spark.range(1, v + 1).selectExpr("cast(concat('w', id) as binary) word", f"cast({v} / id as long) + 1 c").cache()
        vocab, ranks = lm.vocabulary(counts, 1)
        total = counts.agg(F.sum("c")).first()[0]
        words.append(ranks.count())
        assert words[-1] == vocab.codes.words >= v**0.55 and vocab.counts.sum() >= 0.4 * total and vocab.n == total + 1
        counts.unpersist()
    assert words[1] > 4 * words[0]


CODES = gated.Codes(12, lm.SPELLINGS)


def weights(spread=0.0, kind=np.float32):
    counts = 5000.0 - np.arange(CODES.words)
    vector = gated.initial(CODES, counts, np.append(10.0 + np.arange(lm.SPELLINGS), 77.5)).astype(kind)
    return vector + np.random.default_rng(3).normal(0, spread, len(vector)).astype(kind)


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_probabilities_of_all_tokens_sum_to_one(spread):
    w = gated.views(weights(spread), CODES)
    h = np.random.default_rng(1).uniform(-1, 1, size=(1, gated.STATE)).astype(np.float32)
    codes = np.array([*range(CODES.words), *range(CODES.words + CODES.side, CODES.inputs)], np.int32)
    classes = np.exp(gated.log_probabilities(w, CODES, np.repeat(h, CODES.classes, 0), np.arange(CODES.words, CODES.inputs).astype(np.int32)))
    assert classes.sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(gated.log_probabilities(w, CODES, np.repeat(h, len(codes), 0), codes)).sum() == pytest.approx(1, abs=1e-4)


def plain_score(w, tokens):
    """Token by token, in plain double precision."""
    h, before, total = np.zeros(gated.STATE), CODES.end, 0.0
    w = {k: x.astype(np.float64) for k, x in w.items()}
    bend = lambda x: x / (1 + np.abs(x))
    soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    for t in tokens:
        zc = bend(w["x"][before] @ w["xw"] + w["xb"] + h @ w["zc"])
        z, c = zc[: gated.STATE] * 0.5 + 0.5, zc[gated.STATE :]
        h = h + z * (c - h)
        cls = t // CODES.side if t < CODES.words else t - CODES.words
        total += soft(h @ w["oc"] + w["ob"])[cls]
        if t < CODES.words:
            total += soft(h @ w["wc"][cls] + w["wb"][cls])[t % CODES.side]
        before = t
    return total


@pytest.mark.parametrize("lanes", [3, 512])
def test_scores_against_token_by_token(monkeypatch, lanes):
    monkeypatch.setattr(gated, "LANES", lanes)
    monkeypatch.setattr(gated, "WINDOW", 64)
    w, rnd = gated.views(weights(0.3), CODES), np.random.default_rng(2)
    docs = [np.append(rnd.integers(0, CODES.words, n), CODES.end).astype(np.int32) for n in (0, 5, 300, 64, 65, 1000, 2)]
    got = gated.score_documents(w, CODES, np.concatenate(docs), np.array([len(d) for d in docs]))
    assert np.allclose(got, [plain_score(w, d) for d in docs], rtol=1e-4)


def test_gradients_against_differences():
    vector, rnd = weights(0.2, np.float64), np.random.default_rng(0)
    w, slope = gated.views(vector, CODES), np.zeros_like(vector)
    inputs, targets = rnd.integers(0, CODES.inputs, (5, 3)).astype(np.int32), rnd.integers(0, CODES.words + 5, (5, 3)).astype(np.int32)
    targets[targets >= CODES.words] += CODES.side
    keep, real, h = np.ones((5, 3)), np.ones((5, 3), bool), rnd.uniform(-1, 1, size=(gated.STATE, 3))
    keep[2, 1], real[4, 2] = 0, False
    loss = lambda v, g: gated.gradients(gated.views(v, CODES), CODES, h, inputs, targets, keep, real, gated.views(g, CODES))[0]
    loss(vector, slope)
    for k, g in gated.views(slope, CODES).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        change = []
        for by in (1e-4, -1e-4):
            other = vector.copy()
            gated.views(other, CODES)[k][at] += by
            change.append(loss(other, np.zeros_like(vector)))
        assert g[at] == pytest.approx((change[0] - change[1]) / 2e-4, rel=1e-3, abs=1e-6), k


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b"), (None, "a b")]])
def test_small_tables(spark, rows):
    got = scores(spark, rows)
    assert len(got) == len(rows) and all(r.score < 0 for r in got)


def test_whole_scores_against_token_by_token(spark, monkeypatch):
    """score is the network's over the codes, plus the shares of rare words within their classes."""
    kept = {}
    fitted = lm._fitted
    monkeypatch.setattr(lm, "_fitted", lambda coded, vocab: kept.setdefault("w", (fitted(coded, vocab), vocab))[0])
    rows = [(k, " ".join(f"w{(k * j) % 37} é{j}." for j in range(k % 23))) for k in range(300)] + [(2**53 + 1, "W1 w2 never-seen"), (2**53 + 3, ""), (None, "w3")]
    got = {(r.doc_id, r.n_tokens): r.score for r in scores(spark, rows)}
    vector, vocab = kept["w"]
    monkeypatch.setattr(sys.modules[__name__], "CODES", vocab.codes)
    w, c = gated.views(vector, vocab.codes), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(words(t))
    frequent = [x for x, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: vocab.codes.words]]
    of = lambda x: int(lm.spellings(pa.array([x.encode()], pa.binary()))[0])
    share = Counter()
    for x, n in c.items():
        share[of(x)] += 0 if x in frequent else n + 0.5
    for i, t in rows:
        code = [frequent.index(x) if x in frequent else vocab.codes.words + vocab.codes.side + of(x) for x in words(t)]
        rare = sum(math.log((c[x] + 0.5) / (share[of(x)] + 0.5)) for x in words(t) if x not in frequent)
        assert got[i, len(code) + 1] == pytest.approx((plain_score(w, [*code, vocab.codes.end]) + rare) / math.log(10), rel=1e-4)


def test_every_training_document_trains_the_network(spark, monkeypatch):
    seen = []

    def kept(coded, vocab):
        for r in coded.collect():
            ids, has_id, held, lengths, *_ = lm._unpack(bytes(r.docs), *lm._SCORED)
            seen.extend((int(i) if k else None, int(n), r.round) for i, k, h, n in zip(ids, has_id, held, lengths, strict=True) if not h)
        return vocab.initial()

    monkeypatch.setattr(lm, "_fitted", kept)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100)
    rows = [(k, f"text {k}") for k in range(60)] + [(7, "repeated row"), (None, "no id")]
    got = scores(spark, rows)
    assert sorted(str(i) for i, _, _ in seen) == sorted(str(i) for i, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1)
    assert {r for *_, r in seen} == set(range(lm.ROUNDS)) and len(got) == len(rows)
