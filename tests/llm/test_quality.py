import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality

DOCS = "doc_id long, text string, source string, lang string, n_chars long, s double, label int"


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    model, sites = quality.train(docs, labels.filter("doc_id % 2 = 0"), host, path)
    got = quality.score(docs, model, sites, host, path).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("keep", "quality").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 100 and good.keep.mean() > 0.998 and bad.keep.mean() < 0.03


def test_sparse_sites_follow_their_prior(spark):
    text = "plain words here, of a usual kind. "
    rows = [(i, text, "bad", "x", 1, 0.5, 1) for i in range(200)] + [(1000 + i, text, "good", "x", 1, 0.5, 1) for i in range(200)] + [(5000, text, "new", "x", 1, 0.5, 1), (5001, text, "bad", "new", 1, 0.5, 1), (5002, None, None, None, 1, 0.5, 1)]
    rows += [(9000 + i, text + "! " * 40 * (i % 2), "other", "x", 1, 0.5, 1) for i in range(60)]
    labels = [(i, 0, 0) for i in range(100)] + [(1000 + i, 1, 0) for i in range(100)] + [(9000 + i, 1 - i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (77777, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    model, sites = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), host, path)
    got = {r.doc_id: r for r in quality.score(docs, model, sites, host, path).collect()}
    assert len(got) == len(rows) and got[1000].s == 0.5 and got[1000].label == 1
    assert got[150].p_site < got[5001].p_site < got[1150].p_site
    assert got[150].p_site < got[5000].p_site < got[1150].p_site
    assert got[5002].p_quality == pytest.approx(got[5002].p_site)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_without_both_classes_all_stay(spark, labels, tmp_path):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a b", "s", "l", 1, 0.5, 1), (2, "", "s", "l", 1, 0.5, 1), (3, None, None, None, 1, 0.5, 1), (1, "a b", "s", "l", 1, 0.5, 1)], DOCS)
    assert quality.quality_stage(spark, docs, str(tmp_path)).count() == 4
    assert quality.quality_stage(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_features_do_not_grow_with_the_text():
    text = " ".join(f"w{k % 3000}" for k in range(4000)) + ". "
    assert quality.features(text * 30) == pytest.approx(quality.features(text), abs=0.01)
    assert quality.features(None) is None and quality.features(" \n") is None
    x = np.random.default_rng(0).normal(size=(500, 10))
    model = quality.fit(x, (x[:, 0] > 0).astype(float))
    assert model.evidence([3.0] + [0.0] * 9) > 2 > -2 > model.evidence([-3.0] + [0.0] * 9)


def test_posteriors_against_brute_force(spark):
    """Sums by site, strengths, the document left out and the posterior, once more in plain Python."""
    import math
    from collections import defaultdict

    words = ["plain", "words,", "here.", "and!", "more", "|", "#tag", "12", "the", "the"]
    rows = [(2**53 + i, " ".join(words[(i * 7 + j * (1 + i % 4)) % len(words)] for j in range(i % 37)), f"h{i % 5 if i % 7 else None}", f"l{i % 3}", 1, 0.5, 1) for i in range(300)]
    rows += [(None, "plain words", None, "x", 1, 0.5, 1), rows[3], rows[4]]
    labels = [(2**53 + i, int(i % 37 > 12), 0) for i in range(0, 300, 3)] + [(2**53 + 6, 1, 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    model, sites = quality.train(docs, marks, host, path)
    by_id = defaultdict(list)
    for i, q, _ in labels:
        by_id[i].append(q)
    label = {i: sum(q) / len(q) for i, q in by_id.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    evidence = [model.evidence(quality.features(t)) for _, t, *_ in rows]
    gave = [label.get(i, sigmoid(e + quality.logit(model.fit_rate))) for (i, *_), e in zip(rows, evidence, strict=True)]
    key = [(s, "/".join(x for x in (s, lang) if x is not None)) for _, _, s, lang, *_ in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p), g in zip(key, gave, strict=True):
        hosts[h].append(g)
        paths[h, p].append(g)
    rate = sum(gave) / len(gave)
    assert model.rate == pytest.approx(rate)

    def strength(groups):
        groups = [(len(g), sum(g), r) for g, r in groups if len(g) >= 2]
        n = sum(k for k, *_ in groups)
        excess = (sum(k * (s / k - r) ** 2 for k, s, r in groups) - sum(r * (1 - r) for *_, r in groups)) / max(1, n)
        within = sum(r * (1 - r) * k for k, _, r in groups) / max(1, n)
        return min(1000.0, max(1.0, within / excess - 1)) if excess > 1e-9 else 1000.0

    a = strength([(g, rate) for g in hosts.values()])
    b = strength([(g, (sum(hosts[h]) + a * rate) / (len(hosts[h]) + a)) for (h, _), g in paths.items()])
    assert (model.host_strength, model.path_strength) == (pytest.approx(a), pytest.approx(b))
    want = []
    for (h, p), e, g, (i, *_) in zip(key, evidence, gave, rows, strict=True):
        rest = lambda x, g=g: (len(x) - 1, max(0.0, min(sum(x) - g, len(x) - 1)))
        n, s = rest(hosts[h])
        of_host = (s + a * rate) / (n + a)
        n, s = rest(paths[h, p])
        site = min(max((s + b * of_host) / (n + b), 1e-6), 1 - 1e-6)
        want.append((i or 0, round(site, 6), round(sigmoid(e + math.log(site / (1 - site))), 6)))
    got = [(r.doc_id or 0, round(r.p_site, 6), round(r.p_quality, 6)) for r in quality.score(docs, model, sites, host, path, labels=marks).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=3e-6)
