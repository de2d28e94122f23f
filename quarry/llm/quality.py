"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on a document's form (marks and symbols a word, repetition, sentence and word lengths), fitted on
a bounded sample of labelled rows, gives each document's evidence as log odds. Labels, or the classifier's probability
where there is none, are summed by host and by path (grouped sums, so a host with a third of all rows is no single
task). A host's rate is shrunk toward the global rate, a path's toward its host's; how much follows from the spread of
the rates beyond chance (method of moments), so sparse sites follow their prior and large ones their own documents. The
site's posterior, the document itself left out (its label, if it was summed by that), is the prior of its evidence.

Null and empty texts give no evidence: the site decides. Null hosts and paths are sites of their own. Repeated rows count
each. Labels that are null are passed over, repeated ones averaged, and those of unknown documents unused; without labels
of both classes every document keeps the global rate, and is kept. An empty table gives no rows. Further columns of the
documents are kept as they are, except those of the names of the results.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, lean_batches, lean_worker, materialise, small

#: Labelled documents, about so many by a hash of the id, that the classifier is fitted on.
SAMPLE = 20_000
#: Documents below this probability are rejected.
KEEP = 0.5
_CHUNK = 400
_SYMBOLS = re.compile(r"[#$%&*@^~<>{}\[\]\\=+_]")
_ENDS = re.compile(r"[.?…。]")
FEATURES = ("exclamations", "symbols", "bars", "repeats", "variety", "digits", "ends", "commas", "word_length", "capitals")


def features(text: str | None) -> list[float] | None:
    """What the classifier sees of a text; None without a word. Measures do not grow with the text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return None
    variety = sum(len(set(words[k : k + _CHUNK])) for k in range(0, n, _CHUNK)) / n
    return [
        text.count("!") / n, len(_SYMBOLS.findall(text)) / n, text.count("|") / n, sum(map(operator.eq, words, words[1:])) / n, variety * min(1.0, n / 50) + (1 - min(1.0, n / 50)),
        sum(map(text.count, "0123456789")) / len(text), len(_ENDS.findall(text)) / n, text.count(",") / n, min(len(text) / n, 20.0), sum(map(str.isupper, words)) / n,
    ]


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """evidence = bias + weights * (features - mean) / scale, as log odds beyond the labels' rate; hosts and paths: strength of the priors.

    rate: of all documents; fit_rate: of the labels, at which documents without one are summed by site.
    """

    mean: tuple
    scale: tuple
    weights: tuple
    bias: float
    rate: float
    host_strength: float = 10.0
    path_strength: float = 10.0
    fit_rate: float = 0.5

    def evidence(self, seen: list[float] | None) -> float:
        if seen is None or not self.weights:
            return 0.0
        return float(np.clip(self.bias + ((np.array(seen) - self.mean) / self.scale) @ np.array(self.weights), -30, 30))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Ridge logistic regression by Newton steps; both classes are needed, else the model has no evidence to give."""
    if not len(y) or y.min() == y.max():
        rate = 0.5 if not len(y) else float(np.clip(y.mean(), 0.5, 0.99))
        return Model((), (), (), 0.0, rate, fit_rate=rate)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -50, 50), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = float(y.mean())
    return Model(tuple(mean), tuple(scale), tuple(w[:-1]), float(w[-1]) - logit(rate), rate, fit_rate=rate)


def _site(host: Column, path: Column) -> list[Column]:
    return [host.cast("string").alias("host"), path.cast("string").alias("path")]


def strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength from the spread of the groups' rates (columns n, s) around rate: n p (1 - p) over the excess variance."""
    ours = F.col("s") / F.col("n")
    got = groups.filter("n >= 2").agg(F.sum(F.col("n") * (ours - rate) ** 2), F.sum(rate * (1 - rate)), F.sum("n"), F.sum(rate * (1 - rate) * F.col("n"))).first()
    if got[0] is None:
        return 10.0
    excess = (got[0] - got[1]) / max(1.0, got[2])
    within = got[3] / max(1.0, got[2])
    return float(min(1000.0, max(1.0, within / excess - 1))) if excess > 1e-9 else 1000.0


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label, the mean of its labels."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))


def train(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and the stored table of sites: host, path, host_n, host_s, n, s."""
    lean_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def seen(texts: pd.Series) -> pd.Series:
        lean_worker()
        return texts.map(features)

    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), *_site(host, path), seen(F.col(text)).alias("x")), "features")
    marks = labelled(labels)
    known = rows.join(marks, "doc_id").filter("x is not null").select("doc_id", "x", "label")
    known = materialise(known, "known")
    got = hashed_share(known, "doc_id", sample, known.count()).orderBy("doc_id", "x").toPandas()
    model = fit(np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES))), (got["label"].to_numpy() >= 0.5).astype(float))

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return x.map(lambda f: 1 / (1 + math.exp(-(model.evidence(None if f is None else list(f)) + logit(model.fit_rate)))))

    judged = rows.join(marks, "doc_id", "left").withColumn("p", F.coalesce("label", probability("x")))
    paths = materialise(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    sites = materialise(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "sites")
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = float(min(max((total[1] or 0) / (total[0] or 1), 0.01), 0.99)) if total[0] else model.rate
    by_host = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(rate))
    shrunk = (F.col("host_s") + by_host * rate) / (F.col("host_n") + by_host)
    return Model(model.mean, model.scale, model.weights, model.bias, rate if model.weights else model.rate, by_host, strength(sites, shrunk), model.fit_rate), sites


def score(docs: DataFrame, model: Model, sites: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text", keep: float = KEEP, labels: DataFrame | None = None) -> DataFrame:
    """docs with host, path, p_document (the text alone at the global rate), p_site, p_quality and keep.

    labels: those that the sites were summed with, so that a labelled document leaves its label out of its own prior.
    """

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        lean_worker()
        return texts.map(lambda t: model.evidence(features(t)))

    rows = docs.withColumns({"host": _site(host, path)[0], "path": _site(host, path)[1], "_evidence": evidence(F.col(text))})
    key = sites.select(*(F.col(c).alias(f"_{c}") for c in ("host", "path", "host_n", "host_s", "n", "s")))
    rows = rows.join(small(key, sites.count()), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    odds = lambda p: F.ln(p / (1 - p))
    prob = lambda x: 1 / (1 + F.exp(-x))
    rows = rows.withColumn("p_document", prob(F.col("_evidence") + logit(model.rate)))
    given = prob(F.col("_evidence") + logit(model.fit_rate))  # what the document gave its site
    if labels is not None:
        marks = materialise(labelled(labels).select(F.col("doc_id").alias("_labelled_id"), F.col("label").alias("_labelled")), "labels")
        rows = rows.join(small(marks, marks.count()), F.col(id_col) == F.col("_labelled_id"), "left")
        given = F.coalesce("_labelled", given)
    others = lambda n, s: (F.greatest(F.coalesce(n, F.lit(0)) - 1, F.lit(0)), F.greatest(F.least(F.coalesce(s, F.lit(0.0)) - given, F.coalesce(n, F.lit(0)) - 1), F.lit(0.0)))
    n, s = others(F.col("_host_n"), F.col("_host_s"))
    of_host = (s + model.host_strength * model.rate) / (n + model.host_strength)
    n, s = others(F.col("_n"), F.col("_s"))
    of_path = (s + model.path_strength * of_host) / (n + model.path_strength)
    rows = rows.withColumn("p_site", F.greatest(F.least(of_path, F.lit(1 - 1e-6)), F.lit(1e-6)))
    rows = rows.withColumn("p_quality", prob(F.col("_evidence") + odds(F.col("p_site"))))
    return rows.withColumn("keep", F.col("p_quality") >= keep).drop("_evidence", "_labelled_id", "_labelled", *key.columns)


def _documents(spark, docs, sf_dir):
    """Scored documents of the tables here: the host is the source, the path the language section of it."""
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, sites = train(docs, labels, host, path)
    return score(docs, model, sites, host, path, labels=labels)


def op3_quality(spark, sf_dir):
    return _documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id", "host", "path", "p_document", "p_site", "p_quality", "keep")


def quality_stage(spark, docs, sf_dir):
    """The documents that the classifier keeps, with their columns."""
    return _documents(spark, docs, sf_dir).filter("keep").select(*docs.columns)
