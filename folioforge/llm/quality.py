"""Quality classifier: document evidence with empirical-Bayes site posteriors.

A logistic model on the shape of a text gives each document a log-likelihood
ratio. Grouped aggregation gives, for each host and each path below it, how
many documents it has and how good they look. Hosts are shrunk towards the
global mean and paths towards their host, with prior strengths estimated from
the variance between hosts and between paths (method of moments), so that a
sparse site says little and a large one much. The posterior of a document's
site, without the document's own share, is the prior of the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, map_rows, materialize

N_FEATURES = 13
OTHER, LETTER, UPPER, DIGIT, SPACE, MARK, BREAK = range(7)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letters, upper case, digits, white space, common marks, breaks, other."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = UPPER if c.isupper() else LETTER
        elif c.isdigit():
            out[i] = DIGIT
        elif c.isspace():
            out[i] = BREAK if c == "\n" else SPACE
        elif c in ".,;:'\"-":
            out[i] = MARK
    return out


def features(text: str | None) -> list[float]:
    """Shares and repetition measures of a whole text; zeros for a blank one."""
    words = (text or "").split()
    if not words:
        return [0.0] * N_FEATURES
    n, m = len(text), len(words)
    kinds = np.bincount(char_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=7)
    lines = text.split("\n")
    pairs = set(zip(words, words[1:], strict=False))
    return [
        kinds[UPPER] / n, (kinds[LETTER] + kinds[UPPER]) / n, kinds[DIGIT] / n, kinds[OTHER] / n, kinds[MARK] / n,
        len(set(words)) / m, len(set(words)) / m**0.7, math.log(m), 1 - len(set(lines)) / len(lines),
        (len(pairs) + 1) / m, text.count(".") / m, len(lines) / m, n / m / 10,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """Ridge logistic regression by Newton steps, and the labelled base rate.

    Without both classes the model gives no evidence and the base rate is 0.5
    shrunk towards what labels there are.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    mean, sd = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w = np.zeros(N_FEATURES + 1)
    if len(set(y.tolist())) == 2:
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
        w[0] = math.log(rate / (1 - rate))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - p) - ridge * np.r_[0.0, w[1:]]
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        w[0] -= math.log(rate / (1 - rate))  # the rest is the likelihood ratio
    return {"w": w, "mean": mean, "sd": sd, "rate": float(rate)}


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios, bounded so that no text is beyond any prior."""
    return np.clip(model["w"][0] + ((x - model["mean"]) / model["sd"]) @ model["w"][1:], -20, 20)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> dict:
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    labels = labels.groupBy("id").agg(F.min("y").alias("y"))  # of labels that clash the lower counts
    n = labels.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 0.9 * max_labelled / max(n, 1))) + 1
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length(F.trim("text")) > 0) & share)

    def run(cols: list[list]) -> list:
        return [cols[0], [features(t) for t in cols[1]]]

    rows = map_rows(texts, "id long, x array<double>", run).join(labels.where(share), "id").select("x", "y").limit(max_labelled).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return fit_logistic(x, rows["y"].to_numpy(dtype=float))


def _strength(mean: float, between: F.Column) -> F.Column:
    """Beta prior strength of a mean whose groups vary by ``between``."""
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def _spread(n: str, s: str, centre: F.Column) -> list[F.Column]:
    """Sums for the between-group variance by moments, as aggregates."""
    dev = F.col(s) / F.col(n) - centre
    return [F.sum(F.col(n) * dev * dev).alias("dev"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(n).alias("total")]


def _between(within: F.Column) -> F.Column:
    total = F.col("total")
    return (F.col("dev") - (F.col("groups") - 1) * within) / F.greatest(total - F.col("nn") / total, F.lit(1.0))


def _with_evidence(rows: DataFrame, text: str, model: dict) -> DataFrame:
    """rows with evidence and p (null for a blank text) appended."""
    prior = math.log(model["rate"] / (1 - model["rate"]))
    schema = T.StructType([*rows.schema.fields, T.StructField(EVIDENCE, T.DoubleType()), T.StructField(SHARE, T.DoubleType())])
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                texts = part.column(place).to_pylist()
                e = evidence(model, np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))
                p = 1 / (1 + np.exp(-(e + prior)))
                blank = np.array([not (t and t.strip()) for t in texts], dtype=bool)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(e, mask=blank), pa.array(p, mask=blank)], names=[*part.schema.names, EVIDENCE, SHARE])

    return rows.mapInArrow(run, schema)


EVIDENCE, SHARE, HOST, PATH = "__evidence", "__share", "__host", "__path"


def _sites(scored: DataFrame, rate: float) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, hn, hs), the global mean, and the prior strengths of
    hosts and paths; scored has HOST, PATH and SHARE."""
    paths = scored.where(F.col(SHARE).isNotNull()).groupBy(HOST, PATH).agg(F.count(SHARE).alias("n"), F.sum(SHARE).alias("s"), F.sum(F.col(SHARE) * F.col(SHARE)).alias("ss"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy(HOST).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    overall = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    total = overall["n"] or 0
    mean = min(max((overall["s"] / total) if total else rate, 1e-6), 1 - 1e-6)
    within = F.lit(max(1e-9, ((overall["ss"] or 0.0) - total * mean * mean) / max(total - 1, 1)))
    a = hosts.agg(*_spread("hn", "hs", F.lit(mean))).select(_strength(mean, _between(within)).alias("x")).first()["x"] or 1e6
    sites = materialize(paths.join(hosts, HOST).select(HOST, PATH, "n", "s", "hn", "hs"), "sites")
    b = sites.agg(*_spread("n", "s", (F.col("hs") + a * mean) / (F.col("hn") + a))).select(_strength(mean, _between(within)).alias("x")).first()["x"] or 1e6
    return sites, mean, a, b


def _decided(scored: DataFrame, rate: float, base: DataFrame, threshold: float) -> DataFrame:
    """scored with the posteriors, the score and the decision under private
    names; site statistics come from base (the same documents, materialised)."""
    sites, mean, a, b = _sites(base, rate)
    sites = sites.select(HOST, PATH, F.struct("n", "s", "hn", "hs").alias("__site"))
    share = F.coalesce(SHARE, F.lit(0.0))
    one = F.when(F.col(SHARE).isNull(), 0).otherwise(1)
    n0 = lambda c: F.coalesce(F.col(f"__site.{c}"), F.lit(0))
    bound = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    out = scored.join(sites, [HOST, PATH], "left")
    out = out.withColumn("__host_posterior", bound((n0("hs") - share + a * mean) / (n0("hn") - one + a)))
    out = out.withColumn("__path_posterior", bound((n0("s") - share + b * F.col("__host_posterior")) / (n0("n") - one + b)))
    logit = F.col(EVIDENCE) + F.log(F.col("__path_posterior") / (1 - F.col("__path_posterior")))
    out = out.withColumn("__score", F.when(F.col(EVIDENCE).isNull(), 0.0).otherwise(1 / (1 + F.exp(-logit))))
    return out.withColumn("__keep", F.col(EVIDENCE).isNotNull() & (F.col("__score") >= threshold))


def _site_key(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("\0"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 20_000
) -> DataFrame:
    """One row per row of docs: (id_col, evidence, host_posterior,
    path_posterior, quality_score, keep).

    The classifier is fitted on at most ``max_labelled`` labelled documents,
    picked by a hash of the id; site statistics cover all documents. A null
    host or path is a site of its own. A null or blank text has no evidence:
    score 0, not kept, and no share in its site. Ties at the threshold are
    kept. Rows repeat as in docs; ids may be null (they are scored, not trained
    on). Without labels of both classes the evidence is 0. Empty tables give an
    empty result; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _site_key(host_col).alias(HOST), _site_key(path_col).alias(PATH), F.col(text_col).cast("string").alias("text"))
    scored = materialize(_with_evidence(rows, "text", model).drop("text"), "evidence")
    out = _decided(scored, model["rate"], scored, threshold)
    return out.select(F.col("id").alias(id_col), *[F.col(f"__{c}").alias(n) for c, n in (("evidence", "evidence"), ("host_posterior", "host_posterior"), ("path_posterior", "path_posterior"), ("score", "quality_score"), ("keep", "keep"))])


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 20_000
) -> DataFrame:
    """The rows of docs that classify_quality keeps, with their columns.

    Texts are read twice and never shuffled where Spark finds the site table
    small enough to broadcast; beyond that, the join shuffles.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_labelled)
    rows = docs.withColumns({HOST: _site_key(host_col), PATH: _site_key(path_col)})
    base = materialize(_with_evidence(rows.select(HOST, PATH, F.col(text_col).cast("string").alias("text")), "text", model).drop("text"), "evidence")
    return _decided(_with_evidence(rows, text_col, model), model["rate"], base, threshold).where("__keep").select(*docs.columns)
