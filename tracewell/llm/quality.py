"""Quality by hierarchical empirical Bayes.

Three sources of evidence on the log-odds scale: a document classifier (logistic regression on the text's form, giving a
likelihood ratio), and the labels gathered at its host and at its path. Paths shrink toward their host, hosts toward the
global rate: beta-binomial posteriors whose prior strengths come from the data by the method of moments, all by grouped
aggregates with partial sums, so a host with a third of all rows costs no more than another. No label judges its own
document: the classifier is fitted on two halves of the labels, each scoring the other, and a labelled document's label
is taken out of its host's and path's counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stored, texts

FEATURES = ("words", "letters", "capitals", "marks", "digits", "repeats", "length", "lines")
RESULT = ["doc_id", "host", "path", "evidence", "site_log_odds", "score", "keep"]
_KIND = {"letters": bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128), "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "marks": bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,'")}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Host and first path segment."""
    return F.concat(host_of(url), F.lit("/"), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]*)", 1))


def form(raw: bytes) -> list[float]:
    """How a text looks: numbers of about unit size."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    share = {k: (size - len(raw.translate(None, v))) / size if raw else 0.0 for k, v in _KIND.items()}
    return [math.log1p(n), share["letters"], share["capitals"], share["marks"], share["digits"], 1 - len(set(words)) / n if n else 0.0, math.log1p(sum(map(len, words)) / n) if n else 0.0, math.log1p(raw.count(b"\n")) / math.log1p(n) if n else 0.0]


def formed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([form(x) for x in texts(batch.column(3))], pa.list_(pa.float64()))], names=["doc_id", "host", "path", "form"])

    return docs.mapInArrow(run, "doc_id long, host string, path string, form array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, weights with the bias last) by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    z = np.column_stack([z[:, :-1], z[:, :-1] ** 2, z[:, -1:]])
    w = np.zeros(z.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return mean, spread, w


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = 20_000, cut: float = 0.5) -> DataFrame:
    """Posterior probability of good quality for every document, and whether it is kept (score >= cut).

    `sample` is the documented bound on labelled documents that each half's classifier is fitted on (by a hash of the id,
    repeated ids once); the site counts use all labels. Several labels of one id count by their mean; null labels and
    labels without a document do nothing. Without labels of both kinds a half's classifier gives no evidence, and without
    labels every score is 0.5. A null host or path is a site of its own; null and empty texts have the form of an empty
    text; null ids are scored without own label; repeated rows pass through, a row each, and count at their sites one by
    one; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    good = labels.select(F.col(label_id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("y")).filter("_id is not null and y is not null").groupBy("_id").agg(F.avg("y").alias("y"))
    rows = formed(base).join(good, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = stored(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int")), "quality-form")
    known = rows.filter("y is not null")
    total, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).collect()[0]
    prior = (positive + 1.0) / (total + 2.0)
    by_half = [_evidence(known.filter(F.col("half") == k), sample) for k in (0, 1)]
    evidence = F.when(F.col("half") == 0, by_half[1]).otherwise(by_half[0])

    def strength(groups: DataFrame, mean: Column) -> float:
        """Prior sample size m of a beta-binomial by moments: between-site variance over what chance explains."""
        n, q = F.col("n"), F.col("k") / F.col("n")
        r = groups.agg(F.sum(n * (q - mean) ** 2).alias("s"), F.sum(n * mean * (1 - mean)).alias("v"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("g"), F.sum(mean * (1 - mean)).alias("vg")).collect()[0]
        if not r["g"] or not r["vg"] or r["g"] < 2:
            return 10.0
        between = (r["s"] - r["vg"]) / max(1e-9, r["n"] - r["nn"] / r["n"])  # E[s] = sum of p(1-p) + between * (n - nn/n)
        inside = r["v"] / r["n"]
        return float(min(1e6, max(1.0, inside / between - 1.0))) if between > 0 else 1e6

    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    m_host = strength(hosts, F.lit(prior))
    hosts = stored(hosts.select(F.col("host").alias("_h"), F.col("n").alias("n_host"), F.col("k").alias("k_host")), "quality-hosts")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    of_host = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).withColumn("rate", (F.col("k_host") + m_host * prior) / (F.col("n_host") + m_host))
    m_path = strength(of_host, F.col("rate"))
    paths = stored(paths.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), F.col("n").alias("n_path"), F.col("k").alias("k_path")), "quality-paths")
    out = rows.join(hosts, F.col("host").eqNullSafe(F.col("_h")), "left").join(paths, F.col("host").eqNullSafe(F.col("_ph")) & F.col("path").eqNullSafe(F.col("_pp")), "left")
    own, own_y = F.col("y").isNotNull().cast("int"), F.coalesce("y", F.lit(0.0))
    others = lambda n, k, m, mean: (F.coalesce(k, F.lit(0.0)) - own_y + m * mean) / (F.coalesce(n, F.lit(0)) - own + m)
    all_prior = (positive - own_y + 1.0) / (total - own + 2.0)
    host_rate = others("n_host", "k_host", m_host, all_prior)
    rate = F.when(F.lit(total) > 0, others("n_path", "k_path", m_path, host_rate)).otherwise(F.lit(0.5))
    out = out.withColumn("evidence", evidence).withColumn("rate", rate).withColumn("site_log_odds", F.log(F.col("rate") / (1 - F.col("rate"))))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.col("site_log_odds")))))
    return out.withColumn("keep", F.col("score") >= cut).select(*RESULT)


def _evidence(known: DataFrame, sample: int) -> Column:
    """The classifier's log-odds less those of its sample, a likelihood ratio, as an expression of the form."""
    total = known.count()
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    drawn = known.filter(hashed < F.lit(min(1.0, sample / max(1, total))) * (1 << 30)).groupBy("doc_id").agg(F.min(F.struct("form", "y")).alias("one"))
    drawn = drawn.orderBy(hashed, "doc_id").limit(sample).select("one.form", "one.y").collect()
    x, y = np.array([r["form"] for r in drawn]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in drawn])
    if len(set(np.round(y))) < 2:
        return F.lit(0.0)
    mean, spread, w = logistic(x, np.round(y))
    base_rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    evidence = F.lit(float(w[-1]) - math.log(base_rate / (1 - base_rate)))
    for k in range(len(FEATURES)):
        z = (F.col("form")[k] - float(mean[k])) / float(spread[k])
        evidence = evidence + float(w[k]) * z + float(w[k + len(FEATURES)]) * z * z
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), evidence))
