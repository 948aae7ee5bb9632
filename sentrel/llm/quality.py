"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on text statistics gives each document its own evidence. Grouped sums of it per
path and per host, over all documents, give site rates that are shrunk: hosts towards the global rate, paths
towards their host, each by a strength estimated from how much the sites really differ (method of moments).
A document's log odds are its own evidence plus what its path, without itself, says beyond the global rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checked_broadcast, hash_sample, join_by_key, own_columns, small_batches, table, with_fields

TRAIN_ROWS = 20_000  # labelled documents that the regression is fitted on, at most: those of smallest hash
KEEP_FROM = 0.1  # a document goes only at odds of nine to one against it
CLIP = 8.0  # of a document's own log odds
SITE = ("source", "lang")  # host, path

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 , . ; : ' " - ? 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ",.;:'\"-?"]] = 5
FEATURES = ("words", "word_length", "long_words", "lower", "upper", "digits", "symbols", "marks", "distinct", "top_word", "top_three", "pairs", "lines", "line_distinct", "alike_ends", "letter_entropy")


def text_features(text: str | None) -> np.ndarray:
    """Statistics of the whole text; zeros if it has no words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, hist, 7)
    ink, n = max(1.0, kinds.sum() - kinds[4]), len(words)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    p = hist[hist > 0] / len(raw)
    return np.array([np.log1p(n), ink / n / 8, sum(len(w) > 15 for w in words) / n, kinds[1] / ink, kinds[2] / ink, kinds[3] / ink, kinds[0] / ink, kinds[5] / ink, len(counts) / n, top[0] / n, sum(top) / n, pairs, len(lines) / n, len(set(lines)) / len(lines), max(ends.values()) / n, -(p * np.log2(p)).sum() / 6])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([text_features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, arrays], [*batch.schema.names, "x"])


def with_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, which has `text`, with an array `x` of its statistics."""
    small_batches(spark)
    return docs.mapInArrow(_featured, with_fields(docs, x=T.ArrayType(T.DoubleType())))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights on the raw features and intercept, by Newton steps on standardised ones. Without both classes: no evidence."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return raw, float(w[-1] - raw @ mean)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(sites: DataFrame, rate: Column) -> float:
    """How many documents the parent's rate counts for. sites: n, s (sum of p), v (sum of p (1 - p)); rate: of the parent.

    The spread of site rates beyond what their size explains is the prior's variance: rate (1 - rate) / (1 + strength).
    """
    r = sites.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - rate) ** 2).alias("between"), F.sum(rate * (1 - rate)).alias("within"), F.sum(F.col("n") * rate * (1 - rate)).alias("top"), F.sum("n").alias("n")).first()
    if not r["n"]:
        return 1.0
    excess = ((r["between"] or 0.0) - r["within"]) / r["n"]
    var = r["top"] / r["n"]
    return float(np.clip(var / excess - 1, 1.0, 1e6)) if excess > 0 else 1e6


class QualityModel:
    """Fitted on docs and labels. `rows` has the docs' ids, sites and features; `score` adds p_doc, host_rate, path_rate, p_quality to it."""

    def __init__(self, spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, site: tuple[str, str], train_rows: int):
        self.scratch, self.site = Scratch(spark), site
        rows = docs.select(F.col(id_col).cast("long").alias("id"), *self.keys(docs), F.col(text_col).cast("string").alias("text"))
        self.rows = self.scratch.write(with_features(spark, rows).drop("text"), "features")
        known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("id", "y")
        sample = hash_sample(self.rows.where("id is not null").join(known, "id").select("id", "x", "y"), train_rows, "id").collect()
        sample.sort(key=lambda r: (r["id"], r["x"]))
        x = np.array([r["x"] for r in sample]).reshape(-1, len(FEATURES))
        self.weights, self.bias = fit_logistic(x, np.array([r["y"] for r in sample], float))
        self.fit_sites()

    def keys(self, docs: DataFrame) -> list[Column]:
        """Host and path as strings; a null has a key of its own."""
        host, path = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in self.site)
        return [host.alias("__host"), F.concat(host, F.lit("\x00"), path).alias("__path")]

    def evidence(self, x: str) -> Column:
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in self.weights]), lambda a, b: a * b), F.lit(self.bias), lambda t, v: t + v)
        return F.least(F.greatest(dot, F.lit(-CLIP)), F.lit(CLIP))

    def fit_sites(self) -> None:
        p = _logistic(self.evidence("x"))
        paths = self.rows.select("__host", "__path", p.alias("p")).groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
        paths = self.scratch.write(paths, "paths")
        hosts = self.scratch.write(paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        self.rate = total["s"] / total["n"] if total["n"] else 0.5
        self.host_strength = strength(hosts, F.lit(self.rate))
        shrunk = hosts.select("__host", ((F.col("s") + self.host_strength * self.rate) / (F.col("n") + self.host_strength)).alias("rate"), F.col("n").alias("nh"), F.col("s").alias("sh"))
        both = self.scratch.write(paths.join(checked_broadcast(self.scratch.write(shrunk, "shrunk")), "__host"), "both")
        self.path_strength = strength(both, F.col("rate"))
        self.sites = self.scratch.write(both.select("__path", "nh", "sh", F.col("n").alias("np"), F.col("s").alias("sp")), "sites")
        self.scratch.keep(self.rows, self.sites)

    def score(self, featured: DataFrame, x: str) -> DataFrame:
        """featured has x, __host, __path. A site's sums are taken without the document itself."""
        k, m, mu = self.host_strength, self.path_strength, self.rate
        out = join_by_key(featured, self.sites, "__path", "np").withColumn("__e", self.evidence(x)).withColumn("p_doc", _logistic(F.col("__e")))
        out = out.withColumn("host_rate", (F.col("sh") - F.col("p_doc") + k * mu) / (F.col("nh") - 1 + k))
        out = out.withColumn("path_rate", (F.col("sp") - F.col("p_doc") + m * F.col("host_rate")) / (F.col("np") - 1 + m))
        final = _logistic(F.col("__e") + _logit(F.col("path_rate")) - _logit(F.lit(mu)))
        return out.withColumn("p_quality", F.when(F.element_at(x, 1) > 0, final).otherwise(0.0)).drop("__path", "__host", "nh", "sh", "np", "sp", "__e")


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site: tuple[str, str] = SITE, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fits on labels (doc_id, quality 0 or 1) and on the sites of all docs.

    Labels that are null, neither 0 nor 1, of a null id or in conflict with another of the same id count as none.
    Without both classes the documents have no evidence of their own (p_doc 0.5). A null host or path is a site of
    its own. Texts without words, null ones included, have p_quality 0. Repeated rows count each. An empty table
    gives no rows. Columns of docs with the names of results are not read here.
    """
    return QualityModel(spark, docs, labels, id_col, text_col, site, train_rows)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = fit_quality(spark, docs, table(spark, sf_dir, "labels"))
    return model.score(model.rows, "x").select(F.col("id").alias("doc_id"), "p_doc", "host_rate", "path_rate", "p_quality", (F.col("p_quality") >= KEEP_FROM).alias("keep"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns only."""
    model = fit_quality(spark, docs, labels)
    model.scratch.keep(model.sites)
    # statistics are made again where a text is read for the result: cheaper than a second copy of all texts on disk
    rows = docs.select(F.struct(*own_columns(docs, "text")).alias("row"), *model.keys(docs), F.col("text").cast("string").alias("text"))
    kept = model.score(with_features(spark, rows), "x").where(F.col("p_quality") >= keep_from)
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
