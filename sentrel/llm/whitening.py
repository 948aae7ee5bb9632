"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become integers, so sums are exact whatever the order of partitions. A first pass gives the number of vectors,
sums and extremes of each dimension, a second one the scatter of the centred vectors n * x - sum: a task multiplies
their residues modulo a few primes of 20 bits as matrices of doubles, in blocks short enough that no product sum passes
2^53, and adds up modulo the prime. The extremes bound the scatter's entries, hence the number of primes whose
product exceeds them; the Chinese remainder theorem gives the entries back. Divided by n^3 they are the covariance,
rounded once, and a symmetric eigensolver in double precision gives the components.

What passes the driver are matrices of the size of a vector squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
PRIME_BITS = 20
BLOCK = 1 << (53 - 2 * PRIME_BITS)  # rows whose products of residues add up exactly in a double
FAN_IN = 64  # partial results that are added up together


def primes(bound: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as a product over `bound` takes."""
    out, product, n = [], 1, 1 << PRIME_BITS
    while product <= bound:
        n -= 1
        if n % 2 and all(n % i for i in range(3, isqrt(n) + 1, 2)):
            out.append(n)
            product *= n
    return out


def remainder(residues: list[np.ndarray], mods: list[int]) -> np.ndarray:
    """The integers (as Python's) of smallest magnitude that have these residues."""
    whole = 1
    for p in mods:
        whole *= p
    out = sum(r.astype(object) * ((whole // p) * pow(whole // p, -1, p)) for r, p in zip(residues, mods, strict=True)) % whole
    return np.where(out > whole // 2, out - whole, out)


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each dimension n, the sum (in two halves, so that nothing overflows), the least and the largest entry."""
    n, high, low, least, most = 0, 0, 0, None, None
    for _, x in matrices(batches):
        n += len(x)
        high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        least, most = x.min(0) if least is None else np.minimum(least, x.min(0)), x.max(0) if most is None else np.maximum(most, x.max(0))
    if n:
        d = len(least)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), *(pa.array(v) for v in (high, low, least, most))], ["i", "n", "high", "low", "least", "most"])


def _scatter(n: int, sums: list[int], mods: list[int]):
    """Per prime and row of the matrix its residues, over all of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        total = np.zeros((len(mods), d, d))
        for _, x in matrices(batches):
            for k, p in enumerate(mods):
                y = ((x % p) * (n % p) - np.array([s % p for s in sums])) % p
                for at in range(0, len(y), BLOCK):
                    block = y[at : at + BLOCK].astype(np.float64)
                    total[k] = (total[k] + block.T @ block % p) % p
        for k in range(len(mods)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, k, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total[k].astype(np.int64)), pa.list_(pa.int64()))], ["k", "i", "v"])

    return run


def _added(mods: list[int]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        k, i = key[0].as_py(), key[1].as_py()
        v = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1).sum(0) % mods[k]
        return pa.table([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([v], pa.list_(pa.int64()))], ["k", "i", "v"])

    return run


class Whitener:
    """The linear map of some vectors: n, sums (Python's integers), the covariance's trace, and components with their variance."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, components: int):
        self.n, self.sums = n, sums
        covariance = np.array([[float_of(v, n**3) for v in row] for row in scatter])
        e, w = np.linalg.eigh(covariance) if n else (np.zeros(0), np.zeros((0, 0)))
        order = [j for j in np.argsort(-e, kind="stable")[:components] if e[j] > len(e) * np.finfo(float).eps * e.max()]
        self.e, self.w, self.trace = e[order], w[:, order], float_of(sum(scatter[i, i] for i in range(len(scatter))), n**3) if n else 0.0
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once at most where x is within 2^53 of the mean."""
        return (x - self.whole).astype(np.float64) - np.array([float_of(r, self.n) for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.w / np.sqrt(self.e)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row the sum over the dimensions of (n * x - S)^2, exactly."""
        gap = x - self.whole
        largest = self.n * (int(np.abs(gap).max(initial=0)) + 1)
        if x.shape[1] * largest**2 < 2**63:
            return ((self.n * gap - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        return [sum(v * v for v in row) for row in (self.n * gap.astype(object) - self.rest)]


def float_of(a: int, b: int) -> float:
    """a / b of integers of any size, rounded once."""
    return int(a) / int(b)


def _moments(white: Whitener):
    """A task's number, means and centred products of whitened vectors, put together batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, x in matrices(batches):
            z = white.whitened(x)
            mean = z.mean(0)
            parts = [together([*parts, (len(z), mean, (z - mean).T @ (z - mean))])]
        if parts:
            yield _moments_row(parts[0])

    return run


def together(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


MOMENTS = "n long, mean array<double>, m2 array<double>"


def _moments_row(x: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]], pa.list_(pa.float64())), pa.array([x[2].ravel()], pa.list_(pa.float64()))], ["n", "mean", "m2"])


def _unpacked(rows: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), -1)) for r in rows.to_pylist()]


def _joined(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_moments_row(together(_unpacked(rows)))])


def _results(white: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches):
            z = white.whitened(x)
            deviations = [v if v < 10**38 else None for v in white.deviations(x)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(deviations, pa.decimal128(38, 0)), pa.array(list(z), pa.list_(pa.float64()))], ["row", "deviation", "whitened"])

    return run


def vectors(embeddings: DataFrame, vector_col: str) -> DataFrame:
    """row (all columns of embeddings), and x: the entries as integers, of vectors that take part."""
    v = F.col(f"`{vector_col.replace('`', '``')}`").cast("array<double>")
    whole = F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    own = [F.col(f"`{c.replace('`', '``')}`") for c in embeddings.columns]
    return embeddings.where(v.isNotNull() & (F.size(v) > 0) & fits).select(F.struct(*own).alias("row"), whole.cast("array<long>").alias("x"))


def whiten(spark: SparkSession, embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitener, float]:
    """Whitened vectors, the map that made them and its error.

    The first has one row per vector that takes part: `row` (a struct of all columns of embeddings, whatever their names), deviation
    (decimal(38, 0); null from 10^38) and whitened (array<double>, one entry per component). The error is the largest absolute entry of the
    whitened vectors' covariance, measured over all of them, minus the identity.

    An entry c counts as floor(64 * c) + 1000000. Null and empty vectors and those with entries that are null, not finite or
    of a magnitude of 2^56 or more take no part, nor do those of another length than most (the longer of two such lengths). Repeated rows count
    as often as they come. Components without variance in double precision (fewer vectors than dimensions, constant
    vectors) are left out, so there are fewer or none. An empty table gives no rows and no components.
    """
    seen = vectors(embeddings, vector_col)
    lengths = seen.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    seen = seen.where(F.size("x") == d)
    bare = seen.select("x")
    each = bare.mapInArrow(_sums, "i long, n long, high long, low long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    per = sorted(each.groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect(), key=lambda r: r["i"])
    n, sums = (per[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in per]) if per else (0, [])
    largest = max((max(abs(n * r["most"] - s), abs(n * r["least"] - s)) for r, s in zip(per, sums, strict=True)), default=0)
    mods = primes(2 * n * largest**2)
    parts = bare.mapInArrow(_scatter(n, sums, mods), "k int, i int, v array<long>").withColumn("at", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    reduced = parts.groupBy("k", "i", "at").applyInArrow(_added(mods), "k int, i int, v array<long>").groupBy("k", "i").applyInArrow(_added(mods), "k int, i int, v array<long>")
    residues = [np.zeros((d, d), np.int64) for _ in mods]
    for r in reduced.collect() if n and mods else ():
        residues[r["k"]][r["i"]] = r["v"]
    scatter = remainder(residues, mods) if mods else np.zeros((d, d), object)
    white = Whitener(n, sums, scatter, components)

    error = 0.0
    if len(white.e):
        moments = bare.mapInArrow(_moments(white), MOMENTS).withColumn("at", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        found = moments.groupBy("at").applyInArrow(_joined, MOMENTS).collect()
        total, _, m2 = together([(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(white.e), -1)) for r in found])
        error = float(np.abs(m2 / total - np.eye(len(white.e))).max())
    schema = T.StructType([seen.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return seen.mapInArrow(_results(white), schema), white, error


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, white, error = whiten(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(e / white.trace)) for e in white.e]).cast("array<double>")
    each = rows.select(F.col("row.vec_id").alias("vec_id"), F.lit(white.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
