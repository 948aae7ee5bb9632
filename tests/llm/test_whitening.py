import math
from fractions import Fraction

import numpy as np
import pytest

from sentrel.llm import whitening
from sentrel.llm.whitening import Whitener, op13_whitening, primes, remainder, whiten

SCHEMA = "vec_id long, embedding array<float>, row int, x string, `a.b` int"


def rows_of(n=300, d=7, seed=2):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 5).astype(np.float32)
    good = [(i if i % 50 else None, x.tolist(), 1, "x", 2) for i, x in enumerate(v)]
    bad = [None, [], [None] + [0.0] * (d - 1), [math.nan] + [0.0] * (d - 1), [math.inf] + [0.0] * (d - 1), [1e30] + [0.0] * (d - 1), [1.0] * (d + 1)]
    return good + good[:9], [(1000 + i, x, 1, "x", 2) for i, x in enumerate(bad)]


def by_hand(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return x, n, sums, [sum(c * c for c in r) for r in y], np.array([[float(c) for c in r] for r in cov])


@pytest.mark.parametrize("block,fan_in", [(1 << 13, 64), (5, 2)])
def test_against_whole_numbers(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    good, bad = rows_of()
    got, white, error = whiten(spark, spark.createDataFrame(good + bad, SCHEMA).repartition(7), components=4)
    x, n, sums, deviations, cov = by_hand([r[1] for r in good])
    assert (white.n, white.sums) == (n, sums) and error < 1e-9
    e, w = np.linalg.eigh(cov)
    assert np.allclose(white.e, e[::-1][:4], rtol=1e-12) and np.isclose(white.trace, np.trace(cov), rtol=1e-14)
    rows = got.collect()
    assert sorted((str(r["row"]["vec_id"]), int(r["deviation"])) for r in rows) == sorted((str(r[0]), v) for r, v in zip(good, deviations, strict=True))
    mean = np.array([float(Fraction(s, n)) for s in sums])
    for r in rows:
        i = next(i for i, g in enumerate(good) if g[1] == r["row"]["embedding"])
        want = (np.array(x[i]) - mean) @ w[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
        assert np.allclose(np.abs(r["whitened"]), np.abs(want), atol=1e-7) and r["row"]["a.b"] == 2


def test_scatter_is_exact_for_very_large_entries(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(np.float32(v)) for v in row] for row in rng.normal(size=(40, 3)) * 1e12]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, white, error = whiten(spark, df)
    _, n, sums, deviations, cov = by_hand(vectors)
    assert white.sums == sums and np.allclose(white.e, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12) and error < 1e-9
    assert {r["row"]["vec_id"]: int(r["deviation"]) for r in got.collect()} == dict(enumerate(deviations))


@pytest.mark.parametrize("vectors,components", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]], 1)])
def test_few_vectors(spark, vectors, components):
    got, white, error = whiten(spark, spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    rows = got.collect()
    assert len(rows) == len(vectors) and len(white.e) == components and all(len(r["whitened"]) == components for r in rows) and error < 1e-12


def test_remainders():
    for bound in (0, 1, 10**6, 10**40):
        mods = primes(bound)
        assert math.prod(mods) > bound and len(set(mods)) == len(mods) and all(m < 1 << 20 for m in mods)
    mods = primes(2 * 10**40)
    v = np.array([[0, -1, 10**40], [-(10**40), 7, 10**20 + 1]], object)
    assert (remainder([v % p for p in mods], mods) == v).all()


def test_deviations_beyond_a_long_are_whole_numbers():
    white = Whitener.__new__(Whitener)
    white.n, white.whole, white.rest = 10**10, np.array([3, -5], np.int64), np.array([1, 2], object)
    x = np.array([[10**6, -(10**6)], [3, -5]], np.int64)
    assert white.deviations(x) == [(10**10 * (10**6 - 3) - 1) ** 2 + (10**10 * (5 - 10**6) - 2) ** 2, 5]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None}
    got = op13_whitening(spark, sf).toPandas()
    _, n, _, deviations, cov = by_hand(list(vectors.values()))
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert got.groupby("vec_id")["deviation"].first().to_dict() == dict(zip(vectors, deviations, strict=True))
    e = np.linalg.eigvalsh(cov)[::-1][:32]
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(cov), rtol=1e-10)
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-9
