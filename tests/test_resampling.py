"""Resampling over many tasks gives the numbers of one generator."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.operators import stats


@pytest.mark.parametrize("n", [2, 3, 7, 1000, 2**31 + 12345, 3_000_000_001])
def test_draws_are_the_generators(n):
    want = np.random.default_rng(9).integers(0, n, 40_000)
    parts = [stats._draws(9, at, 5_000, n) for at in range(0, 90_000, 5_000)]
    assert (np.concatenate(parts)[:40_000] == want).all()


def values(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"q{i:05d}", float(rng.normal()), float(rng.random() * (i % 3 > 0))) for i in range(n)]
    return rows, spark.createDataFrame(rows[::-1], "query_id string, a double, b double").repartition(3)


@pytest.mark.parametrize("n,resamples,words", [(1, 50, 1024), (37, 600, 1024), (1000, 999, 1 << 16), (513, 300, 1 << 22)])
def test_intervals_equal_numpy(spark, n, resamples, words):
    rows, df = values(spark, n)
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    pick = np.random.default_rng(stats.SEED).integers(0, n, (resamples, n))
    want = np.quantile(a[pick].mean(1), [0.025, 0.975])
    got = stats.bootstrap_mean(df, "a", resamples, words=words).first()
    assert (got.low, got.high) == (pytest.approx(want[0], abs=1e-15), pytest.approx(want[1], abs=1e-15))
    x, y = a[pick].mean(1), b[pick].mean(1)
    want = np.quantile(np.where(np.abs(y) > 1e-15, x / np.where(y == 0, 1, y), 1.0), [0.025, 0.975])
    got = stats.bootstrap_ratio(df, "a", "b", resamples, words=words).first()
    assert (got.low, got.high) == (pytest.approx(want[0], abs=1e-14), pytest.approx(want[1], abs=1e-14))


def test_each_resample_bit_by_bit(spark):
    rows, df = values(spark, 211)
    a = np.array([r[1] for r in rows])
    pick = np.random.default_rng(5).integers(0, 211, (400, 211))
    got = stats._resampled(df, ["a"], "query_id", 400, 5, lambda x: x, 2048)
    assert got.rdd.getNumPartitions() > 20
    assert sorted(r.v for r in got.collect()) == sorted(a[pick].mean(1).tolist())


def test_no_rows(spark):
    _, df = values(spark, 3)
    assert stats.bootstrap_mean(df.where("false"), "a").first().low is None


def test_standard_library_stream_in_chunks(spark, monkeypatch):
    rows, df = values(spark, 53)
    rng, a = random.Random(stats.SEED), [r[1] for r in rows]
    means = [np.mean([a[rng.randrange(53)] for _ in a]) for _ in range(200)]
    monkeypatch.setattr(stats, "CHUNK", 53 * 7)
    got = stats.paired_bootstrap(df.withColumnRenamed("a", "delta"), resamples=200).first()
    assert (got.low, got.high) == (pytest.approx(np.quantile(means, 0.025), abs=1e-12), pytest.approx(np.quantile(means, 0.975), abs=1e-12))


@pytest.mark.parametrize("n,resamples", [(1, 7), (9, 30), (1234, 113)])
def test_hashed_draws_are_md5s_and_no_rows(spark, n, resamples, monkeypatch):
    monkeypatch.setattr(stats, "HASHED", 100)
    monkeypatch.setattr(stats, "BLOCK", 64)
    rows, df = values(spark, n)
    x = [None if i % 5 == 4 else r[1] for i, r in enumerate(rows)]
    df = spark.createDataFrame([(r[0], v) for r, v in zip(rows, x)][::-1], "query_id string, a double").repartition(3)
    means = []
    for b in range(resamples):
        picked = [x[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]
        means.append(np.mean([v for v in picked if v is not None]))
    want = np.quantile(means, [0.025, 0.975])
    got = stats.bootstrap_hashed(df, "a", resamples)
    assert got.first().low == pytest.approx(want[0], abs=1e-12) and got.first().high == pytest.approx(want[1], abs=1e-12)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan  # a draw is no row, the list in no single task


def test_hashed_without_rows(spark):
    _, df = values(spark, 3)
    assert stats.bootstrap_hashed(df.where("false"), "a", 10).first().low is None
