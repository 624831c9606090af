"""Exact quantiles of groups whose values no task holds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import stats

SHARES = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}


def both(df, keys):
    want = df.groupBy(*keys).agg(*[F.percentile("v", q).alias(n) for n, q in SHARES.items()])
    rows = lambda d: sorted((str(tuple(r)) for r in d.select(*keys, *[F.round(n, 9) for n in SHARES]).collect()))
    return rows(stats.quantiles(df, "v", SHARES, keys)), rows(want)


@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_equal_to_percentile(spark, keys, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 90)
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 1), rng.choice([rng.random(), round(rng.random(), 1), 0.5, *odd[:1], odd[3], odd[4]])) for _ in range(900)]
    rows += [("one", 0, 3.0), ("none", 0, None), ("none", 0, None), ("same", 1, 2.0), ("same", 1, 2.0), ("odd", 1, odd[1]), ("odd", 1, 1.0), ("odd", 1, odd[2]), ("odd", 1, odd[1])]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    got, want = both(df, keys)
    assert got == want
    got, want = both(df.where("false"), keys)
    assert got == want
    got, want = both(df.withColumn("v", F.expr("cast(if(isnan(v) or v > 1e9, 7, v) * 100 as int)")), keys)
    assert got == want


def test_queries_hold_no_group_in_a_task(spark, sf):
    from lodestone.plans.queries_audit import e16
    from lodestone.plans.queries_text import i18

    plans = [q(spark, sf)._jdf.queryExecution().executedPlan().toString() for q in (i18, e16)]
    assert not any("percentile" in p or "ObjectHashAggregate" in p for p in plans)
