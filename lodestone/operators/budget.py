"""Compute-budget curves: which queries should get the expensive second stage?

Each policy is one row number over the query table; a budget is a cut of it, so
the whole curve is one explode over 21 budgets and one grouped aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, ratio
from .stats import SEED

#: The preregistered thresholds of the budget study.
TOLERANCE = 0.01
GAIN = 0.01
FULL_GAIN = 0.02
FRACTION = 0.20
B_STAR = 50
CONTROL_GAP = 0.01
RETENTION = 0.98
NO_GO_GAIN = 0.01
NO_GO_B_STAR = 70


def policies(metrics: DataFrame) -> DataFrame:
    """``metrics`` with gain and the place of each query under every policy."""
    d = metrics.withColumn("gain", F.col("ndcg_full") - F.col("ndcg_stage1"))
    whole = Window.partitionBy(F.lit(0))
    orders = {
        "oracle": F.desc("gain"), "margin": F.asc("stage1_margin"),
        "latency": F.desc(F.try_divide("gain", "stage2_ms")), "flops": F.desc(F.try_divide("gain", "stage2_flops")),
    }
    return d.withColumns({f"{k}_place": F.row_number().over(whole.orderBy(o, "query_id")) for k, o in orders.items()}).withColumn("n", F.count(F.lit(1)).over(whole))


def _mix(place: str, stage1: str, full: str) -> Column:
    return F.avg(F.when(F.col(place) <= F.col("invocations"), F.col(full)).otherwise(F.col(stage1)))


def curve(metrics: DataFrame) -> DataFrame:
    """One row a budget of 0, 5, ... 100 percent. The random arm is its
    expectation: the mean moves linearly with the share of queries chosen."""
    d = policies(metrics).withColumn("budget_percent", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5))))
    d = d.withColumn("invocations", half_even(F.col("n") * F.col("budget_percent") / 100.0))
    chosen = lambda p: F.col(f"{p}_place") <= F.col("invocations")
    spent = lambda p, c: F.sum(F.when(chosen(p), F.col(c)).otherwise(0.0))
    extra = []
    for m in ("recall1", "recall3", "mrr10"):
        if f"{m}_stage1" in metrics.columns:
            extra += [_mix("oracle_place", f"{m}_stage1", f"{m}_full").alias(f"oracle_{m}"), F.avg(f"{m}_stage1").alias(f"cheap_{m}"), F.avg(f"{m}_full").alias(f"full_{m}")]
    return d.groupBy("budget_percent", "invocations").agg(
        *[_mix(f"{p}_place", "ndcg_stage1", "ndcg_full").alias(f"{p}_ndcg10") for p in ("oracle", "margin", "latency", "flops")],
        (F.avg("ndcg_stage1") + (F.avg("ndcg_full") - F.avg("ndcg_stage1")) * F.first("invocations") / F.first("n")).alias("random_ndcg10"),
        F.avg("ndcg_stage1").alias("cheap_ndcg10"), F.avg("ndcg_full").alias("full_ndcg10"),
        spent("oracle", "stage2_ms").alias("oracle_stage2_ms"), spent("oracle", "stage2_flops").alias("oracle_stage2_flops"),
        spent("latency", "stage2_ms").alias("latency_stage2_ms"), spent("flops", "stage2_flops").alias("flops_stage2_flops"), *extra,
    )


def random_arm(metrics: DataFrame, repeats: int = 100, seed: int = SEED) -> DataFrame:
    """(budget_percent, random_ndcg10) by NumPy's generator, one stream over all
    budgets in ascending order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        a, b = pdf["ndcg_stage1"].to_numpy(float), pdf["ndcg_full"].to_numpy(float)
        rng, rows = np.random.default_rng(seed), []
        for budget in range(0, 101, 5):
            k, means = int(round(len(a) * budget / 100.0)), []
            for _ in range(repeats):
                x = a.copy()
                if k:
                    pick = rng.choice(len(a), size=k, replace=False)
                    x[pick] = b[pick]
                means.append(x.mean())
            rows.append((budget, float(np.mean(means))))
        return pd.DataFrame(rows, columns=["budget_percent", "random_ndcg10"])

    return metrics.select("query_id", "ndcg_stage1", "ndcg_full").groupBy().applyInPandas(run, "budget_percent int, random_ndcg10 double")


def b_star(points: DataFrame) -> DataFrame:
    """One row: the smallest budget whose oracle keeps quality and retention."""
    kept = F.coalesce(ratio("oracle_ndcg10", "full_ndcg10"), F.lit(1.0))
    good = (F.col("oracle_ndcg10") >= F.col("full_ndcg10") - TOLERANCE) & (kept >= RETENTION)
    return points.agg(F.coalesce(F.min(F.when(good, F.col("budget_percent"))), F.lit(100)).alias("b_star"))


def per_query(metrics: DataFrame, star: DataFrame) -> DataFrame:
    d = policies(metrics).crossJoin(F.broadcast(star))
    chosen = F.col("oracle_place") <= half_even(F.col("n") * F.col("b_star") / 100.0)
    return d.select("query_id", "source", "ndcg_stage1", "ndcg_full", F.col("gain").alias("delta_ndcg10"), (F.col("gain") > GAIN).alias("beneficial"), chosen.alias("selected_at_b_star"), "stage2_ms", "stage2_flops")


def summary(metrics: DataFrame, points: DataFrame) -> DataFrame:
    """One row of means, fractions and the chosen budget; retention_low is added
    by ``gate`` where a bootstrap is given."""
    star = b_star(points)
    at = points.join(F.broadcast(star), F.col("budget_percent") == F.col("b_star"))
    at = at.select("b_star", F.col("oracle_ndcg10").alias("quality_at_b_star"), (F.col("oracle_ndcg10") - F.greatest("margin_ndcg10", "random_ndcg10")).alias("control_gap"))
    gain = F.col("ndcg_full") - F.col("ndcg_stage1")
    base = metrics.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("ndcg_stage1").alias("mean_stage1"), F.avg("ndcg_full").alias("mean_full"),
        (F.avg("ndcg_full") - F.avg("ndcg_stage1")).alias("full_minus_stage1"), F.avg((gain > GAIN).cast("double")).alias("beneficial_fraction"),
    )
    return base.crossJoin(at).withColumn("non_beneficial_fraction", 1.0 - F.col("beneficial_fraction"))


def gate(row: DataFrame, retention_low=None) -> DataFrame:
    """``row`` with gate: pass, fail or inconclusive."""
    kept = F.lit(1.0) if retention_low is None else retention_low
    strong = (
        (F.col("full_minus_stage1") >= FULL_GAIN) & (F.col("beneficial_fraction") >= FRACTION) & (F.col("non_beneficial_fraction") >= FRACTION)
        & (F.col("b_star") <= B_STAR) & (F.col("control_gap") >= CONTROL_GAP) & (kept >= RETENTION)
    )
    bad = (F.col("full_minus_stage1") < NO_GO_GAIN) | (F.col("b_star") > NO_GO_B_STAR)
    return row.withColumn("gate", F.when(strong, "pass").when(bad, "fail").otherwise("inconclusive"))
