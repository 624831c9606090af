"""Gates whose inputs are all measured on the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import budget, decisions, oracle, stats
from ..sources.scratch import scratch

from . import adapters as ad

from .queries_search import _BUDGET, _ROWS, W7, _metrics
from .registry import query


_HALF = "CAST(query_id AS BIGINT) % 2"


def _half_sql(h: int) -> str:
    """One row with the six inputs of a half."""
    base = _BUDGET.replace("WITH q AS (", f"WITH q AS (SELECT * FROM (", 1).replace("), g AS (", f") WHERE {_HALF} = {h}), g AS (", 1)
    return f"""({base}, s AS (SELECT avg(ndcg_full) AS mean_full, avg(ndcg_full) - avg(ndcg_stage1) AS full_minus_stage1, avg(CAST(gain > 0.01 AS DOUBLE)) AS beneficial_fraction FROM g),
  a AS (SELECT b_star, oracle_ndcg10, oracle_ndcg10 - greatest(margin_ndcg10, random_ndcg10) AS control_gap FROM cv JOIN st ON budget_percent = b_star)
  SELECT full_minus_stage1, beneficial_fraction, 1.0 - beneficial_fraction AS non_beneficial_fraction, b_star, control_gap, coalesce(oracle_ndcg10 / nullif(mean_full, 0), 1.0) AS retention FROM s, a)"""


_STRONG = "{0}.full_minus_stage1 >= 0.02 AND {0}.beneficial_fraction >= 0.2 AND {0}.non_beneficial_fraction >= 0.2 AND {0}.b_star <= 50 AND {0}.control_gap >= 0.01 AND {0}.retention >= 0.98"


@query("r3_budget_gate_on_data", f"""SELECT x.b_star AS discovery_b_star, y.b_star AS confirmation_b_star, y.full_minus_stage1, y.beneficial_fraction, y.control_gap, y.retention,
  CASE WHEN {_STRONG.format('x')} AND {_STRONG.format('y')} THEN 'pass' WHEN y.full_minus_stage1 < 0.01 OR y.b_star > 70 THEN 'fail' ELSE 'inconclusive' END AS budget_gate FROM {_half_sql(0)} x, {_half_sql(1)} y""", "full_minus_stage1 beneficial_fraction control_gap retention")
def r3(spark, d):
    """Queries with even numbers are the discovery sample, the others confirm;
    retention is what the chosen budget keeps of the full quality."""
    m = _metrics(spark, d)

    def half(h: int, name: str) -> DataFrame:
        own = m.where(F.expr(f"cast(query_id as bigint) % 2 = {h}"))
        s = budget.summary(own, budget.curve(own)).withColumn("retention_low", F.coalesce(F.try_divide("quality_at_b_star", "mean_full"), F.lit(1.0)))
        return s.select(F.struct("full_minus_stage1", "beneficial_fraction", "non_beneficial_fraction", "b_star", "control_gap", "retention_low").alias(name))

    both = half(0, "discovery").crossJoin(half(1, "confirmation"))
    c = lambda name: F.col(f"confirmation.{name}")
    return both.select(F.col("discovery.b_star").alias("discovery_b_star"), c("b_star").alias("confirmation_b_star"), c("full_minus_stage1"), c("beneficial_fraction"), c("control_gap"), c("retention_low").alias("retention"), decisions.budget_confirmation().alias("budget_gate"))


_LOW = "avg(delta) - 1.96 * coalesce(stddev_samp(delta), 0) / sqrt(CAST(count(*) AS DOUBLE))"


@query("r5_r7_outcomes_on_data", f"""{_ROWS}, src AS (SELECT query_id, any_value(source) AS source FROM raw GROUP BY 1), e AS (SELECT o.query_id, delta, source FROM o JOIN src USING (query_id)),
  k AS (SELECT source, CAST(sum(CASE WHEN in_pool THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS coverage FROM (SELECT r.source, n.page_id IS NOT NULL AS in_pool FROM raw r LEFT JOIN norm n USING (query_id, page_id) WHERE r.relevance > 0) GROUP BY 1),
  t AS (SELECT *, greatest(delta, 0) AS x, row_number() OVER (PARTITION BY source ORDER BY greatest(delta, 0) DESC) AS r, count(*) OVER (PARTITION BY source) AS n FROM e),
  g AS (SELECT source, count(*) AS queries, avg(delta) AS mean_delta, {_LOW} AS low, avg(CAST(delta >= 0.03 AS DOUBLE)) AS gain_ge_003, coalesce(sum(CASE WHEN r <= greatest(1, ceil(0.05 * n)) THEN x END) / nullif(sum(x), 0), 0.0) AS top_5pct_share FROM t GROUP BY 1)
  SELECT source, queries, mean_delta, low, gain_ge_003, top_5pct_share, coalesce(coverage, 1.0) AS coverage,
    CASE WHEN coalesce(coverage, 1.0) < 0.95 THEN 'invalid_candidate_coverage' WHEN mean_delta >= 0.03 AND low > 0 AND gain_ge_003 >= 0.1 AND top_5pct_share < 0.9 THEN 'strong_signal' WHEN mean_delta >= 0.01 AND low > 0 AND gain_ge_003 >= 0.1 AND top_5pct_share < 0.9 THEN 'feasible_signal' ELSE 'no_clear_signal' END AS pilot,
    CASE WHEN coalesce(coverage, 1.0) < 0.95 THEN 'BLOCKED' WHEN mean_delta < 0.01 THEN 'NO-GO' WHEN low <= 0 THEN 'LIMITED' ELSE 'GO' END AS outcome FROM g LEFT JOIN k USING (source)""", "mean_delta low gain_ge_003 top_5pct_share coverage")
def r5(spark, d):
    """A pilot of each source: what a query's own profile brings over the one for
    all, and how much of the relevant pages the pool holds."""
    positive = F.count_if(F.col("relevance") > 0)
    rows = scratch(ad.labelled(spark, d), "rows")
    per = ad.raw(spark, d).groupBy("query_id").agg(F.first("source").alias("source"), positive.alias("wanted")).join(rows.groupBy("query_id").agg(positive.alias("held")), "query_id", "left")
    found = oracle.oracle_rows(rows, W7, metrics=scratch(oracle.profile_metrics(rows, W7), "metrics"))
    per = scratch(per.join(found.select("query_id", "delta"), "query_id", "left"), "queries")  # a row a query
    deltas = per.where("delta IS NOT NULL")
    x = F.col("delta")
    low = F.avg(x) - 1.96 * F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)).cast("double"))
    g = deltas.groupBy("source").agg(F.count(F.lit(1)).alias("queries"), F.avg(x).alias("mean_delta"), low.alias("low"), F.avg((x >= 0.03).cast("double")).alias("gain_ge_003"))
    shares = [stats.top_share(deltas.where(F.col("source") == s), "delta").withColumn("source", F.lit(s)) for s in ("chart", "table")]
    cover = per.groupBy("source").agg(F.try_divide(F.coalesce(F.sum("held"), F.lit(0)), F.sum("wanted")).alias("coverage"))
    g = g.join(reduce(DataFrame.unionByName, shares), "source").join(cover, "source", "left").na.fill(1.0, ["coverage"])
    outcome = decisions.outcome(F.col("coverage") < 0.95, F.col("mean_delta") < 0.01, F.col("low") <= 0)
    return g.withColumns({"pilot": decisions.feasibility(), "outcome": outcome})
