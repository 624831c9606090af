"""Queries of weight searches, budgets, statistics, gates and the learned gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import budget, decisions, gate, metrics, normalize, oracle, page_oracle, stats, training
from ..operators.contracts import CHANNELS
from ..sources.scratch import scratch

from . import adapters as ad
from .queries_core import _QM, METRICS
from .registry import query

W7, W66 = oracle.W7, oracle.simplex(10)


def _profile_sql(profiles) -> str:
    """norm, grid and pm(query_id, profile, metrics rounded for comparison)."""
    fused = "(SELECT n.query_id, g.profile, n.page_id, n.relevance, wa * bm25_score + wb * dense_score + wc * visual_score AS score FROM norm n, grid g)"
    return f"WITH {ad.NORM}, {ad.profiles_sql(profiles)}, pm AS (SELECT query_id, profile, round(ndcg10, 9) AS ndcg10, round(recall1, 9) AS recall1, round(recall3, 9) AS recall3, round(mrr10, 9) AS mrr10 FROM {ad.evaluate_sql(fused, 'score', 'query_id, profile')})"


_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY ndcg10 DESC, recall3 DESC, mrr10 DESC, profile)"
_PM7 = _profile_sql(W7)
_GLOBAL = "gm AS (SELECT profile, round(avg(ndcg10), 9) AS ndcg10, round(avg(recall1), 9) AS recall1, round(avg(recall3), 9) AS recall3, round(avg(mrr10), 9) AS mrr10 FROM pm GROUP BY 1), gb AS (SELECT * FROM gm ORDER BY ndcg10 DESC, recall3 DESC, mrr10 DESC, profile LIMIT 1)"


@query("m8_profile_grid", f"{_profile_sql(W66)}, a AS (SELECT profile, avg(ndcg10) AS ndcg10, avg(mrr10) AS mrr10 FROM pm GROUP BY 1) SELECT profile, wa AS w_bm25, wb AS w_dense, wc AS w_visual, ndcg10, mrr10 FROM grid JOIN a USING (profile)", "w_bm25 w_dense w_visual ndcg10 mrr10")
def m8(spark, d):
    """The profiles of the fine grid with what each brings on these tables."""
    means = oracle.global_means(oracle.profile_metrics(ad.labelled(spark, d), W66)).select("profile", "ndcg10", "mrr10")
    return oracle.grid_table(spark, oracle.grid("w66")).join(means, "profile")


@query("m_profile_metrics", f"{_PM7} SELECT * FROM pm", METRICS)
def m0(spark, d):
    """The (query, profile) metric table that every search reads."""
    return oracle.profile_metrics(ad.labelled(spark, d), W7)


@query("m_fixed_profile_audit", f"""WITH {ad.RAW}, norm AS (SELECT query_id, page_id, relevance, {", ".join(f"{ad.minmax_sql(c)} AS {c}" for c in CHANNELS)} FROM raw WINDOW w AS (PARTITION BY query_id)), {ad.profiles_sql(W7)},
  pm AS (SELECT * FROM {ad.evaluate_sql("(SELECT n.query_id, g.profile, n.page_id, n.relevance, wa * bm25_score + wb * dense_score + wc * visual_score AS score FROM norm n, grid g)", "score", "query_id, profile")})
  SELECT profile, avg(ndcg10) AS ndcg10, avg(recall1) AS recall1, avg(recall3) AS recall3, avg(mrr10) AS mrr10 FROM pm GROUP BY 1""", METRICS)
def fixed_audit(spark, d):
    """Every profile over the whole score table, without a pool."""
    rows = normalize.minmax(ad.scores(spark, d))
    return oracle.global_means(oracle.profile_metrics(ad.with_labels(rows, ad.qrels(spark, d)), W7))


@query("m2_global_oracle", f"{_PM7}, {_GLOBAL} SELECT * FROM gb", METRICS)
def m2(spark, d):
    return oracle.global_oracle(oracle.profile_metrics(ad.labelled(spark, d), W7))


@query("m1_m3_query_oracle", f"{_PM7} SELECT query_id, profile, ndcg10, recall1, recall3, mrr10 FROM (SELECT *, {_BEST} AS r FROM pm) WHERE r = 1", METRICS)
def m3(spark, d):
    return oracle.query_oracle(oracle.profile_metrics(ad.labelled(spark, d), W7))


@query("m3_query_oracle_w66", f"{_profile_sql(W66)} SELECT query_id, ndcg10 FROM (SELECT *, {_BEST} AS r FROM pm) WHERE r = 1", "ndcg10")
def m3b(spark, d):
    return oracle.query_oracle(oracle.profile_metrics(ad.labelled(spark, d), W66)).select("query_id", "ndcg10")


_ROWS = f"""{_PM7}, {_GLOBAL}, q AS (SELECT query_id, profile AS query_profile, ndcg10 AS query_ndcg10 FROM (SELECT *, {_BEST} AS r FROM pm) WHERE r = 1),
  o AS (SELECT q.query_id, gb.profile AS global_profile, pm.ndcg10 AS global_ndcg10, query_profile, query_ndcg10, query_ndcg10 - pm.ndcg10 AS delta FROM q, gb JOIN pm ON pm.query_id = q.query_id AND pm.profile = gb.profile)"""


@query("m6_oracle_rows", f"{_ROWS} SELECT * FROM o", "global_ndcg10 query_ndcg10 delta")
def m6(spark, d):
    return oracle.oracle_rows(ad.labelled(spark, d), W7)


@query("e8_gain_summary", f"""{_ROWS}, t AS (SELECT greatest(delta, 0) AS x, row_number() OVER (ORDER BY greatest(delta, 0) DESC) AS r, count(*) OVER () AS n FROM o)
  SELECT count(*) AS queries, avg(delta) AS mean_delta, avg(CAST(delta >= 0.01 AS DOUBLE)) AS gain_ge_001, avg(CAST(delta >= 0.03 AS DOUBLE)) AS gain_ge_003, avg(CAST(delta >= 0.05 AS DOUBLE)) AS gain_ge_005,
  (SELECT coalesce(sum(CASE WHEN r <= greatest(1, ceil(0.05 * n)) THEN x END) / nullif(sum(x), 0), 0.0) FROM t) AS top_5pct_share FROM o""", "mean_delta gain_ge_001 gain_ge_003 gain_ge_005 top_5pct_share")
def e8(spark, d):
    """Share of the largest gains."""
    return oracle.gain_summary(oracle.oracle_rows(ad.labelled(spark, d), W7))


@query("e9_profile_usage", f"{_ROWS} SELECT g.profile, count(o.query_id) AS queries FROM grid g LEFT JOIN o ON o.query_profile = g.profile GROUP BY 1")
def e9(spark, d):
    return oracle.profile_usage(oracle.oracle_rows(ad.labelled(spark, d), W7), len(W7))


@query("e7_subgroups", f"{_ROWS}, s AS (SELECT query_id, any_value(source) AS source, CASE WHEN count(CASE WHEN relevance > 0 THEN 1 END) > 1 THEN 'multi' ELSE 'single' END AS relevance_group FROM raw GROUP BY 1) SELECT source, relevance_group, count(*) AS queries, avg(delta) AS mean_delta FROM o JOIN s USING (query_id) GROUP BY 1, 2", "mean_delta")
def e7(spark, d):
    s = ad.raw(spark, d).groupBy("query_id").agg(F.first("source").alias("source"), F.when(F.count_if(F.col("relevance") > 0) > 1, "multi").otherwise("single").alias("relevance_group"))
    return oracle.oracle_rows(ad.labelled(spark, d), W7).join(s, "query_id").groupBy("source", "relevance_group").agg(F.count(F.lit(1)).alias("queries"), F.avg("delta").alias("mean_delta"))


@query("e10_e11_win_tie_loss", f"{_ROWS} SELECT count(CASE WHEN delta > 1e-9 THEN 1 END) AS wins, count(CASE WHEN abs(delta) <= 1e-9 THEN 1 END) AS ties, count(CASE WHEN delta < -1e-9 THEN 1 END) AS losses, count(CASE WHEN query_ndcg10 >= 1 - 1e-9 THEN 1 END) AS at_ceiling, avg(greatest(0, 1 - query_ndcg10)) AS headroom FROM o", "headroom")
def e10(spark, d):
    o = oracle.oracle_rows(ad.labelled(spark, d), W7)
    return o.agg(*stats.win_tie_loss("delta", 1e-9), F.count_if(F.col("query_ndcg10") >= 1 - 1e-9).alias("at_ceiling"), F.avg(F.greatest(F.lit(0.0), 1.0 - F.col("query_ndcg10"))).alias("headroom"))


_FUSED7 = ", ".join(f"{a!r}::DOUBLE * bm25_score + {b!r}::DOUBLE * dense_score + {c!r}::DOUBLE * visual_score" for a, b, c in W7)


@query("m5_page_oracle_binary", f"WITH {ad.NORM}, s AS (SELECT query_id, page_id, relevance, CASE WHEN relevance > 0 THEN greatest({_FUSED7}) ELSE least({_FUSED7}) END AS score FROM norm), tot AS (SELECT query_id, count(CASE WHEN relevance > 0 THEN 1 END) AS relevant_total FROM norm GROUP BY 1) SELECT query_id, ndcg10 FROM {ad.binary_sql('s', 'score', 'tot')}", "ndcg10")
def m5(spark, d):
    return oracle.page_oracle_binary(ad.labelled(spark, d), W7)


@query("m7_three_levels", f"""{_PM7}, b AS (SELECT query_id, page_id, CASE WHEN relevance > 0 THEN 1.0 ELSE 0.0 END AS relevance, bm25_score, dense_score, visual_score FROM norm),
  s AS (SELECT query_id, page_id, relevance, CASE WHEN relevance > 0 THEN greatest({_FUSED7}) ELSE least({_FUSED7}) END AS score FROM b), tot AS (SELECT query_id, count(CASE WHEN relevance > 0 THEN 1 END) AS relevant_total FROM b GROUP BY 1),
  p AS (SELECT n.query_id, g.profile, n.page_id, n.relevance, wa * bm25_score + wb * dense_score + wc * visual_score AS score FROM b n, grid g), q AS (SELECT query_id, max(ndcg10) AS query_level FROM {ad.evaluate_sql('p', 'score', 'query_id, profile')} GROUP BY 1)
  SELECT query_id, query_level, ndcg10 AS page_level FROM q JOIN {ad.binary_sql('s', 'score', 'tot')} USING (query_id)""", "query_level page_level")
def m7(spark, d):
    rows = ad.labelled(spark, d).withColumn("relevance", (F.col("relevance") > 0).cast("double"))
    page = oracle.page_oracle_binary(rows, W7).withColumnRenamed("ndcg10", "page_level")
    best = oracle.profile_metrics(rows, W7).groupBy("query_id").agg(F.max("ndcg10").alias("query_level"))
    return best.join(page, "query_id")


@query("k8_fit_static", f"{_PM7}, a AS (SELECT profile, avg(ndcg10) AS ndcg10 FROM pm GROUP BY 1) SELECT profile, ndcg10 FROM a ORDER BY round(ndcg10, 9) DESC, profile LIMIT 1", "ndcg10")
def k8(spark, d):
    return oracle.fit_static(ad.labelled(spark, d), W7)


@query("m4_page_oracle", None, "query_ndcg10 page_ndcg10")
def m4(spark, d):
    """Coordinate ascent for each page; sequential, so a grouped
    function. Checked against brute force in the tests."""
    return page_oracle.page_oracle(ad.labelled(spark, d), W7).drop("profiles")


@query("m4_query_level", f"{_PM7} SELECT query_id, max(ndcg10) AS query_ndcg10, true AS page_between FROM pm GROUP BY 1", "query_ndcg10")
def m4b(spark, d):
    """The search starts from the best profile of the query; its pages may only
    improve on it, up to the ideal."""
    between = F.col("page_ndcg10").between(F.col("query_ndcg10") - 1e-9, 1 + 1e-9)
    return page_oracle.page_oracle(ad.labelled(spark, d), W7).select("query_id", "query_ndcg10", between.alias("page_between"))


# ------------------------------------------------------------ budget
_BUDGET = f"""WITH q AS ({_QM}), g AS (SELECT *, ndcg_full - ndcg_stage1 AS gain FROM q),
  pl AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY gain DESC, query_id) AS o, row_number() OVER (ORDER BY stage1_margin, query_id) AS m, row_number() OVER (ORDER BY gain / stage2_ms DESC, query_id) AS l, row_number() OVER (ORDER BY gain / stage2_flops DESC, query_id) AS f FROM g),
  b AS (SELECT CAST(5 * i AS INTEGER) AS budget_percent, * FROM pl, range(21) t(i)), c AS (SELECT *, CAST(round_even(n * budget_percent / 100.0::DOUBLE, 0) AS BIGINT) AS invocations FROM b),
  cv AS (SELECT budget_percent, invocations, avg(CASE WHEN o <= invocations THEN ndcg_full ELSE ndcg_stage1 END) AS oracle_ndcg10, avg(CASE WHEN m <= invocations THEN ndcg_full ELSE ndcg_stage1 END) AS margin_ndcg10,
    avg(CASE WHEN l <= invocations THEN ndcg_full ELSE ndcg_stage1 END) AS latency_ndcg10, avg(CASE WHEN f <= invocations THEN ndcg_full ELSE ndcg_stage1 END) AS flops_ndcg10,
    avg(ndcg_stage1) + (avg(ndcg_full) - avg(ndcg_stage1)) * invocations / any_value(n) AS random_ndcg10, avg(ndcg_stage1) AS cheap_ndcg10, avg(ndcg_full) AS full_ndcg10,
    sum(CASE WHEN o <= invocations THEN stage2_ms ELSE 0.0 END) AS oracle_stage2_ms, sum(CASE WHEN o <= invocations THEN stage2_flops ELSE 0.0 END) AS oracle_stage2_flops,
    sum(CASE WHEN l <= invocations THEN stage2_ms ELSE 0.0 END) AS latency_stage2_ms, sum(CASE WHEN f <= invocations THEN stage2_flops ELSE 0.0 END) AS flops_stage2_flops FROM c GROUP BY 1, 2),
  st AS (SELECT coalesce(min(CASE WHEN oracle_ndcg10 >= full_ndcg10 - 0.01 AND coalesce(oracle_ndcg10 / nullif(full_ndcg10, 0), 1.0) >= 0.98 THEN budget_percent END), 100) AS b_star FROM cv)"""
_POINTS = "oracle_ndcg10 margin_ndcg10 latency_ndcg10 flops_ndcg10 random_ndcg10 cheap_ndcg10 full_ndcg10 oracle_stage2_ms oracle_stage2_flops latency_stage2_ms flops_stage2_flops"


def _metrics(spark, d):
    return metrics.query_metrics(ad.raw(spark, d)).withColumns({c: F.round(c, 12) for c in ("ndcg_stage1", "ndcg_full")})


_BUDGET = _BUDGET.replace("a.ndcg10 AS ndcg_stage1, b.ndcg10 AS ndcg_full", "round(a.ndcg10, 12) AS ndcg_stage1, round(b.ndcg10, 12) AS ndcg_full")


@query("m11_budget_curve", f"{_BUDGET} SELECT * FROM cv", _POINTS)
def m11(spark, d):
    return budget.curve(_metrics(spark, d).drop("recall1_stage1", "recall3_stage1", "mrr10_stage1"))


@query("m11_random_arm", None, "random_ndcg10")
def m11b(spark, d):
    """The sampled random arm, by NumPy's generator."""
    return budget.random_arm(_metrics(spark, d))


@query("m12_budget_per_query", f"{_BUDGET} SELECT query_id, source, ndcg_stage1, ndcg_full, gain AS delta_ndcg10, gain > 0.01 AS beneficial, o <= CAST(round_even(n * b_star / 100.0::DOUBLE, 0) AS BIGINT) AS selected_at_b_star, stage2_ms, stage2_flops FROM pl, st", "ndcg_stage1 ndcg_full delta_ndcg10")
def m12(spark, d):
    m = _metrics(spark, d)
    return budget.per_query(m, budget.b_star(budget.curve(m)))


@query("r6_budget_gate", f"""{_BUDGET}, s AS (SELECT count(*) AS queries, avg(ndcg_stage1) AS mean_stage1, avg(ndcg_full) AS mean_full, avg(ndcg_full) - avg(ndcg_stage1) AS full_minus_stage1, avg(CAST(gain > 0.01 AS DOUBLE)) AS beneficial_fraction FROM g),
  a AS (SELECT b_star, oracle_ndcg10 AS quality_at_b_star, oracle_ndcg10 - greatest(margin_ndcg10, random_ndcg10) AS control_gap FROM cv JOIN st ON budget_percent = b_star)
  SELECT *, 1.0 - beneficial_fraction AS non_beneficial_fraction, CASE WHEN full_minus_stage1 >= 0.02 AND beneficial_fraction >= 0.2 AND 1.0 - beneficial_fraction >= 0.2 AND b_star <= 50 AND control_gap >= 0.01 THEN 'pass' WHEN full_minus_stage1 < 0.01 OR b_star > 70 THEN 'fail' ELSE 'inconclusive' END AS gate FROM s, a""", "mean_stage1 mean_full full_minus_stage1 beneficial_fraction quality_at_b_star control_gap non_beneficial_fraction")
def r6(spark, d):
    m = _metrics(spark, d)
    return budget.gate(budget.summary(m, budget.curve(m)))


# ------------------------------------------------------------ statistics
_DELTA = "d AS (SELECT CAST(o_custkey AS VARCHAR) AS query_id, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / 100000 AS delta FROM orders GROUP BY 1)"


def _deltas(spark, d):
    o = ad.table(spark, d, "orders")
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.groupBy(F.col("o_custkey").cast("string").alias("query_id")).agg((F.avg(signed) / 100000).alias("delta"))


@query("n5_paired_summary", f"WITH {_DELTA} SELECT count(*) AS queries, avg(delta) AS mean_delta, median(delta) AS median_delta, stddev_samp(delta) AS std_delta, avg(delta) / stddev_samp(delta) AS effect_size, count(CASE WHEN delta > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(delta) <= 1e-12 THEN 1 END) AS ties, count(CASE WHEN delta < -1e-12 THEN 1 END) AS losses FROM d", "mean_delta median_delta std_delta effect_size")
def n5(spark, d):
    return stats.paired_summary(_deltas(spark, d))


_SEED = "s AS (SELECT o_orderkey % 3 AS seed, CAST(o_custkey AS VARCHAR) AS query_id, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / 100000 AS delta FROM orders GROUP BY 1, 2)"


def _seeds(spark, d):
    o = ad.table(spark, d, "orders")
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.groupBy((F.col("o_orderkey") % 3).alias("seed"), F.col("o_custkey").cast("string").alias("query_id")).agg((F.avg(signed) / 100000).alias("delta"))


@query("n3_seed_report", f"""WITH {_SEED}, d AS (SELECT query_id, avg(delta) AS delta FROM s GROUP BY 1), t AS (SELECT greatest(delta, 0) AS x, row_number() OVER (ORDER BY greatest(delta, 0) DESC) AS r, count(*) OVER () AS n FROM d)
  SELECT count(*) AS queries, avg(delta) AS mean_delta, median(delta) AS median_delta, stddev_samp(delta) AS std_delta, avg(delta) / stddev_samp(delta) AS effect_size, count(CASE WHEN delta > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(delta) <= 1e-12 THEN 1 END) AS ties, count(CASE WHEN delta < -1e-12 THEN 1 END) AS losses,
  (SELECT coalesce(sum(CASE WHEN r <= greatest(1, ceil(0.05 * n)) THEN x END) / nullif(sum(x), 0), 0.0) FROM t) AS top_5pct_share FROM d""", "mean_delta median_delta std_delta effect_size top_5pct_share")
def n3(spark, d):
    return stats.seed_report(_seeds(spark, d))


@query("x12_seed_spread", f"WITH {_SEED}, m AS (SELECT seed, avg(delta) AS m FROM s GROUP BY 1) SELECT count(*) AS seeds, avg(m) AS mean_of_seeds, stddev_samp(m) AS std_of_seeds FROM m", "mean_of_seeds std_of_seeds")
def x12(spark, d):
    return stats.seed_spread(_seeds(spark, d))


@query("d9_paired_deltas", f"WITH {ad.NORM}, a AS (SELECT query_id, ndcg10 FROM {ad.evaluate_sql('norm', 'visual_score')}), b AS (SELECT query_id, ndcg10 FROM {ad.evaluate_sql('norm', 'bm25_score')}) SELECT query_id, a.ndcg10 - b.ndcg10 AS delta FROM a JOIN b USING (query_id)", "delta")
def d9(spark, d):
    rows = ad.labelled(spark, d)
    long = rows.select("query_id", "page_id", "relevance", F.explode(F.map_from_arrays(F.array(F.lit("visual"), F.lit("bm25")), F.array("visual_score", "bm25_score"))).alias("method", "score"))
    return stats.paired(metrics.evaluate(long, "score", ["method", "query_id"]), "visual", "bm25", "ndcg10")


@query("n6_median_split", "WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), m AS (SELECT *, CASE WHEN orders > median(orders) OVER () THEN 'high' ELSE 'low' END AS band FROM c) SELECT band, count(*) AS queries, avg(c_acctbal) AS mean FROM m GROUP BY 1", "mean")
def n6(spark, d):
    o = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    c = ad.table(spark, d, "customer").join(o, "c_custkey", "left").na.fill(0, ["orders"])
    return stats.median_split(c, "orders", "c_acctbal")


@query("n7_spearman", "WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS b FROM customer) SELECT c_mktsegment, corr(a, b) AS rho FROM r GROUP BY 1", "rho")
def n7(spark, d):
    return stats.spearman(ad.table(spark, d, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"])


@query("n1_bootstrap_mean", None, "low high")
def n1(spark, d):
    """NumPy's stream; checked against NumPy in the tests."""
    return stats.bootstrap_mean(_deltas(spark, d), "delta")


@query("n2_bootstrap_ratio", None, "low high")
def n2(spark, d):
    return stats.bootstrap_ratio(_metrics(spark, d), "ndcg_stage1", "ndcg_full")


_HASHED = f"""WITH {_DELTA}, v AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, delta AS x, count(*) OVER () AS n FROM d),
  k AS (SELECT b, CAST('0x' || substr(md5(CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % n AS i FROM v, range(100) t(b)), m AS (SELECT b, avg(x) AS m FROM k JOIN v USING (i) GROUP BY 1)
  SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m"""


@query("n1_bootstrap_hashed", _HASHED, "low high")
def n1c(spark, d):
    return stats.bootstrap_hashed(_deltas(spark, d), "delta", 100)


@query("n1_bootstrap_hashed_whole", _HASHED.replace("range(100)", "range(10000)"), "low high")
def n1d(spark, d):
    """With the study's number of resamples."""
    return stats.bootstrap_hashed(_deltas(spark, d), "delta", 10_000)


# ------------------------------------------------------------ gates
_GROUP = "'g' || CAST(CAST(query_id AS BIGINT) % 5 AS VARCHAR)"


def _group_sql(name: str, profiles) -> str:
    """A row a group of queries: what the best profile of a query brings over the mean one."""
    return f"""(SELECT name, avg(delta) AS {name}_mean_delta, avg(delta) - 1.96::DOUBLE * coalesce(stddev_samp(delta), 0.0) / sqrt(CAST(count(*) AS DOUBLE)) AS {name}_low, avg(CASE WHEN delta >= 0.05 THEN 1.0::DOUBLE ELSE 0.0 END) AS {name}_gain_ge_005,
    coalesce(sum(CASE WHEN r <= greatest(1, ceil(0.05 * n)) THEN delta END) / nullif(sum(delta), 0), 0.0) AS {name}_top_5pct_share
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY delta DESC) AS r, count(*) OVER (PARTITION BY name) AS n FROM (SELECT {_GROUP} AS name, delta FROM ({_profile_sql(profiles)} SELECT query_id, max(ndcg10) - avg(ndcg10) AS delta FROM pm GROUP BY 1))) GROUP BY 1)"""


_GATE = f"""a AS {_group_sql('w7', W7)}, b AS {_group_sql('w66', W66)},
  k AS (SELECT name, avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0.0 END) AS coverage FROM (WITH {ad.NORM} SELECT {_GROUP} AS name, n.page_id IS NOT NULL AS held FROM raw LEFT JOIN norm n USING (query_id, page_id) WHERE raw.relevance > 0) GROUP BY 1),
  f AS (SELECT {_GROUP} AS name, avg(ndcg_full - ndcg_stage1) AS full_gain FROM ({_QM}) GROUP BY 1), g AS (SELECT * FROM a JOIN b USING (name) JOIN k USING (name) JOIN f USING (name))"""


def _gates(spark, d):
    """The inputs of the gates, measured on five groups of queries."""
    group = F.concat(F.lit("g"), F.expr("string(cast(query_id as bigint) % 5)")).alias("name")
    rows, out = scratch(ad.labelled(spark, d), "rows"), None
    for name, grid in (("w7", W7), ("w66", W66)):
        pm = oracle.profile_metrics(rows, grid).withColumn("ndcg10", F.round("ndcg10", 9))
        delta = pm.groupBy("query_id").agg((F.max("ndcg10") - F.avg("ndcg10")).alias("delta")).select(group, "delta")
        w = Window.partitionBy("name")  # a fifth of the query list
        ranked = delta.withColumn("r", F.row_number().over(w.orderBy(F.desc("delta")))).withColumn("n", F.count(F.lit(1)).over(w))
        x, largest = F.col("delta"), F.col("r") <= F.greatest(F.lit(1), F.ceil(0.05 * F.col("n")))
        low = F.avg(x) - 1.96 * F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)).cast("double"))
        share = F.coalesce(F.try_divide(F.sum(F.when(largest, x)), F.sum(x)), F.lit(0.0))
        one = ranked.groupBy("name").agg(F.avg(x).alias(f"{name}_mean_delta"), low.alias(f"{name}_low"), F.avg((x >= 0.05).cast("double")).alias(f"{name}_gain_ge_005"), share.alias(f"{name}_top_5pct_share"))
        out = one if out is None else out.join(one, "name")
    pooled = rows.where("relevance > 0").select("query_id", "page_id", F.lit(1.0).alias("held"))
    cover = ad.qrels(spark, d).join(pooled, ["query_id", "page_id"], "left").groupBy(group).agg(F.avg(F.coalesce("held", F.lit(0.0))).alias("coverage"))
    full = _metrics(spark, d).groupBy(group).agg(F.avg(F.col("ndcg_full") - F.col("ndcg_stage1")).alias("full_gain"))
    return out.join(cover, "name").join(full, "name")


@query("r1_r5_study_gates", f"""WITH {_GATE}, x AS (SELECT *, CASE WHEN w7_mean_delta >= 0.03 AND w7_low > 0 AND w66_mean_delta >= 0.03 AND w66_low > 0 THEN 'pass' WHEN w7_mean_delta < 0.01 THEN 'fail' ELSE 'inconclusive' END AS discovery,
  CASE WHEN w7_mean_delta >= 0.03 AND w66_mean_delta >= 0.03 AND w7_low > 0 AND w66_low > 0 AND w7_gain_ge_005 >= 0.2 AND w66_gain_ge_005 >= 0.2 THEN 'pass' WHEN w7_mean_delta < 0.01 OR w7_top_5pct_share >= 0.9 THEN 'fail' ELSE 'inconclusive' END AS fusion_gate,
  CASE WHEN full_gain < 0.01 THEN 'fail' ELSE 'inconclusive' END AS budget_gate FROM g)
  SELECT name, discovery, fusion_gate, CASE WHEN budget_gate = 'pass' THEN 'budget_aware' WHEN fusion_gate = 'pass' THEN 'page_fusion' WHEN budget_gate = 'fail' AND fusion_gate = 'fail' THEN 'reject_both' ELSE 'inconclusive' END AS final,
  CASE WHEN coverage < 0.95 THEN 'invalid_candidate_coverage' WHEN w7_mean_delta >= 0.03 AND w7_low > 0 AND w7_gain_ge_005 >= 0.1 AND w7_top_5pct_share < 0.9 THEN 'strong_signal' WHEN w7_mean_delta >= 0.01 AND w7_low > 0 AND w7_gain_ge_005 >= 0.1 AND w7_top_5pct_share < 0.9 THEN 'feasible_signal' ELSE 'no_clear_signal' END AS pilot FROM x""")
def r1(spark, d):
    g = _gates(spark, d).withColumns({"discovery_w7_mean_delta": F.col("w7_mean_delta"), "discovery_w66_mean_delta": F.col("w66_mean_delta")})
    g = g.withColumns({"discovery": decisions.discovery(), "fusion_gate": decisions.confirmation(), "budget_gate": F.when(F.col("full_gain") < budget.NO_GO_GAIN, "fail").otherwise("inconclusive")})
    g = g.withColumns({"mean_delta": F.col("w7_mean_delta"), "low": F.col("w7_low"), "gain_ge_003": F.col("w7_gain_ge_005"), "top_5pct_share": F.col("w7_top_5pct_share")})
    return g.select("name", "discovery", "fusion_gate", decisions.final().alias("final"), decisions.feasibility().alias("pilot"))


@query("r7_r8_outcomes", f"WITH {_GATE} SELECT name, CASE WHEN coverage < 0.95 THEN 'BLOCKED' WHEN w7_mean_delta < 0.01 THEN 'NO-GO' WHEN w7_low < 0.005 THEN 'LIMITED' ELSE 'GO' END AS outcome, CASE WHEN -w7_gain_ge_005 * 2 <= -0.5 AND w7_low <= 0.01 THEN 'pass' ELSE 'fail' END AS loss_gate FROM g")
def r7(spark, d):
    g = _gates(spark, d).withColumns({"rho": -F.col("w7_gain_ge_005") * 2, "gap": F.col("w7_low")})
    return g.select("name", decisions.outcome(F.col("coverage") < 0.95, F.col("w7_mean_delta") < 0.01, F.col("w7_low") < 0.005).alias("outcome"), decisions.loss_alignment().alias("loss_gate"))


# ------------------------------------------------------------ learned gate
def _mm(c):
    return f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


_FEAT = f"""WITH {ad.NORM}, f0 AS (SELECT query_id, page_id, relevance, {', '.join(f"{_mm(f'{c}_score')} AS {c}_minmax, row_number() OVER (PARTITION BY query_id ORDER BY {c}_score DESC, page_id) AS {c}_r" for c in gate.SHORT)} FROM norm WINDOW w AS (PARTITION BY query_id)),
  f AS (SELECT query_id, page_id, relevance, {', '.join(f"{c}_minmax, 1.0 / {c}_r AS {c}_rr, coalesce(max(CASE WHEN {c}_r = 1 THEN {c}_minmax END) OVER w - max(CASE WHEN {c}_r = 2 THEN {c}_minmax END) OVER w, 0.0) AS {c}_gap" for c in gate.SHORT)},
    abs(bm25_minmax - dense_minmax) AS bm25_dense_apart, abs(bm25_minmax - visual_minmax) AS bm25_visual_apart, abs(dense_minmax - visual_minmax) AS dense_visual_apart, 0.0::DOUBLE AS query_length FROM f0 WINDOW w AS (PARTITION BY query_id))"""


@query("q1_features", f"{_FEAT} SELECT * EXCLUDE (relevance) FROM f", " ".join(gate.FEATURES))
def q1(spark, d):
    return gate.features(ad.candidates(spark, d)).select("query_id", "page_id", *gate.FEATURES)


_WEIGHTS = [[0.1 * ((i * 5 + j * 3) % 7 - 3) for j in range(13)] for i in range(3)]
_BIAS = [0.1, 0.0, -0.1]


def _logit_sql(i):
    return " + ".join([f"{_BIAS[i]!r}::DOUBLE", *[f"{w!r}::DOUBLE * {n}" for n, w in zip(gate.FEATURES, _WEIGHTS[i])]])


_GATED = f"""{_FEAT}, l AS (SELECT *, {_logit_sql(0)} AS a, {_logit_sql(1)} AS b, {_logit_sql(2)} AS c FROM f), e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM l),
  p AS (SELECT query_id, page_id, relevance, ea / (ea + eb + ec) AS w_bm25, eb / (ea + eb + ec) AS w_dense, ec / (ea + eb + ec) AS w_visual, (ea * bm25_minmax + eb * dense_minmax + ec * visual_minmax) / (ea + eb + ec) AS score FROM e)"""


@query("q3_k10_gate_scores", f"{_GATED} SELECT query_id, page_id, w_bm25, w_dense, w_visual, score FROM p", "w_bm25 w_dense w_visual score")
def q3(spark, d):
    return gate.predict(gate.features(ad.candidates(spark, d)), _WEIGHTS, _BIAS)


@query("x10_gate_profile", f"{_GATED}, g AS (SELECT query_id, max(abs(w_bm25 + w_dense + w_visual - 1.0)) AS d, count(DISTINCT (w_bm25, w_dense, w_visual)) > 1 AS v FROM p GROUP BY 1) SELECT max(d) AS simplex_deviation, count(CASE WHEN v THEN 1 END) AS varying_queries FROM g", "simplex_deviation")
def x10(spark, d):
    return gate.gate_profile(gate.predict(gate.features(ad.candidates(spark, d)), _WEIGHTS, _BIAS))


_GAPS = [f"{c}_gap" for c in gate.SHORT]


def _ablated_sql(i):
    return " + ".join([f"{_BIAS[i]!r}::DOUBLE", *[f"{0.0 if n in _GAPS else w!r}::DOUBLE * {n}" for n, w in zip(gate.FEATURES, _WEIGHTS[i])]])


_ABLATED = _GATED
for _i in range(3):
    _ABLATED = _ABLATED.replace(_logit_sql(_i), _ablated_sql(_i))


@query("k11_ablated_gate", f"SELECT count(*) AS queries, avg(ndcg10) AS ndcg10, avg(recall1) AS recall1, avg(recall3) AS recall3, avg(mrr10) AS mrr10 FROM ({_ABLATED} SELECT * FROM {ad.evaluate_sql('p', 'score')})", METRICS)
def k11(spark, d):
    """A gate without its gap features, evaluated."""
    p = gate.predict(gate.features(ad.candidates(spark, d)), gate.without(_WEIGHTS, _GAPS), _BIAS)
    return metrics.mean_metrics(metrics.evaluate(ad.with_labels(p, ad.qrels(spark, d)), "score"))


@query("q4_pairwise_loss", f"WITH {ad.NORM}, p AS (SELECT a.query_id, avg(greatest(b.visual_score - a.visual_score, 0.0) + ln(1 + exp(-abs(b.visual_score - a.visual_score)))) AS loss FROM norm a JOIN norm b ON a.query_id = b.query_id AND a.relevance > 0 AND b.relevance <= 0 GROUP BY 1) SELECT avg(loss) AS loss, count(*) AS queries FROM p", "loss")
def q4(spark, d):
    """Positive and negative pages inside each query's pool."""
    return gate.pairwise_loss(ad.labelled(spark, d).withColumn("score", F.col("visual_score")))


@query("q5_weighted_loss", f"""WITH {ad.NORM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY visual_score DESC, page_id) AS r FROM norm), c AS (SELECT *, CASE WHEN r <= 10 THEN 1.0 / log2(r + 1) ELSE 0.0 END AS cut FROM r),
  p AS (SELECT a.query_id, greatest(b.visual_score - a.visual_score, 0.0) + ln(1 + exp(-abs(b.visual_score - a.visual_score))) AS l, abs(a.cut - b.cut) AS w FROM c a JOIN c b ON a.query_id = b.query_id AND a.relevance > 0 AND b.relevance <= 0),
  q AS (SELECT query_id, coalesce(sum(l * w) / nullif(sum(w), 0), 0.0) AS loss FROM p GROUP BY 1) SELECT avg(loss) AS loss, count(*) AS queries FROM q""", "loss")
def q5(spark, d):
    return gate.pairwise_loss(ad.labelled(spark, d).withColumn("score", F.col("visual_score")), weighted=True)


@query("q6_listwise_loss", f"""WITH {ad.NORM}, q AS (SELECT query_id, ln(sum(exp(visual_score))) AS lse, sum(CASE WHEN relevance > 0 THEN visual_score ELSE 0 END) AS s, CAST(count(CASE WHEN relevance > 0 THEN 1 END) AS DOUBLE) AS n FROM norm GROUP BY 1) SELECT avg(lse - s / n) AS loss, count(*) AS queries FROM q WHERE n > 0""", "loss")
def q6(spark, d):
    return gate.listwise_loss(ad.labelled(spark, d).select("query_id", F.col("visual_score").alias("score"), "relevance"))


_NRANKS = " + ".join(f"{c}_nrank" for c in gate.SHORT)


@query("q2_features_first", f"""WITH {ad.NORM}, f0 AS (SELECT *, count(*) OVER w AS n, {', '.join(f"row_number() OVER (PARTITION BY query_id ORDER BY {c}_score DESC, page_id) AS {c}_r" for c in gate.SHORT)} FROM norm WINDOW w AS (PARTITION BY query_id)),
  f AS (SELECT query_id, page_id, {', '.join(gate.CHANNELS)}, {', '.join(f"CASE WHEN n = 1 THEN 1.0 ELSE 1.0 - ({c}_r - 1) / (n - 1)::DOUBLE END AS {c}_nrank, {c}_score - median({c}_score) OVER w AS {c}_margin, coalesce(max(CASE WHEN {c}_r = 1 THEN {c}_score END) OVER w - max(CASE WHEN {c}_r = 2 THEN {c}_score END) OVER w, 0.0) AS {c}_gap" for c in gate.SHORT)} FROM f0 WINDOW w AS (PARTITION BY query_id))
  SELECT *, sqrt(({' + '.join(f"pow({c}_nrank - ({_NRANKS}) / 3, 2)" for c in gate.SHORT)}) / 3) AS rank_spread FROM f""", " ".join(gate.FEATURES_FIRST))
def q2(spark, d):
    return gate.features_first(ad.candidates(spark, d)).select("query_id", "page_id", *gate.FEATURES_FIRST)


@query("q7_trained_gate", None, "loss")
def q7(spark, d):
    """Losses of a few epochs of training; must fall (tests)."""
    feats = gate.features(ad.candidates(spark, d))
    _, losses = training.descend(ad.with_labels(feats, ad.qrels(spark, d)), epochs=3)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


_PAIR = "greatest(b.score - a.score, 0.0) + ln(1 + exp(-abs(b.score - a.score)))"
_ALIGN = f"""{_profile_sql(W66)}, gn AS (SELECT profile, round(avg(ndcg10), 9) AS ndcg10 FROM pm GROUP BY 1),
  sc AS (SELECT n.query_id, g.profile, n.page_id, n.relevance, wa * bm25_score + wb * dense_score + wc * visual_score AS score FROM norm n, grid g),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, profile ORDER BY score DESC, page_id) AS r FROM sc), ct AS (SELECT *, CASE WHEN r <= 10 THEN 1.0 / log2(r + 1) ELSE 0.0 END AS cut FROM rk),
  pr AS (SELECT a.query_id, a.profile, {_PAIR} AS l, abs(a.cut - b.cut) AS w FROM ct a JOIN ct b ON a.query_id = b.query_id AND a.profile = b.profile AND a.relevance > 0 AND b.relevance <= 0),
  pq AS (SELECT query_id, profile, avg(l) AS plain, coalesce(sum(l * w) / nullif(sum(w), 0), 0.0) AS weighted FROM pr GROUP BY 1, 2),
  lo AS (SELECT profile, 'plain' AS kind, round(avg(plain), 9) AS loss FROM pq GROUP BY 1 UNION ALL SELECT profile, 'weighted', round(avg(weighted), 9) FROM pq GROUP BY 1), j AS (SELECT * FROM lo JOIN gn USING (profile)),
  ar AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY loss) + (count(*) OVER (PARTITION BY kind, loss) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY kind ORDER BY ndcg10) + (count(*) OVER (PARTITION BY kind, ndcg10) - 1) / 2.0::DOUBLE AS y FROM j),
  ag AS (SELECT kind, corr(x, y) AS rho, arg_min(profile, (loss, profile)) AS least_profile, max(ndcg10) - arg_min(ndcg10, (loss, profile)) AS gap FROM ar GROUP BY 1)
  SELECT kind, rho, least_profile, gap, CASE WHEN rho <= -0.5 AND gap <= 0.01 THEN 'pass' ELSE 'fail' END AS gate FROM ag"""


@query("n8_loss_alignment", _ALIGN, "rho gap")
def n8(spark, d):
    """Do the plain and the weighted pairwise loss order the 66 static profiles
    as nDCG does? Rank correlation over the grid, and the nDCG gap of the first
    profile with the least loss, with the gate of each loss. Losses and metrics
    read one exchange of the rows."""
    rows = scratch(ad.labelled(spark, d).select("query_id", "page_id", "relevance", *CHANNELS), "rows").repartition("query_id")
    return gate.loss_alignment(rows, W66, oracle.global_means(oracle.profile_metrics(rows, W66)))


@query("n4_paired_summary", None, "mean_delta low high")
def n4(spark, d):
    """Full against cheap ranking, by the standard library's generator."""
    return stats.paired_bootstrap(_metrics(spark, d).select("query_id", (F.col("ndcg_full") - F.col("ndcg_stage1")).alias("delta")))


_HALF = "CAST(CAST(query_id AS BIGINT) % 2 AS BIGINT)"


def _gain_sql(name, profiles):
    return f"""(SELECT {_HALF} AS half, avg(delta) AS {name}_mean_delta, avg(delta) - 1.96::DOUBLE * coalesce(stddev_samp(delta), 0.0) / sqrt(CAST(count(*) AS DOUBLE)) AS {name}_low, avg(CASE WHEN delta >= 0.05 THEN 1.0::DOUBLE ELSE 0.0 END) AS {name}_gain_ge_005
    FROM ({_profile_sql(profiles)} SELECT query_id, max(ndcg10) - avg(ndcg10) AS delta FROM pm GROUP BY 1) GROUP BY 1)"""


@query("r_gates_on_data", f"""WITH a AS {_gain_sql('w7', W7)}, b AS {_gain_sql('w66', W66)}, s AS (SELECT * FROM a JOIN b USING (half)),
  c AS (SELECT x.w7_mean_delta AS discovery_w7_mean_delta, x.w66_mean_delta AS discovery_w66_mean_delta, x.w7_low AS d7, x.w66_low AS d66, y.* FROM s x, s y WHERE x.half = 0 AND y.half = 1),
  q AS (SELECT {_HALF} AS half, avg(ndcg_full) - avg(ndcg_stage1) AS full_minus_stage1, avg(CASE WHEN ndcg_full - ndcg_stage1 > 0.01 THEN 1.0::DOUBLE ELSE 0.0 END) AS beneficial_fraction FROM ({_QM}) GROUP BY 1),
  g AS (SELECT c.*, x.full_minus_stage1 AS dm, x.beneficial_fraction AS df, y.full_minus_stage1 AS cm, y.beneficial_fraction AS cf FROM c, q x, q y WHERE x.half = 0 AND y.half = 1),
  h AS (SELECT CASE WHEN discovery_w7_mean_delta >= 0.03 AND d7 > 0 AND discovery_w66_mean_delta >= 0.03 AND d66 > 0 THEN 'pass' WHEN discovery_w7_mean_delta < 0.01 THEN 'fail' ELSE 'inconclusive' END AS discovery,
    CASE WHEN discovery_w7_mean_delta >= 0.03 AND discovery_w66_mean_delta >= 0.03 AND w7_mean_delta >= 0.02 AND w66_mean_delta >= 0.02 AND w7_low > 0 AND w66_low > 0 AND w7_gain_ge_005 >= 0.2 AND w66_gain_ge_005 >= 0.2 THEN 'pass' WHEN w7_mean_delta < 0.01 THEN 'fail' ELSE 'inconclusive' END AS fusion_gate,
    CASE WHEN dm >= 0.02 AND df >= 0.2 AND 1 - df >= 0.2 AND cm >= 0.02 AND cf >= 0.2 AND 1 - cf >= 0.2 THEN 'pass' WHEN cm < 0.01 THEN 'fail' ELSE 'inconclusive' END AS budget_gate FROM g)
  SELECT *, CASE WHEN budget_gate = 'pass' THEN 'budget_aware' WHEN fusion_gate = 'pass' THEN 'page_fusion' WHEN budget_gate = 'fail' AND fusion_gate = 'fail' THEN 'reject_both' ELSE 'inconclusive' END AS final FROM h""")
def r_data(spark, d):
    """R1 to R4 on measured summaries: queries with even numbers are the
    discovery sample, the others confirm; the gain is that of a query's best
    profile over the mean one. The budget summaries hold b* at 50, the control
    gap at 0.01 and retention at 0.98, so that means and fractions decide."""
    half = F.expr("cast(query_id as bigint) % 2").alias("half")
    rows, sides = scratch(ad.labelled(spark, d), "rows"), None
    for name, grid in (("w7", W7), ("w66", W66)):
        pm = oracle.profile_metrics(rows, grid).withColumn("ndcg10", F.round("ndcg10", 9))
        delta = pm.groupBy("query_id").agg((F.max("ndcg10") - F.avg("ndcg10")).alias("delta"))
        x = F.col("delta")
        low = F.avg(x) - 1.96 * F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)).cast("double"))
        one = delta.groupBy(half).agg(F.avg(x).alias(f"{name}_mean_delta"), low.alias(f"{name}_low"), F.avg((x >= 0.05).cast("double")).alias(f"{name}_gain_ge_005"))
        sides = one if sides is None else sides.join(one, "half")
    first = sides.where("half = 0").select(*[F.col(c).alias(f"discovery_{c}") for c in sides.columns if c != "half"])
    m = _metrics(spark, d).withColumn("gain", F.col("ndcg_full") - F.col("ndcg_stage1"))
    share = F.avg((F.col("gain") > budget.GAIN).cast("double"))
    b = m.groupBy(half).agg(F.struct(
        F.avg("gain").alias("full_minus_stage1"), share.alias("beneficial_fraction"), (1.0 - share).alias("non_beneficial_fraction"),
        F.lit(50).alias("b_star"), F.lit(0.01).alias("control_gap"), F.lit(0.98).alias("retention_low"),
    ).alias("s"))
    both = b.agg(F.max(F.when(F.col("half") == 0, F.col("s"))).alias("d"), F.max(F.when(F.col("half") == 1, F.col("s"))).alias("c"))
    row = sides.where("half = 1").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(both)).withColumn("w7_top_5pct_share", F.lit(0.0))  # one row each
    found = row.select(
        *[F.col(f"discovery_{g}_{c}").alias(f"{g}_{c}") for g in ("w7", "w66") for c in ("mean_delta", "low")],
        decisions.confirmation().alias("fusion_gate"), decisions.budget_confirmation("d", "c").alias("budget_gate"),
    )
    return found.select(decisions.discovery().alias("discovery"), "fusion_gate", "budget_gate", decisions.final().alias("final"))
