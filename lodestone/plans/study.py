"""The study end to end: raw scores to pools and query metrics, checks, weight
searches, budget curve, pilot report and decision.

Each step is a function over DataFrames; summaries are one-row tables, collected
only at the edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, budget, contracts, decisions, metrics, normalize, oracle, page_oracle, pool, sampling, stats
from ..operators.contracts import BRANCHES, CONTRACTS, KEY, ContractError

SCORES = [f"{b}_score" for b in BRANCHES]


def raw_rules() -> dict:
    return contracts.numeric_rules(["relevance", *SCORES, "full_score"]) | {"relevance_negative": F.col("relevance") >= 0}


def build(raw: DataFrame, least: float = 0.95, official: DataFrame | None = None) -> dict[str, DataFrame]:
    """retrieval_scores, query_metrics, candidate_audit and a one-row
    coverage_report. Raises ContractError for bad tables and CoverageError (with
    the audit) if the larger pool is still too thin."""
    contracts.require_columns(raw, CONTRACTS["raw_scores"].fieldNames(), "raw scores")
    contracts.enforce(raw, raw_rules(), "raw scores")
    if contracts.duplicate_keys(raw, [*KEY, "page_id"]).limit(1).count():
        raise ContractError("raw scores: repeated pages")
    chosen, depth = pool.choose_pool(raw, least)
    ranks = F.to_json(F.struct(*[F.col(f"{b}_rank").alias(b) for b in BRANCHES]))
    scores = chosen.withColumn("branch_ranks", ranks).withColumns({s: normalize.minmax_of(s, KEY) for s in SCORES})
    own = metrics.query_metrics(raw).withColumns({"recall_stage1": F.col("recall3_stage1"), "recall_full": F.col("recall3_full")})
    if official is not None:
        contracts.require_columns(official, CONTRACTS["query_metrics"].fieldNames(), "official metrics")
        odd = unmatched(raw, official).first()
        if odd["missing"] or odd["extra"] or contracts.duplicate_keys(official, KEY).limit(1).count():
            raise ContractError(f"official metrics: {odd.asDict()}")
        own = official
    masks = pool.masked(raw)
    report = masks.agg(
        pool.coverage(masks, "initial").alias("initial_coverage"), pool.coverage(masks, "final").alias("final_coverage_if_expanded"),
        F.count_if(depth).alias("candidate_rows"), F.count_distinct(*KEY).alias("queries"),
    ).withColumns({"expanded_once": F.lit(depth == "final"), "minimum_required": F.lit(least)})
    report = report.withColumn("final_coverage", F.when(F.col("expanded_once"), F.col("final_coverage_if_expanded")).otherwise(F.col("initial_coverage"))).drop("final_coverage_if_expanded")
    return {
        "retrieval_scores": scores.select(*CONTRACTS["retrieval_scores"].fieldNames()), "query_metrics": own,
        "candidate_audit": pool.coverage_audit(masks, least), "coverage_report": report,
    }


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: queries of ``left`` that ``right`` lacks, and the reverse."""
    a, b = left.select(*KEY).distinct(), right.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.join(a, KEY, "left_anti").agg(F.count(F.lit(1)).alias("extra")))


def preflight(scores: DataFrame, table: DataFrame, means: dict[str, float] | None = None, tolerance: float = 0.01) -> DataFrame:
    """One row of counts of everything that breaks, and passed."""
    ranks = F.from_json("branch_ranks", ", ".join(f"{b} INT" for b in BRANCHES))
    whole = reduce(lambda a, b: a & b, [F.coalesce(ranks[b] >= 1, F.lit(False)) for b in BRANCHES])
    inside = {f"{s}_range": F.col(s).between(-1e-12, 1 + 1e-12) for s in SCORES}
    rules = contracts.numeric_rules(["relevance", *SCORES]) | inside | {"branch_ranks_invalid": whole}
    unit = {f"{c}_range": F.col(c).between(0, 1) for c in ("ndcg_stage1", "ndcg_full", "recall_stage1", "recall_full")}
    paid = {f"{c}_not_positive": F.col(c) > 0 for c in ("stage2_ms", "stage2_flops")}
    out = contracts.violations(scores, rules).crossJoin(contracts.violations(table, unit | paid)).crossJoin(unmatched(scores, table))
    out = out.crossJoin(contracts.key_summary(scores, [*KEY, "page_id"]).select(F.col("surplus").alias("repeated_pages")))
    out = out.crossJoin(contracts.key_summary(table, KEY).select(F.col("surplus").alias("repeated_queries")))
    for c, want in (means or {}).items():
        off = table.agg((F.abs(F.avg(c) - want) > tolerance).cast("long").alias(f"{c}_not_reproduced"))
        out = out.crossJoin(off)
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(1)) == 0 for c in out.columns]))


def search(scores: DataFrame, grids=("w7", "w66"), resamples: int = 10_000) -> dict[str, DataFrame]:
    """rows (one a query and grid), summary (one a grid) and subgroups."""
    d = scores.withColumn("query_id", F.concat_ws("/", *KEY))
    about = d.groupBy("query_id").agg(F.first("source").alias("source"), F.count_if(F.col("relevance") > 0).alias("relevant_count"))
    rows, summaries = [], []
    for name in grids:
        profiles = oracle.grid(name)
        table = oracle.oracle_rows(d, profiles)
        page = page_oracle.page_oracle(d, profiles).select("query_id", "page_ndcg10", "changed", "updates", "profiles")
        own = table.join(page, "query_id").join(about, "query_id").withColumn("grid", F.lit(name))
        own = own.withColumnRenamed("delta", "query_vs_global").withColumn("page_vs_query", F.col("page_ndcg10") - F.col("query_ndcg10")).withColumn("page_vs_global", F.col("page_ndcg10") - F.col("global_ndcg10"))
        rows.append(own)
        for step in ("query_vs_global", "page_vs_query", "page_vs_global"):
            s = oracle.gain_summary(own, step).crossJoin(stats.bootstrap_mean(own, step, resamples))
            summaries.append(s.select(F.lit(name).alias("grid"), F.lit(step).alias("step"), "*"))
    every = reduce(DataFrame.unionByName, rows)
    group = F.when(F.col("relevant_count") > 1, "multi").otherwise("single").alias("relevance_group")
    gains = [F.avg(c).alias(c) for c in ("query_vs_global", "page_vs_query", "page_vs_global")]
    return {"rows": every, "summary": reduce(DataFrame.unionByName, summaries), "subgroups": every.groupBy("grid", "source", group).agg(F.count(F.lit(1)).alias("queries"), *gains)}


def wide_summary(summary: DataFrame, step: str = "page_vs_query", prefix: str = "") -> DataFrame:
    """One row with the gate inputs of every grid: w7_mean_delta, w7_low, ..."""
    names = {"mean_delta": "mean_delta", "low": "low", "gain_ge_005": "gain_ge_005", "top_5pct_share": "top_5pct_share"}
    grids = [r["grid"] for r in summary.select("grid").distinct().collect()]
    picks = [F.max(F.when((F.col("grid") == g) & (F.col("step") == step), F.col(c))).alias(f"{prefix}{g}_{n}") for g in grids for n, c in names.items()]
    return summary.agg(*picks)


def discovery(summary: DataFrame) -> DataFrame:
    return wide_summary(summary).withColumn("discovery_gate", decisions.discovery())


def pilot(summary: DataFrame, coverage: DataFrame, grid: str = "w7") -> DataFrame:
    """(step, status, ...) of a short pilot."""
    d = summary.where(F.col("grid") == grid).crossJoin(coverage.select(F.col("final_coverage").alias("coverage")))
    return d.withColumn("status", decisions.feasibility())


def spend(table: DataFrame, repeats: int = 100, resamples: int = 10_000) -> dict[str, DataFrame]:
    """per_query, curve (with the sampled random arm) and a one-row summary with
    the retention interval and the gate."""
    if contracts.duplicate_keys(table, KEY).limit(1).count():
        raise ContractError("query metrics: repeated queries")
    contracts.enforce(table, contracts.numeric_rules(["ndcg_stage1", "ndcg_full", "stage1_margin", "stage2_ms", "stage2_flops"]) | {"cost": (F.col("stage2_ms") > 0) & (F.col("stage2_flops") > 0)}, "query metrics")
    table = table.withColumn("query_id", F.concat_ws("/", *KEY))
    points = budget.curve(table).withColumnRenamed("random_ndcg10", "expected_random_ndcg10").join(budget.random_arm(table, repeats), "budget_percent")
    each = budget.per_query(table, budget.b_star(points))
    kept = each.select("query_id", F.when(F.col("selected_at_b_star"), F.col("ndcg_full")).otherwise(F.col("ndcg_stage1")).alias("kept"), "ndcg_full")
    interval = stats.bootstrap_ratio(kept, "kept", "ndcg_full", resamples).withColumnsRenamed({"low": "retention_low", "high": "retention_high"})
    return {"per_query": each, "curve": points, "summary": budget.gate(budget.summary(table, points).crossJoin(interval), F.col("retention_low"))}


def decide(fusion: tuple[DataFrame, DataFrame] | None, spending: tuple[DataFrame, DataFrame] | None, spark) -> DataFrame:
    """One row: both gates and the final decision, from (discovery, confirmation)
    summaries; a missing pair is not_run."""
    one = spark.range(1).select()
    if fusion:
        d = wide_summary(fusion[0], prefix="discovery_").crossJoin(wide_summary(fusion[1]))
        both = all(f"{p}{g}_mean_delta" in d.columns for p in ("", "discovery_") for g in ("w7", "w66"))
        one = one.crossJoin(d.select((decisions.confirmation() if both else F.lit("inconclusive")).alias("fusion_gate")))
    else:
        one = one.withColumn("fusion_gate", F.lit("not_run"))
    if spending:
        a = spending[0].select(F.col("gate").alias("a"))
        b = spending[1].select(F.col("gate").alias("b"))
        strong = (F.col("a") == "pass") & (F.col("b") == "pass")
        one = one.crossJoin(a.crossJoin(b).select(F.when(strong, "pass").when(F.col("b") == "fail", "fail").otherwise("inconclusive").alias("budget_gate")))
    else:
        one = one.withColumn("budget_gate", F.lit("not_run"))
    return one.withColumn("decision", decisions.final())


def confirmation_sample(queries: DataFrame, n: int = 2000, seed: str = "20260820") -> DataFrame:
    """Stratified by source and number of relevant pages, in hash order."""
    count = F.col("relevant_count") if "relevant_count" in queries.columns else F.size("doc_ids")
    d = queries.withColumn("relevance_group", F.when(count > 1, "multi").otherwise("single"))
    return sampling.stratified(d, ["source", "relevance_group"], "query_id", n, seed).drop("relevance_group")


def run_identity(tables: dict[str, DataFrame], settings: dict) -> DataFrame:
    """One row: fingerprints of the inputs and a hash of them with the settings."""
    spark = next(iter(tables.values())).sparkSession
    prints = {n: "{row_count}:{xor}:{total}".format(**audit.fingerprint(t, sorted(t.columns)).first().asDict()) for n, t in sorted(tables.items())}
    row = [(sorted(prints.items()), sorted((k, str(v)) for k, v in settings.items()))]
    d = spark.createDataFrame(row, "inputs array<struct<name:string,print:string>>, settings array<struct<name:string,value:string>>")
    return d.withColumn("identity", F.sha2(F.to_json(F.struct("inputs", "settings")), 256))


def resume(scores: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows of the queries that an interrupted run has not written yet."""
    return scores if done is None else scores.join(done.select("query_id").distinct(), "query_id", "left_anti")
