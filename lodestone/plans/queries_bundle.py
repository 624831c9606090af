"""The bundle contract over tables with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundle, normalize, ranking
from ..operators.contracts import KEY
from ..sources.scratch import scratch

from . import adapters as ad
from .registry import query

_S = bundle.SCORES
_WINDOW = "WINDOW w AS (PARTITION BY query_id)"
_RANKS = {b: f"{b}_rank" for b in bundle.BRANCHES}
_DROPPED = "ends_with(page_id, '_0003') AND CAST(query_id AS INTEGER) % 7 = 0"
_MOVED = "ends_with(page_id, '_0007')"
_PERMUTED = " AND ".join(f"min({r}) = 1 AND max({r}) = count(*) AND count(DISTINCT {r}) = count(*)" for r in _RANKS.values())
_UNIT = ", ".join(f"{ad.minmax_sql(s)} AS u_{s}" for s in _S)
_FINITE = " AND ".join(f"isfinite({s})" for s in ["relevance", *_S])

_SQL = f"""WITH {ad.RANKED}, unit AS (SELECT *, {_UNIT} FROM ranked {_WINDOW}), score AS (SELECT * REPLACE (CASE WHEN {_MOVED} THEN u_bm25_score + 1e-6 ELSE u_bm25_score END AS u_bm25_score) FROM unit WHERE NOT ({_DROPPED})),
  p AS (SELECT count(*) AS n FROM raw), q AS (SELECT count(*) AS n FROM (SELECT DISTINCT query_id FROM raw)),
  perq AS (SELECT query_id, {_PERMUTED} AS permuted, count(CASE WHEN relevance > 0 THEN 1 END) AS hits FROM score GROUP BY 1), audit AS (SELECT query_id, count(CASE WHEN relevance > 0 THEN 1 END) AS hits FROM raw GROUP BY 1)
  SELECT 'raw_keys_unique' AS rule, 'page' AS level, n AS checked, (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY query_id, page_id HAVING count(*) > 1)) AS broken FROM p
  UNION ALL SELECT 'score_keys_unique', 'page', n, (SELECT count(*) FROM (SELECT 1 FROM score GROUP BY query_id, page_id HAVING count(*) > 1)) FROM p
  UNION ALL SELECT 'key_sets_match', 'page', n, (SELECT count(*) FROM raw WHERE {_DROPPED}) FROM p
  UNION ALL SELECT 'page_ids_clean', 'page', n, (SELECT count(*) FROM raw WHERE page_id <> trim(page_id) OR page_id = '') FROM p
  UNION ALL SELECT 'common_values_match', 'page', n, (SELECT count(*) FROM raw a JOIN score b USING (query_id, page_id) WHERE a.source IS DISTINCT FROM b.source OR a.relevance IS DISTINCT FROM b.relevance) FROM p
  UNION ALL SELECT 'raw_numeric_finite', 'page', n, (SELECT count(*) FROM raw WHERE NOT ({_FINITE})) FROM p
  UNION ALL SELECT 'score_numeric_finite', 'page', n, (SELECT count(*) FROM score WHERE NOT ({' AND '.join(f'isfinite(u_{s})' for s in _S)})) FROM p
  UNION ALL SELECT 'relevance_nonnegative', 'page', n, (SELECT count(*) FROM raw WHERE NOT relevance >= 0) FROM p
  UNION ALL SELECT 'normalized_scores_bounded', 'page', n, (SELECT count(*) FROM score WHERE NOT ({' AND '.join(f'u_{s} BETWEEN 0 AND 1' for s in _S)})) FROM p
  UNION ALL SELECT 'branch_ranks_valid', 'page', n, (SELECT count(*) FROM score WHERE NOT ({' AND '.join(f'{r} >= 1' for r in _RANKS.values())})) FROM p
  UNION ALL SELECT 'normalization_matches_raw', 'page', n, (SELECT count(*) FROM score WHERE {_MOVED}) FROM p
  UNION ALL SELECT 'branch_rank_permutation', 'query', n, (SELECT count(*) FROM perq WHERE NOT permuted) FROM q
  UNION ALL SELECT 'audit_row_there', 'query', n, (SELECT count(*) FROM perq ANTI JOIN audit USING (query_id)) FROM q
  UNION ALL SELECT 'audit_has_relevant_candidates', 'query', n, (SELECT count(*) FROM audit WHERE hits = 0) FROM q
  UNION ALL SELECT 'has_relevant_candidate', 'query', n, (SELECT count(*) FROM audit a LEFT JOIN perq s USING (query_id) WHERE coalesce(s.hits, 0) = 0) FROM q
  UNION ALL SELECT 'row_count_matches', 'table', 1, CAST((SELECT count(*) FROM score) <> n AS BIGINT) FROM p
  UNION ALL SELECT 'query_count_matches', 'table', 1, CAST((SELECT count(*) FROM perq) <> n AS BIGINT) FROM q
  UNION ALL SELECT 'coverage_gate', 'table', 1, CAST((SELECT sum(hits) FROM perq) / (SELECT sum(hits) FROM audit) < 0.95 AS BIGINT)"""


@query("c16_c15_bundle_contract", _SQL)
def c16(spark, d):
    """Some pages lack a score row and some scores are not those of the raw rows."""
    raw = ad.raw(spark, d)
    unit = ranking.with_ranks(raw, _S).withColumns({s: normalize.minmax_of(s, ["query_id"]) for s in _S})
    unit = unit.withColumn("branch_ranks", F.to_json(F.struct(*[F.col(r).alias(b) for b, r in _RANKS.items()])))
    moved, dropped = F.endswith("page_id", F.lit("_0007")), F.endswith("page_id", F.lit("_0003")) & (F.col("query_id").cast("int") % 7 == 0)
    scores = unit.withColumn("bm25_score", F.when(moved, F.col("bm25_score") + 1e-6).otherwise(F.col("bm25_score"))).where(~dropped)
    hit = F.col("relevance") > 0
    # what the rest needs to know of the rows is a row a query, made in one pass
    per = scratch(raw.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("all"), F.count_if(hit & ~dropped).alias("kept")), "queries")
    audit = per.select(*KEY, F.col("all").cast("int").alias("relevant_selected"))
    cover = per.agg((F.sum("kept") / F.sum("all")).alias("final_coverage"), F.lit(0.95).alias("minimum_required"))
    facts = per.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("queries")).first()
    return bundle.check(raw, scores, audit, cover, rows=facts["rows"] or 0, queries=facts["queries"]).drop("example")
