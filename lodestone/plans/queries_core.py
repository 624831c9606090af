"""Queries of contracts, ranks, pools, normalization, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import contracts, fusion, metrics, normalize, pool, ranking
from ..operators.contracts import CHANNELS
from . import adapters as ad
from .registry import query

METRICS = "ndcg10 recall1 recall3 mrr10"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, page_id)"


# ------------------------------------------------------------ sources, contracts
@query("a2_projected_scores", f"WITH {ad.RAW} SELECT query_id, count(*) AS n, sum(bm25_score) AS bm25, max(dense_score) AS dense FROM raw GROUP BY 1", "bm25")
def a2(spark, d):
    s = contracts.exact_columns(ad.scores(spark, d), "score_rows")
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bm25_score").alias("bm25"), F.max("dense_score").alias("dense"))


@query("a4_filtered_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def a4(spark, d):
    from ..sources.readers import only

    return only(ad.table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_totalprice")


@query("a5_query_subset", f"WITH {ad.RAW} SELECT query_id, page_id, bm25_score FROM raw WHERE query_id IN ('1', '2', '3')")
def a5(spark, d):
    from ..sources.readers import for_queries

    wanted = spark.createDataFrame([("1",), ("2",), ("3",)], "query_id string")
    return for_queries(ad.scores(spark, d), wanted).select("query_id", "page_id", "bm25_score")


@query("a9_query_order", f"WITH {ad.RAW} SELECT query_id, count(*) AS n, CAST(row_number() OVER (ORDER BY query_id) - 1 AS INTEGER) AS query_index FROM raw GROUP BY 1")
def a9(spark, d):
    from ..sources.readers import query_order

    return query_order(ad.scores(spark, d))


@query("c2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c2(spark, d):
    return contracts.duplicate_keys(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c2_key_summary", "SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_count, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def c2b(spark, d):
    return contracts.key_summary(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c3_c4_rule_counts", f"""WITH {ad.RAW} SELECT 0::BIGINT AS bm25_score_not_finite, 0::BIGINT AS dense_score_not_finite, 0::BIGINT AS visual_score_not_finite,
  count(CASE WHEN NOT (relevance >= 0) THEN 1 END) AS relevance_negative, count(CASE WHEN NOT (dense_score BETWEEN 0 AND 1) THEN 1 END) AS dense_out_of_range, count(CASE WHEN NOT (relevance IN (0, 1)) THEN 1 END) AS graded FROM raw""")
def c3(spark, d):
    rules = contracts.numeric_rules(CHANNELS) | {"relevance_negative": F.col("relevance") >= 0, "dense_out_of_range": F.col("dense_score").between(0, 1), "graded": F.col("relevance").isin(0.0, 1.0)}
    return contracts.violations(ad.raw(spark, d), rules)


@query("c5_json_ranks", """SELECT count(CASE WHEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 10, false) = false THEN 1 END) AS low, count(*) AS n FROM events""")
def c5(spark, d):
    k = F.from_json("props", "k INT")["k"]
    return ad.table(spark, d, "events").agg(F.count_if(~F.coalesce(k >= 10, F.lit(False))).alias("low"), F.count(F.lit(1)).alias("n"))


@query("c6_rank_permutation", f"WITH {ad.RANKED} SELECT query_id, min(bm25_rank) = 1 AND max(bm25_rank) = count(*) AND count(DISTINCT bm25_rank) = count(*) AS ok FROM ranked GROUP BY 1")
def c6(spark, d):
    r = ranking.with_ranks(ad.scores(spark, d), ["bm25_score"])
    n = F.count(F.lit(1))
    return r.groupBy("query_id").agg(((F.min("bm25_rank") == 1) & (F.max("bm25_rank") == n) & (F.count_distinct("bm25_rank") == n)).alias("ok"))


@query("c7_preflight", f"""WITH {ad.RAW}, k AS (SELECT count(*) AS n, count(DISTINCT query_id) AS q FROM raw), m AS (SELECT DISTINCT query_id FROM raw WHERE bm25_score > 0), x AS (SELECT CAST(s_suppkey AS VARCHAR) AS query_id FROM supplier)
  SELECT k.n AS score_rows, k.q AS queries, (SELECT count(*) FROM x ANTI JOIN m USING (query_id)) AS missing_queries, (SELECT count(*) FROM m ANTI JOIN x USING (query_id)) AS orphan_queries,
  (SELECT avg(bm25_score) FROM raw) AS mean_bm25 FROM k""", "mean_bm25")
def c7(spark, d):
    raw = ad.raw(spark, d)
    known, want = raw.where("bm25_score > 0").select("query_id").distinct(), ad.query_list(spark, d)
    base = raw.agg(F.count(F.lit(1)).alias("score_rows"), F.count_distinct("query_id").alias("queries"), F.avg("bm25_score").alias("mean_bm25"))
    a = want.join(known, "query_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_queries"))
    b = known.join(want, "query_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_queries"))
    return base.crossJoin(a).crossJoin(b)


@query("c8_reproduction_delta", f"WITH {ad.RAW} SELECT avg(dense_score) AS mean, abs(avg(dense_score) - 0.05) <= 0.05 AS ok FROM raw", "mean")
def c8(spark, d):
    m = F.avg("dense_score")
    return ad.raw(spark, d).agg(m.alias("mean"), (F.abs(m - 0.05) <= 0.05).alias("ok"))


@query("c9_id_hygiene", "SELECT count(CASE WHEN NOT (c_name = trim(c_name) AND c_name <> '' AND NOT regexp_matches(c_name, '[\\r\\n\\t]')) THEN 1 END) AS c_name_clean FROM customer")
def c9(spark, d):
    return contracts.violations(ad.table(spark, d, "customer"), contracts.id_rules("c_name"))


@query("c10_query_frames", f"WITH {ad.RAW} SELECT query_id, count(*) AS row_count, count(DISTINCT page_id) AS page_count, 0::BIGINT AS not_finite, count(*) = count(DISTINCT page_id) AS ok FROM raw GROUP BY 1")
def c10(spark, d):
    return contracts.query_frame_report(ad.scores(spark, d))


@query("c11_records", f"""WITH {ad.NORM}, t AS (SELECT query_id, count(*) AS relevant_total FROM raw WHERE relevance > 0 GROUP BY 1)
  SELECT n.query_id, count(*) AS candidates, any_value(relevant_total) AS relevant_total, list(n.page_id ORDER BY n.page_id)[1] AS first_page, list(n.page_id ORDER BY n.page_id)[-1] AS last_page
  FROM norm n JOIN t USING (query_id) GROUP BY 1""")
def c11(spark, d):
    rows = ad.candidates(spark, d)
    totals = ad.qrels(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_total"))
    rec = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("page_id", *CHANNELS))).alias("pages")).join(totals, "query_id")
    return rec.select("query_id", F.size("pages").cast("long").alias("candidates"), "relevant_total", F.element_at("pages", 1)["page_id"].alias("first_page"), F.element_at("pages", -1)["page_id"].alias("last_page"))


@query("c13_c14_replay_audit", f"""WITH {ad.NORM}, l AS (SELECT query_id, page_id FROM ranked WHERE bm25_rank <= {ad.DEPTH} UNION SELECT query_id, page_id FROM ranked WHERE dense_rank <= {ad.DEPTH} UNION SELECT query_id, page_id FROM ranked WHERE visual_rank <= {ad.DEPTH})
  SELECT (SELECT count(*) FROM l ANTI JOIN norm USING (query_id, page_id)) AS not_candidates, (SELECT count(*) FROM norm ANTI JOIN l USING (query_id, page_id)) AS unexplained, 0::BIGINT AS renormalized""")
def c14(spark, d):
    s, c = ad.scores(spark, d), ad.candidates(spark, d)
    lists = ranking.channel_top_lists(s, ad.DEPTH)
    empty = lists.select("query_id", "page_id").limit(0)
    raw_pool = pool.pool_rows(s, ad.DEPTH)
    return pool.union_identity(lists, empty, c).crossJoin(normalize.replayed(raw_pool, c).agg(F.count(F.lit(1)).alias("renormalized")))


@query("c17_c18_mask_status", f"""WITH {ad.RANKED}, m AS (SELECT *, stage1_rank <= 200 OR bm25_rank <= 100 OR dense_rank <= 100 AS initial, stage1_rank <= 300 OR bm25_rank <= 200 OR dense_rank <= 200 AS final FROM ranked),
  g AS (SELECT dataset, query_id, count(CASE WHEN relevance > 0 THEN 1 END) AS relevant_total, count(CASE WHEN relevance > 0 AND initial THEN 1 END) AS relevant_initial, count(CASE WHEN relevance > 0 AND final THEN 1 END) AS relevant_final FROM m GROUP BY 1, 2)
  SELECT *, CASE WHEN relevant_total > 0 THEN relevant_initial / relevant_total END AS coverage_initial, CASE WHEN relevant_total > 0 THEN relevant_final / relevant_total END AS coverage_final,
  CASE WHEN relevant_total = 0 THEN 'missing_or_empty_qrels' WHEN relevant_final / relevant_total >= 0.95 THEN 'ok' ELSE 'candidate_coverage_below_gate' END AS status FROM g""", "coverage_initial coverage_final")
def c17(spark, d):
    """Both depths in one aggregate instead of a full join of two audits."""
    return pool.coverage_audit(pool.masked(ad.raw(spark, d)))


@query("e1_overall_coverage", f"""WITH {ad.RANKED} SELECT count(CASE WHEN relevance > 0 AND (stage1_rank <= 200 OR bm25_rank <= 100 OR dense_rank <= 100) THEN 1 END) / CAST(count(CASE WHEN relevance > 0 THEN 1 END) AS DOUBLE) AS initial,
  count(CASE WHEN relevance > 0 AND (stage1_rank <= 300 OR bm25_rank <= 200 OR dense_rank <= 200) THEN 1 END) / CAST(count(CASE WHEN relevance > 0 THEN 1 END) AS DOUBLE) AS final FROM ranked""", "initial final")
def e1(spark, d):
    m = pool.masked(ad.raw(spark, d))
    return m.agg(pool.coverage(m, "initial").alias("initial"), pool.coverage(m, "final").alias("final"))


@query("h2_chosen_pool", f"""WITH {ad.RANKED}, m AS (SELECT *, stage1_rank <= 200 OR bm25_rank <= 100 OR dense_rank <= 100 AS initial, stage1_rank <= 300 OR bm25_rank <= 200 OR dense_rank <= 200 AS final FROM ranked),
  c AS (SELECT coalesce(count(CASE WHEN relevance > 0 AND initial THEN 1 END) / nullif(count(CASE WHEN relevance > 0 THEN 1 END), 0), 1.0) >= 0.5 AS good FROM m)
  SELECT query_id, page_id FROM m, c WHERE CASE WHEN good THEN initial ELSE final END""")
def h2(spark, d):
    return pool.choose_pool(ad.raw(spark, d), 0.5)[0].select("query_id", "page_id")


# ------------------------------------------------------------ ranks and orders
@query("f1_branch_ranks", f"WITH {ad.RANKED} SELECT query_id, page_id, CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(stage1_rank AS INTEGER) AS stage1_rank, CAST(visual_rank AS INTEGER) AS visual_rank FROM ranked")
def f1(spark, d):
    names = ["bm25_score", "dense_score", "stage1_score", "visual_score"]
    return ranking.with_ranks(ad.raw(spark, d), names).select("query_id", "page_id", "bm25_rank", "dense_rank", "stage1_rank", "visual_rank")


_LISTS = " UNION ALL ".join(f"SELECT query_id, page_id, '{c}' AS channel, CAST({c}_rank AS INTEGER) AS rank, {c}_score AS raw_score FROM ranked WHERE {c}_rank <= 20" for c in ("bm25", "dense", "visual"))


@query("f2_channel_top_lists", f"WITH {ad.RANKED} {_LISTS}")
def f2(spark, d):
    return ranking.channel_top_lists(ad.scores(spark, d), 20)


@query("f4_minmax", f"WITH {ad.NORM} SELECT query_id, page_id, bm25_score, dense_score, visual_score FROM norm", "bm25_score dense_score visual_score")
def f4(spark, d):
    return ad.candidates(spark, d).select(*ad.SCORES)


@query("f5_zscore", f"WITH {ad.POOL} SELECT query_id, page_id, " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER w = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS {c}" for c in CHANNELS) + " FROM pool WINDOW w AS (PARTITION BY query_id)", "bm25_score dense_score visual_score")
def f5(spark, d):
    return normalize.zscore(pool.pool_rows(ad.scores(spark, d), ad.DEPTH)).select(*ad.SCORES)


@query("f6_f7_rank_features", f"WITH {ad.POOL} SELECT query_id, page_id, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE 1.0 - ({RANK.format('bm25_score')} - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) END AS nrank, 1.0 / {RANK.format('bm25_score')} AS rr FROM pool WINDOW w AS (PARTITION BY query_id)", "nrank rr")
def f6(spark, d):
    p = pool.pool_rows(ad.scores(spark, d), ad.DEPTH)
    return p.select("query_id", "page_id", ranking.normalized_rank("bm25_score").alias("nrank"), ranking.reciprocal_rank("bm25_score").alias("rr"))


@query("f8_f9_gaps", f"""WITH {ad.NORM}, r AS (SELECT query_id, visual_score, {RANK.format('visual_score')} AS r FROM norm)
  SELECT query_id, coalesce(max(CASE WHEN r = 1 THEN visual_score END) - max(CASE WHEN r = 2 THEN visual_score END), 0.0) AS margin, coalesce(max(CASE WHEN r = 1 THEN visual_score END) - max(CASE WHEN r = 2 THEN visual_score END), 0.0) AS gap FROM r GROUP BY 1""", "margin gap")
def f8(spark, d):
    c = ad.candidates(spark, d)
    gap = ranking.top_gap(c, "visual_score", "gap").groupBy("query_id").agg(F.max("gap").alias("gap"))
    return ranking.margins(c, "visual_score").join(gap, "query_id")


@query("f10_median_margin", f"WITH {ad.NORM} SELECT query_id, page_id, visual_score - median(visual_score) OVER (PARTITION BY query_id) AS margin FROM norm", "margin")
def f10(spark, d):
    return ad.candidates(spark, d).select("query_id", "page_id", ranking.median_margin("visual_score").alias("margin"))


@query("f11_f12_disagreement", f"""WITH {ad.POOL} SELECT query_id, page_id, abs(bm25_rank - dense_rank) AS apart, sqrt((pow(bm25_rank - m, 2) + pow(dense_rank - m, 2) + pow(visual_rank - m, 2)) / 3) AS spread
  FROM (SELECT *, (bm25_rank + dense_rank + visual_rank) / 3.0::DOUBLE AS m FROM pool)""", "spread")
def f11(spark, d):
    r = ranking.with_ranks(ad.scores(spark, d), CHANNELS)
    r = r.where(F.least("bm25_rank", "dense_rank", "visual_rank") <= ad.DEPTH)
    ranks = [F.col(c).cast("double") for c in ("bm25_rank", "dense_rank", "visual_rank")]
    return r.select("query_id", "page_id", F.abs(F.col("bm25_rank") - F.col("dense_rank")).cast("long").alias("apart"), ranking.spread(*ranks).alias("spread"))


@query("f13_average_ranks", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE AS avg_rank FROM customer")
def f13(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", ranking.average_rank("c_nationkey", ["c_mktsegment"]).alias("avg_rank"))


@query("f15_tolerant_rank", "WITH g AS (SELECT n_regionkey AS k, CAST(count(*) AS DOUBLE) AS v FROM nation GROUP BY 1) SELECT a.k, a.v, count(CASE WHEN b.v - a.v > 1e-12 THEN 1 END) + 1 AS rank FROM g a, g b GROUP BY 1, 2")
def f15(spark, d):
    g = ad.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return ranking.tolerant_rank(g, "k", "v")


@query("f16_largest_remainder", """WITH g AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, 137.0::DOUBLE * size / sum(size) OVER () AS exact FROM g)
  SELECT c_mktsegment, size, exact, CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, c_mktsegment) <= 137 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM e""", "exact")
def f16(spark, d):
    return ranking.allocate(ad.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("size")), "size", 137, ["c_mktsegment"])


@query("g2_top_k", f"WITH {ad.RANKED} SELECT query_id, page_id, CAST(visual_rank AS INTEGER) AS rank, visual_score FROM ranked WHERE visual_rank <= 10")
def g2(spark, d):
    """The listing of the best ten."""
    return ranking.top(ad.scores(spark, d), "visual_score", 10).select("query_id", "page_id", "rank", "visual_score")


@query("g5_worst_queries", f"WITH {ad.NORM}, e AS (SELECT * FROM {ad.evaluate_sql('norm', 'visual_score')}) SELECT query_id, ndcg10 FROM e ORDER BY round(ndcg10, 9), query_id LIMIT 10", "ndcg10")
def g5(spark, d):
    m = metrics.evaluate(ad.labelled(spark, d), "visual_score")
    return m.select("query_id", "ndcg10").orderBy(F.round("ndcg10", 9), "query_id").limit(10)


@query("g6_systematic", "WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS n FROM customer), s AS (SELECT i FROM range(7) g(i)) SELECT c_custkey, CAST(position AS INTEGER) AS position FROM p, s WHERE position = i * n // 7")
def g6(spark, d):
    return ranking.systematic(ad.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


@query("g8_first_relevant", f"WITH {ad.RANKED} SELECT query_id, CAST(min(CASE WHEN relevance > 0 THEN visual_rank END) AS INTEGER) AS first_rank, any_value(CASE WHEN visual_rank = 1 THEN page_id END) AS top_page FROM ranked WHERE visual_rank <= 10 GROUP BY 1")
def g8(spark, d):
    return ranking.first_relevant(ad.raw(spark, d), "visual_score")


# ------------------------------------------------------------ pools and sets
@query("h1_union_pool", f"WITH {ad.POOL} SELECT query_id, page_id FROM pool")
def h1(spark, d):
    return pool.union_pool(ad.scores(spark, d), ad.DEPTH)


@query("h3_union_identity", "SELECT 0::BIGINT AS not_candidates, 0::BIGINT AS unexplained")
def h3(spark, d):
    s = ad.scores(spark, d)
    extra = pool.expand_top_document(s, ad.DEPTH)
    whole = pool.union_pool(s, ad.DEPTH).unionByName(extra.select("query_id", "page_id"))
    return pool.union_identity(ranking.channel_top_lists(s, ad.DEPTH), extra, whole)


@query("h4_h7_set_differences", f"WITH {ad.RANKED}, a AS (SELECT DISTINCT query_id, page_id FROM ranked WHERE least(bm25_rank, dense_rank) <= 20), b AS (SELECT DISTINCT query_id, page_id FROM ranked WHERE least(dense_rank, visual_rank) <= 20) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right")
def h4(spark, d):
    s = ad.scores(spark, d)
    return contracts.same_rows(pool.union_pool(s, 20, ["bm25_score", "dense_score"]), pool.union_pool(s, 20, ["dense_score", "visual_score"]))


@query("h8_bag_difference", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS missing, CAST(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) AS BIGINT) AS surplus FROM a FULL JOIN b USING (k)")
def h8(spark, d):
    t = ad.table(spark, d, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == i).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias(n)) for i, n in (("A", "a"), ("R", "b")))
    j = a.join(b, "k", "full").na.fill(0)
    return j.agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("surplus"))


_PER = f"""t AS (SELECT query_id, count(*) AS relevant_total FROM raw WHERE relevance > 0 GROUP BY 1),
  per AS (SELECT s.query_id, coalesce(t.relevant_total, 0) AS relevant_total, (SELECT count(*) FROM pool p WHERE p.query_id = s.query_id AND p.relevance > 0) AS relevant_in_candidates FROM (SELECT CAST(s_suppkey AS VARCHAR) AS query_id FROM supplier) s LEFT JOIN t USING (query_id))"""


@query("e2_l9_pool_coverage", f"WITH {ad.POOL}, {_PER} SELECT *, CASE WHEN relevant_total > 0 THEN relevant_in_candidates / relevant_total END AS coverage FROM per", "coverage")
def e2(spark, d):
    return pool.pool_coverage(pool.union_pool(ad.scores(spark, d), ad.DEPTH), ad.qrels(spark, d), ad.query_list(spark, d))


@query("e3_coverage_by_role", f"""WITH {ad.POOL}, {_PER}, c AS (SELECT *, CASE WHEN relevant_total > 0 THEN relevant_in_candidates / relevant_total END AS coverage, CASE WHEN CAST(query_id AS BIGINT) % 3 = 0 THEN 'test' ELSE 'train' END AS role FROM per)
  SELECT role, count(*) AS queries, avg(coverage) AS macro_coverage, count(CASE WHEN coverage < 1 THEN 1 END) AS uncovered, CASE WHEN coalesce(avg(coverage), 1.0) >= 0.95 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM c GROUP BY ROLLUP (role)""", "macro_coverage")
def e3(spark, d):
    """Split totals and the overall total as one rollup."""
    per = pool.pool_coverage(pool.union_pool(ad.scores(spark, d), ad.DEPTH), ad.qrels(spark, d), ad.query_list(spark, d))
    roles = per.select("query_id", F.when(F.col("query_id").cast("long") % 3 == 0, "test").otherwise("train").alias("role"))
    return pool.coverage_by_role(per, roles)


@query("e4_all_corpus_coverage", "SELECT (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) AS pairs, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) AS known_pages")
def e4(spark, d):
    known = ad.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(ad.table(spark, d, "part"), "p_partkey", "left_semi")
    n = ad.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("a")).crossJoin(ad.table(spark, d, "part").agg(F.count(F.lit(1)).alias("b")))
    return n.select((F.col("a") * F.col("b")).alias("pairs")).crossJoin(known.agg(F.count(F.lit(1)).alias("known_pages")))


@query("e5_rescued", f"""WITH {ad.RANKED}, c AS (SELECT query_id, count(CASE WHEN relevance > 0 AND least(bm25_rank, dense_rank, visual_rank) <= 50 THEN 1 END) AS a, count(CASE WHEN relevance > 0 AND least(bm25_rank, dense_rank, visual_rank) <= 150 THEN 1 END) AS b, count(CASE WHEN relevance > 0 THEN 1 END) AS t FROM ranked GROUP BY 1)
  SELECT query_id, CASE WHEN b >= t THEN 'rescued' ELSE 'still_uncovered' END AS state FROM c WHERE t > 0 AND a < t""")
def e5(spark, d):
    s, q = ad.scores(spark, d), ad.qrels(spark, d)
    return pool.rescued(pool.pool_coverage(pool.union_pool(s, 50), q), pool.pool_coverage(pool.union_pool(s, 150), q))


_DOCS = ad.RANKED + """, f AS (SELECT *, 1.0 / (60 + bm25_rank) + 1.0 / (60 + dense_rank) + 1.0 / (60 + visual_rank) AS rrf, regexp_extract(page_id, '^(.+)_page_[0-9]+$', 1) AS document_id, least(bm25_rank, dense_rank, visual_rank) <= 50 AS base FROM ranked),
  b AS (SELECT query_id, document_id, max(rrf) AS document_rrf, row_number() OVER (PARTITION BY query_id ORDER BY max(rrf) DESC, document_id) AS r FROM f GROUP BY 1, 2)"""


@query("x1_top_document", f"WITH {_DOCS} SELECT query_id, document_id, document_rrf FROM b WHERE r = 1", "document_rrf")
def x1(spark, d):
    return pool.top_document(ad.scores(spark, d))


@query("x2_expand_top_document", f"""WITH {_DOCS}, m AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY rrf DESC, page_id) AS priority FROM f JOIN b ON b.query_id = f.query_id AND b.document_id = f.document_id AND b.r = 1 WHERE NOT base),
  n AS (SELECT query_id, count(CASE WHEN base THEN 1 END) AS base_count FROM f GROUP BY 1)
  SELECT m.query_id, page_id, document_id, CAST(priority AS INTEGER) AS priority, rrf AS rrf_score FROM m JOIN n USING (query_id) WHERE priority <= 150 - base_count""", "rrf_score")
def x2(spark, d):
    """Expansion by full-corpus reciprocal-rank fusion."""
    return pool.expand_top_document(ad.scores(spark, d), ad.DEPTH)


_SHORT = ("bm25", "dense", "visual")


@query("x16_missed_relevant", f"""WITH {ad.RAW}, r AS MATERIALIZED (SELECT query_id, page_id, relevance, {', '.join(f"{c}_score, row_number() OVER (PARTITION BY query_id ORDER BY {c}_score DESC, page_id) AS {c}_rank" for c in _SHORT)} FROM raw),
  k AS (SELECT query_id, {', '.join(f"max(CASE WHEN {c}_rank = {ad.DEPTH} THEN {c}_score END) AS {c}_cutoff" for c in _SHORT)} FROM r GROUP BY 1),
  p AS (SELECT * FROM r JOIN k USING (query_id) WHERE relevance > 0 AND least({', '.join(f"{c}_rank" for c in _SHORT)}) > {ad.DEPTH})
  {' UNION ALL '.join(f"SELECT query_id, page_id, '{c}' AS channel, CAST({c}_score AS DOUBLE) AS raw_score, CAST({c}_rank AS INTEGER) AS rank, CAST({c}_cutoff AS DOUBLE) AS cutoff FROM p" for c in _SHORT)}""")
def x16(spark, d):
    """Where positives outside the pool stand in each channel."""
    from ..operators.audit import missed_relevant

    s = ad.scores(spark, d)
    return missed_relevant(s, ad.qrels(spark, d), pool.union_pool(s, ad.DEPTH), ad.DEPTH, CHANNELS)


# ------------------------------------------------------------ fusion and metrics
_EVAL = lambda score: f"WITH {ad.NORM} SELECT * FROM {ad.evaluate_sql('norm', score)}"
_UNI = "((bm25_score + dense_score + visual_score) / 3.0)"


@query("l6_uniform_metrics", _EVAL(_UNI), METRICS)
def l6(spark, d):
    """Flagship: pool, normalize, fuse uniformly, evaluate."""
    return metrics.evaluate(ad.labelled(spark, d).withColumn("score", fusion.uniform()), "score")


@query("e6_mean_metrics", f"SELECT count(*) AS queries, avg(ndcg10) AS ndcg10, avg(recall1) AS recall1, avg(recall3) AS recall3, avg(mrr10) AS mrr10 FROM ({_EVAL(_UNI)})", METRICS)
def e6(spark, d):
    return metrics.mean_metrics(metrics.evaluate(ad.labelled(spark, d).withColumn("score", fusion.uniform()), "score"))


@query("k1_single_channel", _EVAL("visual_score"), METRICS)
def k1(spark, d):
    return metrics.evaluate(ad.labelled(spark, d), "visual_score")


_RRF = ad.POOL + f", rrf AS (SELECT query_id, page_id, relevance, 1.0 / (60 + {RANK.format('bm25_score')}) + 1.0 / (60 + {RANK.format('dense_score')}) + 1.0 / (60 + {RANK.format('visual_score')}) AS score FROM pool)"


@query("k3_rrf", f"WITH {_RRF} SELECT * FROM {ad.evaluate_sql('rrf', 'round(score, 12)')}", METRICS)
def k3(spark, d):
    p = pool.pool_rows(ad.scores(spark, d), ad.DEPTH)
    fused = p.select("query_id", "page_id", F.round(fusion.rrf_of(CHANNELS, ["query_id"]), 12).alias("score"))
    return metrics.evaluate(ad.with_labels(fused, ad.qrels(spark, d)), "score")


@query("k5_rrf_from_ranks", f"WITH {ad.RANKED} SELECT query_id, page_id, 1.0 / (60 + bm25_rank) + 1.0 / (60 + dense_rank) + 1.0 / (60 + visual_rank) AS rrf FROM ranked", "rrf")
def k5(spark, d):
    """Ranks packed as JSON and read back."""
    r = ranking.with_ranks(ad.raw(spark, d), ["bm25_score", "dense_score", "stage1_score", "visual_score"])
    packed = F.to_json(F.struct(*[F.col(f"{b}_rank").alias(b) for b in contracts.BRANCHES]))
    return r.withColumn("branch_ranks", packed).select("query_id", "page_id", fusion.rrf_from_ranks("branch_ranks").alias("rrf"))


@query("k6_static_weights", _EVAL("(0.2 * bm25_score + 0.3 * dense_score + 0.5 * visual_score)"), METRICS)
def k6(spark, d):
    return metrics.evaluate(ad.labelled(spark, d).withColumn("score", fusion.weighted((0.2, 0.3, 0.5))), "score")


_LIN = {"bm25": "bm25_score", "dense": "dense_score", "visual": "visual_score", "drop_bm25": "0.5 * dense_score + 0.5 * visual_score", "drop_dense": "0.5 * bm25_score + 0.5 * visual_score", "drop_visual": "0.5 * bm25_score + 0.5 * dense_score", "uniform": _UNI}


@query("k7_fixed_methods", f"""WITH {ad.NORM}, m AS ({' UNION ALL '.join(f"SELECT '{n}' AS method, query_id, page_id, relevance, {e} AS score FROM norm" for n, e in _LIN.items())}
  UNION ALL SELECT 'rrf', query_id, page_id, relevance, 1.0 / (60 + {RANK.format('bm25_score')}) + 1.0 / (60 + {RANK.format('dense_score')}) + 1.0 / (60 + {RANK.format('visual_score')}) FROM pool)
  SELECT method, count(*) AS queries, avg(ndcg10) AS ndcg10, avg(recall1) AS recall1, avg(recall3) AS recall3, avg(mrr10) AS mrr10 FROM {ad.evaluate_sql('(SELECT method, query_id, page_id, relevance, round(score, 9) AS score FROM m)', 'score', 'method, query_id')} GROUP BY 1""", METRICS)
def k7(spark, d):
    raw_pool = pool.pool_rows(ad.scores(spark, d), ad.DEPTH)
    long = fusion.fixed_methods(raw_pool, normalize.minmax(raw_pool)).where("method <> 'uniform_z'").withColumn("score", F.round("score", 9))
    return metrics.mean_metrics(metrics.evaluate(ad.with_labels(long, ad.qrels(spark, d)), "score", ["method", "query_id"]), ["method"])


@query("k9_co_strongest", "WITH g AS (SELECT n_regionkey AS method, CAST(count(*) AS DOUBLE) AS v FROM nation GROUP BY 1) SELECT * FROM g WHERE (SELECT max(v) FROM g) - v <= 1e-12")
def k9(spark, d):
    g = ad.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("method")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return fusion.co_strongest(g, "v")


_TOT = "tot AS (SELECT query_id, count(*) AS relevant_total FROM raw WHERE relevance > 0 GROUP BY 1)"


@query("l2_binary_metrics", f"WITH {ad.NORM}, {_TOT} SELECT * FROM {ad.binary_sql('norm', 'visual_score', 'tot')}", METRICS)
def l2(spark, d):
    """Against all positives, those outside the pool included."""
    totals = ad.qrels(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_total"))
    return metrics.evaluate_against(ad.labelled(spark, d), "visual_score", totals)


@query("l3_document_metrics", f"""WITH {ad.NORM}, docs AS (SELECT query_id, regexp_extract(page_id, '^(.+)_page_[0-9]+$', 1) AS page_id, max(visual_score) AS visual_score, max(relevance) AS relevance FROM norm GROUP BY 1, 2),
  tot AS (SELECT query_id, count(DISTINCT regexp_extract(page_id, '^(.+)_page_[0-9]+$', 1)) AS relevant_total FROM raw WHERE relevance > 0 GROUP BY 1) SELECT * FROM {ad.binary_sql('docs', 'visual_score', 'tot')}""", METRICS)
def l3(spark, d):
    """Pages max-pooled to documents."""
    doc = scalars.document_of("page_id")
    totals = ad.qrels(spark, d).groupBy("query_id").agg(F.count_distinct(doc).alias("relevant_total"))
    return metrics.evaluate_against(metrics.to_documents(ad.labelled(spark, d), "visual_score", doc), "visual_score", totals)


@query("e17_max_pool", f"WITH {ad.NORM} SELECT query_id, regexp_extract(page_id, '^(.+)_page_[0-9]+$', 1) AS page_id, max(relevance) AS relevance, max(visual_score) AS visual_score, arg_min(page_id, (-visual_score, page_id)) AS winner FROM norm GROUP BY 1, 2", "visual_score")
def e17(spark, d):
    return metrics.to_documents(ad.labelled(spark, d), "visual_score", scalars.document_of("page_id"))


_QM = f"""WITH {ad.RAW}, a AS (SELECT * FROM {ad.evaluate_sql('raw', 'stage1_score', 'dataset, query_id')}), b AS (SELECT * FROM {ad.evaluate_sql('raw', 'full_score', 'dataset, query_id')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage1_score DESC, page_id) AS r FROM raw),
  m AS (SELECT query_id, any_value(source) AS source, count(CASE WHEN relevance > 0 THEN 1 END) AS relevant_count, coalesce(max(CASE WHEN r = 1 THEN stage1_score END) - max(CASE WHEN r = 2 THEN stage1_score END), 0.0) AS stage1_margin, any_value(stage2_ms) AS stage2_ms, any_value(stage2_flops) AS stage2_flops FROM r GROUP BY 1)
  SELECT a.dataset, a.query_id, m.source, m.relevant_count, a.ndcg10 AS ndcg_stage1, b.ndcg10 AS ndcg_full, a.recall1 AS recall1_stage1, b.recall1 AS recall1_full, a.recall3 AS recall3_stage1, b.recall3 AS recall3_full,
    a.mrr10 AS mrr10_stage1, b.mrr10 AS mrr10_full, m.stage1_margin, m.stage2_ms, m.stage2_flops FROM a JOIN b USING (query_id) JOIN m USING (query_id)"""


@query("l7_query_metrics", _QM, "ndcg_stage1 ndcg_full recall1_stage1 recall1_full recall3_stage1 recall3_full mrr10_stage1 mrr10_full stage1_margin")
def l7(spark, d):
    return metrics.query_metrics(ad.raw(spark, d))


@query("a24_b7_pivot_unpivot", f"WITH {ad.NORM} SELECT query_id, page_id, bm25_score AS bm25, dense_score AS dense, visual_score AS visual FROM norm", "bm25 dense visual")
def b7(spark, d):
    from ..sources.writers import pivot_methods

    long = ranking.long_channels(ad.candidates(spark, d)).withColumnsRenamed({"channel": "method", "raw_score": "score"})
    return pivot_methods(long, ["bm25", "dense", "visual"])


@query("e12_constant_channels", f"WITH {ad.POOL}, g AS (SELECT query_id, min(bm25_score) = max(bm25_score) AS a, min(dense_score) = max(dense_score) AS b, min(visual_score) = max(visual_score) AS c FROM pool GROUP BY 1) SELECT count(CASE WHEN a THEN 1 END) AS bm25, count(CASE WHEN b THEN 1 END) AS dense, count(CASE WHEN c THEN 1 END) AS visual FROM g")
def e12(spark, d):
    p = pool.pool_rows(ad.scores(spark, d), ad.DEPTH)
    flat = p.groupBy("query_id").agg(*[(F.min(c) == F.max(c)).alias(c) for c in CHANNELS])
    return flat.agg(*[F.count_if(c).alias(c.removesuffix("_score")) for c in CHANNELS])


@query("e18_e19_pool_sizes", f"WITH {ad.POOL}, g AS (SELECT query_id, count(*) AS n FROM pool GROUP BY 1) SELECT count(*) AS queries, min(n) AS smallest, max(n) AS largest, avg(n) AS mean FROM g", "mean")
def e19(spark, d):
    g = pool.pool_rows(ad.scores(spark, d), ad.DEPTH).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


@query("d13_d12_cross_pairs", "SELECT s_suppkey, n_nationkey FROM supplier, nation")
def d12(spark, d):
    q = ad.table(spark, d, "supplier").select("s_suppkey")
    return q.crossJoin(F.broadcast(ad.table(spark, d, "nation").select("n_nationkey")))


@query("d5_d6_labels_and_roles", f"""WITH {ad.NORM} SELECT CASE WHEN CAST(query_id AS BIGINT) % 3 = 0 THEN 'test' ELSE 'train' END AS role, count(*) AS n, count(CASE WHEN relevance > 0 THEN 1 END) AS positives FROM norm GROUP BY 1""")
def d5(spark, d):
    roles = ad.query_list(spark, d).withColumn("role", F.when(F.col("query_id").cast("long") % 3 == 0, "test").otherwise("train"))
    return ad.labelled(spark, d).join(roles, "query_id").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevance") > 0).alias("positives"))


@query("d8_d16_prediction_cover", f"WITH {ad.POOL} SELECT (SELECT count(*) FROM pool) AS pairs, 0::BIGINT AS only_left, 0::BIGINT AS only_right")
def d8(spark, d):
    a = pool.union_pool(ad.scores(spark, d), ad.DEPTH)
    b = ad.candidates(spark, d).select("query_id", "page_id")
    return a.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(contracts.same_rows(a, b))


@query("x6_document_index", "WITH p AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand AS document_id, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS document_index FROM p")
def x6(spark, d):
    from ..operators.scorers import dense_index

    return dense_index(ad.table(spark, d, "part").select(F.col("p_brand").alias("document_id")).distinct()).select("document_id", "document_index")


@query("x9_prediction_parity", f"WITH {ad.NORM} SELECT CAST(0 AS DOUBLE) AS max_difference, 0::BIGINT AS unmatched, 0::BIGINT AS reordered_queries")
def x9(spark, d):
    """X11, Q8: the same scores computed along two plans."""
    from ..operators.audit import prediction_parity

    a = ad.candidates(spark, d).withColumn("score", fusion.weighted((0.5, 0.5, 0.0)))
    b = ad.candidates(spark, d).withColumn("score", F.col("bm25_score") * 0.5 + F.col("dense_score") * 0.5 + F.col("visual_score") * 0.0)
    return prediction_parity(a, b)


@query("x20_workload", "SELECT c_custkey, pass, position < 20 AS warm_up FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) c, range(6) g(pass)")
def x20(spark, d):
    c = ranking.numbered(ad.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "position").withColumn("position", F.col("position") - 1)
    return c.select("c_custkey", F.explode(F.expr("sequence(0L, 5L)")).alias("pass"), (F.col("position") < 20).alias("warm_up"))
