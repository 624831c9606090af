"""Queries of audits, sampling, splits, sinks and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, decisions, sampling, stats
from ..sources import readers, writers
from ..sources.scratch import folder
from ..streaming import scores as streaming
from . import adapters as ad
from .registry import query

_HASH = "sha256({0} || ':' || CAST({1} AS VARCHAR))"


@query("o2_hash_sample", f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY {_HASH.format(chr(39) + 's1' + chr(39), 'c_custkey')}, c_custkey LIMIT 100")
def o2(spark, d):
    return sampling.hash_sample(ad.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100, "s1")


_SPLIT = f"""p AS (SELECT c_custkey, row_number() OVER (ORDER BY {_HASH.format("'ns:2026'", 'c_custkey')}, c_custkey) AS p, count(*) OVER () AS n FROM customer),
  r AS (SELECT c_custkey, CASE WHEN p <= CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) THEN 'train' WHEN p <= CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) + CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) THEN 'validation' ELSE 'test' END AS role FROM p)"""


@query("o5_ratio_split", f"WITH {_SPLIT} SELECT * FROM r")
def o5(spark, d):
    """I16: half-even counts; A10, A11: the roles of a split bundle."""
    return sampling.ratio_split(ad.table(spark, d, "customer").select("c_custkey"), "c_custkey", "ns", "2026")


@query("h5_split_overlaps", f"WITH {_SPLIT} SELECT count(*) AS row_count, count(DISTINCT c_custkey) AS key_count, 0::BIGINT AS overlapping FROM r")
def h5(spark, d):
    return sampling.split_overlaps(sampling.ratio_split(ad.table(spark, d, "customer").select("c_custkey"), "c_custkey", "ns", "2026"), "c_custkey")


@query("o4_two_way_split", f"SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY {_HASH.format(chr(39) + 'two' + chr(39), 'c_custkey')}, c_custkey) <= 300 THEN 'selected' ELSE 'reserve' END AS part FROM customer")
def o4(spark, d):
    return sampling.two_way_split(ad.table(spark, d, "customer").select("c_custkey"), "c_custkey", "two", 300)


@query("o1_stratified", f"""WITH g AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, 200.0::DOUBLE * size / sum(size) OVER () AS exact FROM g),
  a AS (SELECT c_mktsegment, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, c_mktsegment) <= 200 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS share FROM e),
  r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HASH.format(chr(39) + 'st' + chr(39), 'c_custkey')}, c_custkey) AS r FROM customer)
  SELECT c_custkey, c_mktsegment FROM r JOIN a USING (c_mktsegment) WHERE r <= share""")
def o1(spark, d):
    return sampling.stratified(ad.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 200, "st")


@query("o3_dev_holdout", f"SELECT c_custkey, CASE WHEN r <= 5 THEN 'dev' ELSE 'holdout' END AS part FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HASH.format(chr(39) + 'dh' + chr(39), 'c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 12")
def o3(spark, d):
    """Hash positions inside strata."""
    return sampling.positions(ad.table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "dh", 5, 7).select("c_custkey", "part")


@query("g9_probe_pages", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS l FROM customer),
  k AS (SELECT *, CAST(CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 WHEN s = 1 THEN 2 WHEN l = 1 THEN 3 ELSE 4 END AS INTEGER) AS pick FROM p)
  SELECT c_nationkey, c_custkey, pick FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY pick, {_HASH.format(chr(39) + 'pr' + chr(39), 'c_custkey')}, c_custkey) AS r FROM k) WHERE r <= 6""")
def g9(spark, d):
    return sampling.probe_pages(ad.table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 6, "pr").select("c_nationkey", "c_custkey", "pick")


# ------------------------------------------------------------ audits
@query("p1_page_manifest", f"WITH {ad.PAGES} SELECT page_id, sha256(content) AS content_sha256, page_id = document_id || '_page_' || lpad(CAST(page_number AS VARCHAR), 4, '0') AS canonical, count(*) OVER (PARTITION BY lower(page_id)) - 1 AS case_twins FROM pages_t")
def p1(spark, d):
    return audit.page_manifest(ad.corpus_pages(spark, d)).select("page_id", "content_sha256", "canonical", "case_twins")


@query("b8_g7_canonical_manifest", f"WITH {ad.PAGES} SELECT count(*) AS rows, 0::BIGINT AS descents, false AS overlaps, min(page_id) AS first_page, max(page_id) AS last_page FROM pages_t")
def b8(spark, d):
    """The manifest as a list in canonical order, read again as it stands."""
    at, kinds = folder(spark, "manifest"), "document_id string, page_id string, page_number int, source_path string, content_sha256 string, split string"
    pages = audit.page_manifest(ad.corpus_pages(spark, d)).select("document_id", "page_id", "page_number", F.col("source").alias("source_path"), "content_sha256", "split")
    writers.write_canonical(pages, at, "manifest")
    f = writers.canonical_faults(spark, at, "manifest", kinds)
    return f.agg(F.sum("rows").alias("rows"), F.sum("descents").alias("descents"), F.bool_or("overlaps").alias("overlaps"), F.min("first.page_id").alias("first_page"), F.max("last.page_id").alias("last_page"))


@query("a14_annotation_faults", """WITH a AS (SELECT printf('%040x_%d', doc_id // 3, doc_id % 3) AS query_id, coalesce(text, '') AS text,
  CASE WHEN doc_id % 41 = 5 THEN printf('%040x', doc_id // 3 + 1) ELSE printf('%040x', doc_id // 3) END AS document_id, CASE WHEN doc_id % 29 = 2 THEN [1, 1] WHEN doc_id % 23 = 7 THEN [0] WHEN doc_id % 19 = 3 THEN [] ELSE [1, doc_id % 5 + 2] END AS pages FROM documents)
  SELECT query_id, CASE WHEN document_id <> split_part(query_id, '_', 1) THEN 'file_name' WHEN trim(text, ' ') = '' THEN 'query' WHEN len(pages) = 0 THEN 'no_pages' WHEN list_min(pages) < 1 THEN 'page_number' WHEN len(list_distinct(pages)) < len(pages) THEN 'repeated_page' END AS fault
  FROM a WHERE fault IS NOT NULL""")
def a14(spark, d):
    """Documents as annotated queries, three a document, with planted faults."""
    i = F.col("doc_id")
    document = lambda x: F.lpad(F.lower(F.hex(x)), 40, "0")
    whole = F.expr("doc_id div 3")
    pages = F.when(i % 29 == 2, F.array(F.lit(1), F.lit(1))).when(i % 23 == 7, F.array(F.lit(0))).when(i % 19 == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), (i % 5 + 2).cast("int")))
    q = ad.table(spark, d, "documents").select(
        F.concat_ws("_", document(whole), (i % 3).cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.when(i % 41 == 5, document(whole + 1)).otherwise(document(whole)).alias("document_id"), pages.alias("pages")
    )
    return readers.annotation_faults(q)


_GROUPS = f"{ad.PAGES}, h AS (SELECT *, sha256(content) AS content_sha256 FROM pages_t), g AS (SELECT content_sha256, count(*) AS pages, list_sort(list(DISTINCT split)) AS splits FROM h GROUP BY 1 HAVING count(*) > 1)"


@query("p3_duplicate_groups", f"WITH {_GROUPS} SELECT content_sha256, pages, printf('DUP-%04d', dense_rank() OVER (ORDER BY content_sha256)) AS group_id, array_to_string(splits, ',') AS splits FROM g")
def p3(spark, d):
    return audit.duplicate_groups(audit.page_manifest(ad.corpus_pages(spark, d))).withColumn("splits", F.array_join("splits", ","))


@query("d10_duplicate_pairs", f"WITH {_GROUPS} SELECT a.page_id AS left_id, b.page_id AS right_id, a.split AS left_split, b.split AS right_split FROM h a JOIN h b ON a.content_sha256 = b.content_sha256 AND a.page_id < b.page_id")
def d10(spark, d):
    return audit.duplicate_pairs(audit.page_manifest(ad.corpus_pages(spark, d)))


@query("d10_duplicate_members", f"WITH {_GROUPS}, m AS (SELECT content_sha256, min(page_id) AS representative FROM h GROUP BY 1 HAVING count(*) > 1) SELECT h.content_sha256, page_id AS member, representative FROM h JOIN m USING (content_sha256)")
def d10b(spark, d):
    """Membership instead of all pairs."""
    return audit.duplicate_members(audit.page_manifest(ad.corpus_pages(spark, d)))


@query("p4_d11_leaks", f"WITH {_GROUPS} SELECT content_sha256, pages, array_to_string(list_filter(splits, lambda s: s NOT IN ('shared', 'unassigned')), ',') AS closed FROM g WHERE len(list_filter(splits, lambda s: s NOT IN ('shared', 'unassigned'))) > 1")
def p4(spark, d):
    g = audit.leaks(audit.duplicate_groups(audit.page_manifest(ad.corpus_pages(spark, d))))
    return g.select("content_sha256", "pages", F.array_join("closed", ",").alias("closed"))


def _aliases(spark, d):
    p = ad.table(spark, d, "part")
    doc, num = F.expr("p_partkey div 10"), F.expr("p_partkey % 10")
    ref = F.when(F.col("p_partkey") % 4 == 0, F.format_string("doc%06d_page_%04d.png", doc, num)).when(F.col("p_partkey") % 4 == 1, F.format_string("doc%06d#page=%d", doc, num)).when(F.col("p_partkey") % 4 == 2, F.format_string("doc%06d:%d", doc, num)).otherwise(F.lit("unknown"))
    return p.select(F.format_string("a%d", F.expr("p_partkey div 2")).alias("alias_id"), ref.alias("reference"), F.col("p_partkey").alias("position"))


@query("p2_i7_aliases", f"""WITH {ad.PAGES}, a AS (SELECT 'a' || (p_partkey // 2) AS alias_id, p_partkey AS position, CASE p_partkey % 4 WHEN 0 THEN printf('doc%06d_page_%04d.png', p_partkey // 10, p_partkey % 10) WHEN 1 THEN printf('doc%06d#page=%d', p_partkey // 10, p_partkey % 10) WHEN 2 THEN printf('doc%06d:%d', p_partkey // 10, p_partkey % 10) ELSE 'unknown' END AS reference,
    printf('doc%06d_page_%04d', p_partkey // 10, p_partkey % 10) AS target, ['canonical_form', 'fragment', 'separator', 'unresolved'][p_partkey % 4 + 1] AS reason FROM part),
  f AS (SELECT *, row_number() OVER (PARTITION BY alias_id ORDER BY position) AS r FROM a)
  SELECT alias_id, reference, CASE WHEN reason <> 'unresolved' THEN target END AS page_id, reason, reason <> 'unresolved' AND target IN (SELECT page_id FROM pages_t) AS resolved FROM f WHERE r = 1""")
def p2(spark, d):
    return audit.resolve_aliases(_aliases(spark, d), ad.corpus_pages(spark, d))


_QR = "q AS (SELECT CAST(l_suppkey AS VARCHAR) AS query_id, CAST(l_partkey AS VARCHAR) AS page_id FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 45 GROUP BY 1, 2), k AS (SELECT CAST(p_partkey AS VARCHAR) AS page_id FROM part WHERE p_size > 5)"


def _qr(spark, d):
    q = ad.table(spark, d, "lineitem").where("l_discount >= 0.1 AND l_quantity > 45").select(F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("page_id"), F.lit(1.0).alias("relevance")).distinct()
    return q, ad.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("page_id"))


@query("p5_d7_qrel_consistency", f"""WITH {_QR}, p AS (SELECT query_id, count(k.page_id) AS valid, count(*) - count(k.page_id) AS missing FROM q LEFT JOIN k USING (page_id) GROUP BY 1)
  SELECT count(CASE WHEN valid > 0 AND missing = 0 THEN 1 END) AS valid_queries, count(CASE WHEN valid = 0 OR missing > 0 THEN 1 END) AS orphan_queries, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing_targets, (SELECT count(*) FROM k ANTI JOIN q USING (page_id)) AS unreferenced_pages FROM p""")
def p5(spark, d):
    """H6: pages that no label refers to."""
    return audit.qrel_consistency(*_qr(spark, d))


@query("p6_e21_overlaps", f"""WITH {ad.PAGES}, a AS (SELECT count(DISTINCT split) AS s, count(*) AS n FROM pages_t GROUP BY sha256(content)), b AS (SELECT count(DISTINCT split) AS s, count(*) AS n FROM pages_t GROUP BY trim(regexp_replace(lower(content), '\\s+', ' ', 'g')))
  SELECT (SELECT count(*) FROM a WHERE s > 1) AS exact_overlaps, (SELECT count(*) FROM a WHERE n > 1) AS exact_groups, (SELECT count(*) FROM b WHERE s > 1) AS loose_overlaps, (SELECT count(*) FROM b WHERE n > 1) AS loose_groups""")
def p6(spark, d):
    return audit.overlap_report(ad.corpus_pages(spark, d), "content", "split")


@query("p7_audit_status", f"""WITH {_GROUPS}, {_QR}, p AS (SELECT query_id, count(*) - count(k.page_id) AS missing FROM q LEFT JOIN k USING (page_id) GROUP BY 1)
  SELECT CASE WHEN (SELECT count(*) FROM g WHERE len(list_filter(splits, lambda s: s NOT IN ('shared', 'unassigned'))) > 1) > 0 THEN 'leakage' WHEN (SELECT count(*) FROM p WHERE missing > 0) > 0 THEN 'orphans' ELSE 'pass' END AS status""")
def p7(spark, d):
    leaks = audit.leaks(audit.duplicate_groups(audit.page_manifest(ad.corpus_pages(spark, d)))).agg(F.count(F.lit(1)).alias("leaks"))
    orphans = audit.qrel_consistency(*_qr(spark, d)).select(F.col("orphan_queries").alias("orphans"))
    row = leaks.crossJoin(orphans).withColumns({"unresolved_aliases": F.lit(0), "split_overlaps": F.lit(0)})
    return row.select(decisions.audit_status().alias("status"))


@query("p8_asset_identity", """WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS page_id, 'p/' || l_suppkey || '.png' AS asset_path, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey % 2 AS VARCHAR) ELSE 'h' END AS asset_sha256 FROM lineitem)
  SELECT page_id, CASE WHEN count(DISTINCT asset_sha256) = 1 THEN 'canonical' ELSE 'conflict' END AS state, min(asset_path) AS canonical_path, array_to_string(list_filter(list_sort(list(DISTINCT asset_path)), lambda x: x <> min(asset_path)), ',') AS aliases FROM a GROUP BY 1""".replace("list_filter(list_sort(list(DISTINCT asset_path)), lambda x: x <> min(asset_path))", "list_sort(list(DISTINCT asset_path))[2:]"))
def p8(spark, d):
    t = ad.table(spark, d, "lineitem")
    a = t.select(F.col("l_partkey").cast("string").alias("page_id"), F.concat(F.lit("p/"), "l_suppkey", F.lit(".png")).alias("asset_path"), F.when(F.col("l_partkey") % 3 == 0, (F.col("l_suppkey") % 2).cast("string")).otherwise("h").alias("asset_sha256"))
    return audit.asset_identity(a).withColumn("aliases", F.array_join("aliases", ","))


@query("d17_d18_bindings", "WITH a AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size > 3), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE p_brand END AS v FROM part WHERE p_size < 48) SELECT count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.v = b.v THEN 1 END) AS bound, count(CASE WHEN b.k IS NULL THEN 1 END) AS missing, count(CASE WHEN a.k IS NULL THEN 1 END) AS unexpected, count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.v <> b.v THEN 1 END) AS different FROM a FULL JOIN b ON a.k = b.k")
def d17(spark, d):
    """A manifest against an inventory has the same form."""
    p = ad.table(spark, d, "part")
    a = p.where("p_size > 3").select("p_partkey", "p_brand")
    b = p.where("p_size < 48").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, "x").otherwise(F.col("p_brand")).alias("p_brand"))
    return audit.binding_report(a, b, "p_partkey", "p_brand")


@query("x8_multi_valued", "WITH r AS (SELECT n_regionkey, unnest(list(n_nationkey) || [99]) AS k FROM nation GROUP BY 1), c AS (SELECT n_nationkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT n_regionkey, r.k FROM r LEFT JOIN c USING (k) WHERE coalesce(n, 0) <> 1")
def x8(spark, d):
    n = ad.table(spark, d, "nation")
    refs = n.groupBy("n_regionkey").agg(F.concat(F.collect_list("n_nationkey"), F.array(F.lit(99))).alias("ks")).select("n_regionkey", F.explode("ks").alias("k"))
    known = n.groupBy(F.col("n_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return refs.join(known, "k", "left").where(F.coalesce("n", F.lit(0)) != 1).select("n_regionkey", "k")


@query("e13_histograms", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def e13(spark, d):
    return ad.table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("e15_failure_cap", "SELECT n_regionkey, avg(CAST(c_acctbal < 0 AS DOUBLE)) AS failures, avg(CAST(c_acctbal < 0 AS DOUBLE)) <= 0.1 AS within FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", "failures")
def e15(spark, d):
    j = ad.table(spark, d, "customer").join(F.broadcast(ad.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rate = F.avg((F.col("c_acctbal") < 0).cast("double"))
    return j.groupBy("n_regionkey").agg(rate.alias("failures"), (rate <= 0.1).alias("within"))


@query("e16_latency", "WITH m AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, median(m) AS median_of_medians, quantile_cont(m, 0.95) AS p95 FROM m GROUP BY 1", "median_of_medians p95")
def e16(spark, d):
    m = ad.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.percentile("value", 0.5).alias("m"))
    return stats.quantiles(m, "m", {"median_of_medians": 0.5, "p95": 0.95}, ["event_type"])


@query("e20_cost_projection", "SELECT event_type, count(*) AS n, avg(value) * 1000000 AS projected FROM events GROUP BY 1", "projected")
def e20(spark, d):
    return ad.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") * 1000000).alias("projected"))


@query("a12_nested_annotations", "WITH n AS (SELECT conv_id, list(struct_pack(t := turn, r := role) ORDER BY turn, role) AS ts FROM conversations GROUP BY 1) SELECT conv_id, x.t AS turn, x.r AS role FROM (SELECT conv_id, unnest(ts) AS x FROM n) WHERE x.r = 'assistant'")
def a12(spark, d):
    """Nested records, exploded."""
    n = ad.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    return n.select("conv_id", F.explode("ts").alias("x")).where("x.role = 'assistant'").select("conv_id", "x.turn", "x.role")


@query("a16_filtered_corpus", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality > 0")
def a16(spark, d):
    docs = ad.table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return ad.table(spark, d, "labels").where("quality > 0").join(docs, "doc_id", "left_semi").select("doc_id", "quality")


# ------------------------------------------------------------ telemetry
@query("s_telemetry_gaps", "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS samples, count(CASE WHEN gap > 3600 THEN 1 END) AS gaps, max(gap) AS longest FROM g GROUP BY 1", "longest")
def s1(spark, d):
    return streaming.telemetry_gaps(ad.table(spark, d, "events"), 3600)


@query("s_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "total")
def s2(spark, d):
    return streaming.windowed_counts(ad.table(spark, d, "events"))
