"""Queries of the remaining functions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, ranking
from . import adapters as ad
from .registry import query


@query("d2_top_list_join", f"WITH {ad.RANKED} SELECT CAST(sum(CASE WHEN bm25_rank <= 20 THEN 1 ELSE 0 END + CASE WHEN dense_rank <= 20 THEN 1 ELSE 0 END + CASE WHEN visual_rank <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS row_count, 0::BIGINT AS without_candidate, 0::BIGINT AS other_score FROM ranked")
def d2(spark, d):
    s = ad.scores(spark, d)
    return audit.top_list_join(ranking.channel_top_lists(s, 20), s)


@query("c19_probe_case", f"""WITH {ad.RAW}, p AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM raw),
  s AS (SELECT DISTINCT query_id, page_id FROM p, range(16) t(k) WHERE i = k * (n - 1) // 15), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS r FROM s)
  SELECT query_id, page_id, 0.0::DOUBLE AS stage1_score, CASE WHEN r IN (0, 8) THEN 1.0::DOUBLE ELSE 0.0 END AS relevance FROM r""")
def c19(spark, d):
    return audit.probe_case(ad.scores(spark, d), 16).select("query_id", "page_id", "stage1_score", "relevance")


@query("x4_record_limits", f"WITH {ad.RAW}, g AS (SELECT query_id, count(*) AS n, count(DISTINCT page_id) AS d FROM raw GROUP BY 1) SELECT count(*) AS queries, count(CASE WHEN n > 500 THEN 1 END) AS too_long, count(CASE WHEN n <> d THEN 1 END) AS repeated FROM g")
def x4(spark, d):
    return audit.record_limits(ad.scores(spark, d), 500)


@query("x17_schema_rows", "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name FROM (DESCRIBE nation)")
def x17(spark, d):
    return audit.schema_rows(ad.table(spark, d, "nation")).select("position", "name")


@query("p11_component_parity", "SELECT unnest(['scores', 'texts']) AS component, unnest([true, false]) AS equal")
def p11(spark, d):
    s, t = ad.scores(spark, d), ad.table(spark, d, "nation")
    return audit.component_parity({"scores": s, "texts": t}, {"scores": s.repartition(3), "texts": t.where("n_nationkey > 0")})


@query("i3_composed_text", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS t FROM documents")
def i3(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", text.composed("text").alias("t"))


#: Documents of a task that counts word edits.
EDITED = 2_000


@query("i4_word_errors", None, "rate")
def i4w(spark, d):
    """Word edits between neighbouring documents; brute force in the tests. They
    are dealt into more tasks the more there are, as edits take longer than reading."""
    t = ad.table(spark, d, "documents").select("doc_id", "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // EDITED))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")).repartition(parts, "doc_id")
    t = t.repartition(parts, "doc_id")
    return t.join(other, "doc_id").select("doc_id", text.word_error_rate("text", "other").alias("rate"))


@query("i24_boxes", """WITH b AS (SELECT l_linenumber AS r, l_orderkey AS k, l_quantity AS x FROM lineitem) SELECT k, r, CASE r % 4 WHEN 1 THEN [90 - 20 - x, 1 + 0 * x, 90 - 10 - x, 5 + x] WHEN 2 THEN [200 - 5 - x, 90 - 20 - x, 200 - 1 + 0 * x, 90 - 10 - x] WHEN 3 THEN [10 + x, 200 - 5 - x, 20 + x, 200 - 1 + 0 * x] ELSE [1 + 0 * x, 10 + x, 5 + x, 20 + x] END AS box FROM b""".replace("AS box FROM b", "AS box FROM b").replace("SELECT k, r, CASE", "SELECT k, r, array_to_string(list_transform(CASE").replace("END AS box", "END, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS box"))
def i24(spark, d):
    b = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("x"))
    box = F.array(F.lit(1.0), 10 + F.col("x"), 5 + F.col("x"), 20 + F.col("x"))
    turned = text.rotated_box(box, F.lit(200.0), F.lit(90.0), (F.col("r") % 4) * 90)
    return b.select("k", "r", F.array_join(F.transform(turned, lambda v: v.cast("long").cast("string")), ",").alias("box"))
