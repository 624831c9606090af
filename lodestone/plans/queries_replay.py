"""Extraction records over the table of pages, with planted breaks, replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay

from . import adapters as ad
from .registry import query

# eight pages a document; breaks by the page's number in the table
_SQL = """WITH t AS (SELECT page_id AS i, 'd' || CAST(page_id // 8 AS VARCHAR) AS document_id, page_id % 8 + 1 AS page_number, url, coalesce(html, '') AS native FROM pages),
  b AS (SELECT i, document_id, page_number, document_id || '_page_' || printf('%04d', page_number) AS page_id, sha256(document_id) AS src, native,
    CASE WHEN i % 41 = 7 THEN ['RENDERED', 'OCR_OK', 'RESOLVED'] WHEN i % 29 = 3 THEN ['RENDERED', 'NATIVE', 'OCR_TIMEOUT'] ELSE ['RENDERED', 'NATIVE', 'OCR_OK', 'RESOLVED'] END AS states,
    sha256(native) AS native_sha, CASE WHEN i % 29 = 3 THEN native ELSE upper(native) END AS good FROM t),
  r AS (SELECT *, CASE WHEN i % 37 = 5 THEN good || '!' ELSE good END AS text, sha256(CASE WHEN i % 37 = 5 AND i % 2 = 0 THEN good || '!' ELSE good END) AS text_sha FROM b),
  g AS (SELECT *, sha256(concat_ws(chr(31), page_id, src, array_to_string(states, ','), native_sha, text_sha)) AS digest FROM r),
  l AS (SELECT *, list(digest) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g),
  c AS (SELECT *, list_reduce(list_prepend(document_id, upto), lambda a, x: sha256(a || x)) AS good_chain FROM l),
  s AS (SELECT *, CASE WHEN i % 43 = 9 THEN 'broken' ELSE good_chain END AS chain FROM c),
  f AS (SELECT s.i, s.page_id, s.document_id, CASE WHEN s.i % 53 = 11 THEN 'missing' WHEN s.i % 47 = 13 THEN 'repeated' WHEN s.i % 59 = 17 THEN 'identity' WHEN s.i % 41 = 7 THEN 'states' WHEN s.i % 31 = 4 THEN 'failure'
      WHEN s.i % 37 = 5 AND s.i % 2 = 1 THEN 'text_hash' WHEN s.i % 37 = 5 THEN 'resolution'
      WHEN s.chain <> s.good_chain OR (p.i IS NOT NULL AND (p.i % 53 = 11 OR p.i % 43 = 9)) THEN 'chain' END AS fault
    FROM s LEFT JOIN s p ON p.document_id = s.document_id AND p.page_number = s.page_number - 1)
  SELECT page_id, document_id, fault FROM f UNION ALL SELECT page_id, document_id, fault FROM f WHERE fault = 'repeated'"""


def planted(spark, d):
    """The planned pages and their records."""
    i = F.col("i")
    t = ad.table(spark, d, "pages").select(F.col("page_id").alias("i"), F.concat(F.lit("d"), F.expr("string(page_id div 8)")).alias("document_id"), F.expr("page_id % 8 + 1").alias("page_number"), F.coalesce("html", F.lit("")).alias("native"))
    t = t.withColumn("page_id", replay.canonical_id()).withColumn("source_sha256", F.sha2("document_id", 256))
    states = F.when(i % 41 == 7, F.array(*map(F.lit, ("RENDERED", "OCR_OK", "RESOLVED")))).when(i % 29 == 3, F.array(*map(F.lit, ("RENDERED", "NATIVE", "OCR_TIMEOUT"))))
    t = t.withColumn("states", states.otherwise(F.array(*map(F.lit, ("RENDERED", "NATIVE", "OCR_OK", "RESOLVED")))))
    good = F.when(i % 29 == 3, F.col("native")).otherwise(F.upper("native"))
    t = t.withColumn("text", F.when(i % 37 == 5, F.concat(good, F.lit("!"))).otherwise(good)).withColumn("native_sha256", F.sha2("native", 256))
    t = t.withColumn("text_sha256", F.sha2(F.when((i % 37 == 5) & (i % 2 == 1), good).otherwise(F.col("text")), 256))
    digests = t.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", replay.record_digest().alias("digest")))).alias("all"))
    upto = F.filter("all", lambda x: x["page_number"] <= F.col("page_number"))
    chain = F.aggregate(upto, F.col("document_id"), lambda a, x: F.sha2(F.concat(a, x["digest"]), 256))
    t = t.join(digests, "document_id").withColumn("chain", F.when(i % 43 == 9, F.lit("broken")).otherwise(chain)).drop("all")
    r = t.withColumn("technical_failure", (i % 29 == 3) != (i % 31 == 4)).withColumn("reason", F.lit("as planned"))
    r = r.withColumn("source_sha256", F.when(i % 59 == 17, F.lit("other")).otherwise(F.col("source_sha256"))).where(i % 53 != 11)
    r = r.withColumn("again", F.explode(F.when(i % 47 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again", "i")
    return replay.schedule(t.select("page_id", "document_id", "page_number", "source_sha256"), "2026"), r


def resolved():
    return F.when(F.element_at("states", -1) == "RESOLVED", F.upper("native")).otherwise(F.col("native"))


@query("p10_record_replay", _SQL)
def p10(spark, d):
    """The first rule that each record breaks, among planted breaks."""
    planned, records = planted(spark, d)
    return replay.replay(planned, records, resolved()).drop("position")
