"""Retrieval tables derived from general tables, in Spark and in SQL.

Queries are suppliers, pages are parts (ten to a document), and channels are
aggregates of the lines that a supplier has of a part. Texts and vectors come
from the document and embedding tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, pool
from ..operators.contracts import CHANNELS

DEPTH = 50
SCORES = ["query_id", "page_id", *CHANNELS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a partition of the score table.
LINES = 250_000


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw score table of the study. Lines are dealt out by query, into more
    partitions the more there are: the pages of a query and their rankings need
    no further shuffle, and a task's share does not grow."""
    returned = F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem").withColumn("query_id", F.col("l_suppkey").cast("string"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    d = lines.repartition(parts, "query_id").groupBy("query_id", "l_suppkey", "l_partkey").agg(
        F.least(F.lit(3), F.count_if(returned & (F.col("l_discount") >= 0.09))).cast("double").alias("relevance"),
        F.sum("l_quantity").alias("bm25_score"), F.max("l_discount").alias("dense_score"), F.max("l_extendedprice").alias("visual_score"),
        (F.max("l_quantity") + 100.0 * F.max("l_tax")).alias("stage1_score"), (F.max("l_extendedprice") + 1000.0 * F.count_if(returned)).alias("full_score"),
    )
    return d.select(
        F.lit("tpch").alias("dataset"), "query_id",
        F.format_string("doc%05d_page_%04d", F.expr("l_partkey div 10"), F.expr("l_partkey % 10")).alias("page_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "chart").otherwise("table").alias("source"), "relevance", "bm25_score", "dense_score", "stage1_score", "visual_score", "full_score",
        (5.0 + F.col("l_suppkey") % 7).alias("stage2_ms"), (100.0 + F.col("l_suppkey") % 11).alias("stage2_flops"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-free rows of the three channels."""
    return raw(spark, sf_dir).select(*SCORES)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevant pages: those of the lines that count as such, and no other
    line is shuffled."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.09").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return lines.select(
        F.col("l_suppkey").cast("string").alias("query_id"), F.format_string("doc%05d_page_%04d", F.expr("l_partkey div 10"), F.expr("l_partkey % 10")).alias("page_id"),
        F.least(F.lit(3), "n").cast("double").alias("relevance"),
    )


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the relevance of their page, 0 where there is none."""
    return df.join(labels, ["query_id", "page_id"], "left").na.fill(0.0, ["relevance"])


def candidates(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    """Normalized label-free rows of the union pool."""
    return normalize.minmax(pool.pool_rows(scores(spark, sf_dir), k))


def labelled(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    return with_labels(candidates(spark, sf_dir, k), qrels(spark, sf_dir))


def query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("query_id"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of ten-page documents, with content and split."""
    d = table(spark, sf_dir, "documents")
    split = F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "train", "validation", "test", "shared")]), F.expr("cast(doc_id % 6 + 1 as int)"))
    return d.select(
        F.format_string("doc%06d_page_%04d", F.expr("doc_id div 10"), F.expr("doc_id % 10")).alias("page_id"), F.format_string("doc%06d", F.expr("doc_id div 10")).alias("document_id"),
        F.expr("cast(doc_id % 10 as int)").alias("page_number"), F.coalesce("text", F.lit("")).alias("content"), split.alias("split"), "source",
    )


# ------------------------------------------------------------------ SQL forms
RAW = """raw AS (
  SELECT 'tpch' AS dataset, CAST(l_suppkey AS VARCHAR) AS query_id, printf('doc%05d_page_%04d', l_partkey // 10, l_partkey % 10) AS page_id,
    CASE WHEN l_suppkey % 2 = 0 THEN 'chart' ELSE 'table' END AS source,
    CAST(least(3, count(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 END)) AS DOUBLE) AS relevance,
    sum(l_quantity) AS bm25_score, max(l_discount) AS dense_score, max(l_extendedprice) AS visual_score,
    max(l_quantity) + 100.0::DOUBLE * max(l_tax) AS stage1_score, max(l_extendedprice) + 1000.0::DOUBLE * count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS full_score,
    5.0::DOUBLE + l_suppkey % 7 AS stage2_ms, 100.0::DOUBLE + l_suppkey % 11 AS stage2_flops
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""
RANKED = (
    RAW
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, page_id) AS bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, page_id) AS dense_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY visual_score DESC, page_id) AS visual_rank, row_number() OVER (PARTITION BY query_id ORDER BY stage1_score DESC, page_id) AS stage1_rank
  FROM raw)"""
)


def minmax_sql(name: str) -> str:
    return f"CASE WHEN max({name}) OVER w - min({name}) OVER w <= 1e-15 THEN 0.0 ELSE ({name} - min({name}) OVER w) / (max({name}) OVER w - min({name}) OVER w) END"


POOL = RANKED + f", pool AS (SELECT * FROM ranked WHERE least(bm25_rank, dense_rank, visual_rank) <= {DEPTH})"
NORM = POOL + f""", norm AS (
  SELECT query_id, page_id, source, relevance, {", ".join(f"{minmax_sql(c)} AS {c}" for c in CHANNELS)} FROM pool WINDOW w AS (PARTITION BY query_id))"""
PAGES = """pages_t AS (
  SELECT printf('doc%06d_page_%04d', doc_id // 10, doc_id % 10) AS page_id, printf('doc%06d', doc_id // 10) AS document_id, CAST(doc_id % 10 AS INTEGER) AS page_number, coalesce(text, '') AS content,
    (['train', 'train', 'train', 'validation', 'test', 'shared'])[doc_id % 6 + 1] AS split, source FROM documents)"""


def evaluate_sql(src: str, score: str, keys: str = "query_id") -> str:
    """The graded metrics of a ranking by ``score``."""
    return f"""(SELECT {keys}, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg10, CASE WHEN pos > 0 THEN hit1 / pos ELSE 0.0 END AS recall1,
    CASE WHEN pos > 0 THEN hit3 / pos ELSE 0.0 END AS recall3, coalesce(1.0 / first, 0.0) AS mrr10 FROM (
      SELECT {keys}, CAST(count(CASE WHEN relevance > 0 THEN 1 END) AS DOUBLE) AS pos, sum(CASE WHEN r <= 10 THEN (pow(2.0, relevance) - 1) * (1.0 / log2(r + 1)) ELSE 0.0 END) AS dcg,
        sum(CASE WHEN ri <= 10 THEN (pow(2.0, relevance) - 1) * (1.0 / log2(ri + 1)) ELSE 0.0 END) AS ideal, count(CASE WHEN relevance > 0 AND r <= 1 THEN 1 END) AS hit1,
        count(CASE WHEN relevance > 0 AND r <= 3 THEN 1 END) AS hit3, CAST(min(CASE WHEN relevance > 0 AND r <= 10 THEN r END) AS DOUBLE) AS first
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, page_id) AS r, row_number() OVER (PARTITION BY {keys} ORDER BY relevance DESC, page_id) AS ri FROM {src})
      GROUP BY {keys}))"""


def binary_sql(src: str, score: str, totals: str, keys: str = "query_id") -> str:
    """The binary metrics of a ranking against all positives of a query."""
    return f"""(SELECT {keys}, dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) AS g(i) WHERE i <= relevant_total) AS ndcg10, hit1 / CAST(relevant_total AS DOUBLE) AS recall1,
    hit3 / CAST(relevant_total AS DOUBLE) AS recall3, coalesce(1.0 / first, 0.0) AS mrr10, candidates, relevant_total, relevant_in_candidates FROM (
      SELECT {keys}, count(*) AS candidates, count(CASE WHEN relevance > 0 THEN 1 END) AS relevant_in_candidates, sum(CASE WHEN r <= 10 AND relevance > 0 THEN 1.0 / log2(r + 1) ELSE 0.0 END) AS dcg,
        count(CASE WHEN relevance > 0 AND r <= 1 THEN 1 END) AS hit1, count(CASE WHEN relevance > 0 AND r <= 3 THEN 1 END) AS hit3, CAST(min(CASE WHEN relevance > 0 AND r <= 10 THEN r END) AS DOUBLE) AS first
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, page_id) AS r FROM {src}) GROUP BY {keys}) JOIN {totals} USING (query_id) WHERE relevant_total > 0)"""


def profiles_sql(profiles) -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(profiles))
    return f"grid(profile, wa, wb, wc) AS (VALUES {rows})"
