"""Ranking metrics of each query, from long score tables.

Only the ten best rows of a ranking are needed: they come from a row-number
filter (limited sorts), and one aggregate of them gives every metric. What does
not depend on the ranking (positives, ideal gain) is aggregated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import discount, gain, ratio
from .ranking import by_score, rank_of

K = 10


def ideal_binary(positives, k: int = K) -> Column:
    """Ideal DCG of ``positives`` binary labels."""
    n = F.least(positives, F.lit(k)).cast("int")
    terms = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i.cast("double") + 1.0))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def graded_ideals(df: DataFrame, keys, k: int = K) -> DataFrame:
    """(keys, positives, candidates, ideal): what a graded ranking of the rows at
    hand can reach."""
    r = df.withColumn("__r", F.row_number().over(by_score("relevance", keys)))
    return r.groupBy(*keys).agg(
        F.count_if(F.col("relevance") > 0).alias("positives"), F.count(F.lit(1)).alias("candidates"),
        F.sum(F.when(F.col("__r") <= k, gain("relevance") * discount("__r"))).alias("ideal"),
    )


def _of_top(top: DataFrame, keys, graded: bool) -> DataFrame:
    hit = F.col("relevance") > 0
    value = gain("relevance") if graded else F.when(hit, 1.0).otherwise(0.0)
    return top.groupBy(*keys).agg(
        F.sum(value * discount("rank")).alias("dcg"),
        F.count_if(hit & (F.col("rank") <= 1)).alias("hit1"), F.count_if(hit & (F.col("rank") <= 3)).alias("hit3"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr10"),
    )


def evaluate(df: DataFrame, score: str, keys=("query_id",)) -> DataFrame:
    """(keys, ndcg10, recall1, recall3, mrr10): graded gains, ideal and positives
    of the supplied rows; all 0 without positives."""
    keys = list(keys)
    top = df.select(*keys, "page_id", "relevance", score).withColumn("rank", rank_of(score, keys)).where(F.col("rank") <= K)
    out = _of_top(top, keys, graded=True).join(graded_ideals(df, keys), keys)
    return out.select(
        *keys, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg10"),
        ratio("hit1", "positives", 0.0).alias("recall1"), ratio("hit3", "positives", 0.0).alias("recall3"), "mrr10",
    )


def evaluate_against(df: DataFrame, score: str, totals: DataFrame, keys=("query_id",), k: int = K) -> DataFrame:
    """(keys, ndcg10, recall1, recall3, mrr10, candidates) with binary labels and
    ideal and recall from ``totals`` (query_id, relevant_total), which counts
    positives outside the pool too. Queries without a positive are left out."""
    keys = list(keys)
    hit = F.col("relevance") > 0
    top = df.select(*keys, "page_id", "relevance", score).withColumn("rank", rank_of(score, keys)).where(F.col("rank") <= k)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(hit).alias("relevant_in_candidates"))
    out = _of_top(top, keys, graded=False).join(size, keys).join(totals.where("relevant_total > 0").select("query_id", "relevant_total"), "query_id")
    return out.select(
        *keys, (F.col("dcg") / ideal_binary(F.col("relevant_total"), k)).alias("ndcg10"),
        (F.col("hit1") / F.col("relevant_total")).alias("recall1"), (F.col("hit3") / F.col("relevant_total")).alias("recall3"),
        "mrr10", "candidates", "relevant_total", "relevant_in_candidates",
    )


def to_documents(df: DataFrame, score: str, document: Column, keys=("query_id",)) -> DataFrame:
    """Max-pooled scores: (keys, page_id, relevance, score, winner), where page_id
    is the document and winner its first best page."""
    keys = list(keys)
    d = df.withColumn("document_id", document)
    best = d.groupBy(*keys, "document_id").agg(
        F.max(score).alias(score), F.max("relevance").alias("relevance"), F.min(F.struct((-F.col(score)).alias("s"), F.col("page_id").alias("p"))).alias("w"),
    )
    return best.select(*keys, F.col("document_id").alias("page_id"), "relevance", score, F.col("w.p").alias("winner"))


def mean_metrics(per_query: DataFrame, keys=()) -> DataFrame:
    names = ["ndcg10", "recall1", "recall3", "mrr10"]
    return per_query.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(n).alias(n) for n in names])


def query_metrics(raw: DataFrame, keys=("dataset", "query_id")) -> DataFrame:
    """The stage-1 against full metric table of each query, with the stage-1
    margin and the costs: two rankings over one partitioning."""
    keys = list(keys)
    d = raw.withColumn("r1", rank_of("stage1_score", keys)).withColumn("r2", rank_of("full_score", keys)).withColumn("ri", F.row_number().over(by_score("relevance", keys)))
    hit = F.col("relevance") > 0

    def dcg(r):
        return F.coalesce(F.sum(F.when(F.col(r) <= K, gain("relevance") * discount(r))), F.lit(0.0))

    def part(name, r):
        return [
            dcg(r).alias(f"dcg_{name}"), F.count_if(hit & (F.col(r) <= 1)).alias(f"hit1_{name}"), F.count_if(hit & (F.col(r) <= 3)).alias(f"hit3_{name}"),
            F.coalesce(1.0 / F.min(F.when(hit & (F.col(r) <= K), F.col(r))), F.lit(0.0)).alias(f"mrr10_{name}"),
        ]

    first, second = (F.max(F.when(F.col("r1") == i, F.col("stage1_score"))) for i in (1, 2))
    costs = [F.first(c).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in ("stage2_ms", "stage2_flops")]
    g = d.groupBy(*keys).agg(
        F.first("source").alias("source"), F.count_if(hit).alias("relevant_count"), dcg("ri").alias("ideal"),
        *part("stage1", "r1"), *part("full", "r2"), F.coalesce(first - second, F.lit(0.0)).alias("stage1_margin"), *costs,
    )
    out = [F.when(F.col("ideal") > 0, F.col(f"dcg_{n}") / F.col("ideal")).otherwise(0.0).alias(f"ndcg_{n}") for n in ("stage1", "full")]
    out += [ratio(f"hit{i}_{n}", "relevant_count", 0.0).alias(f"recall{i}_{n}") for i in (1, 3) for n in ("stage1", "full")]
    return g.select(*keys, "source", "relevant_count", *out, "mrr10_stage1", "mrr10_full", "stage1_margin", "stage2_ms", "stage2_flops")
