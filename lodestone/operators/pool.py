"""Candidate pools, their expansion and their coverage of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import document_of, ratio
from .contracts import CHANNELS, label_free
from .fusion import rrf_of_ranks
from .ranking import channel_top_lists, with_ranks

DEPTHS = {"initial": (200, 100, 100), "final": (300, 200, 200)}


def union_pool(df: DataFrame, k: int, channels=CHANNELS, keys=("query_id",)) -> DataFrame:
    """(keys, page_id): union of the k best pages of every channel."""
    return channel_top_lists(df, k, channels, list(keys)).select(*keys, "page_id").distinct()


def pool_rows(df: DataFrame, k: int, channels=CHANNELS, keys=("query_id",)) -> DataFrame:
    """The score rows of the union pool: one window a channel over the same
    keys, so one exchange, and no join back."""
    label_free(df)
    ranked = with_ranks(df, channels, list(keys))
    names = [c.removesuffix("_score") + "_rank" for c in channels]
    keep = F.least(*[F.col(n) for n in names]) <= k
    return ranked.where(keep).drop(*names)


def depth_mask(depths: tuple[int, int, int]) -> Column:
    """Within the depth of the stage-1, BM25 or dense branch."""
    stage1, bm25, dense = depths
    return (F.col("stage1_rank") <= stage1) | (F.col("bm25_rank") <= bm25) | (F.col("dense_rank") <= dense)


def masked(raw: DataFrame, keys=("dataset", "query_id")) -> DataFrame:
    """``raw`` with the four branch ranks and both depth masks, in one pass."""
    ranked = with_ranks(raw, ["bm25_score", "dense_score", "stage1_score", "visual_score"], list(keys))
    return ranked.withColumns({k: depth_mask(d) for k, d in DEPTHS.items()})


def coverage(df: DataFrame, selected: str) -> Column:
    """Share of the positives that are selected; 1 without positives."""
    positive = F.col("relevance") > 0
    return F.coalesce(F.try_divide(F.count_if(positive & F.col(selected)), F.count_if(positive)), F.lit(1.0))


def coverage_audit(masks: DataFrame, least: float = 0.95, keys=("dataset", "query_id")) -> DataFrame:
    """Positives and coverage of each query under both depths, and its status."""
    positive = F.col("relevance") > 0
    out = masks.groupBy(*keys).agg(
        F.count_if(positive).alias("relevant_total"),
        F.count_if(positive & F.col("initial")).alias("relevant_initial"),
        F.count_if(positive & F.col("final")).alias("relevant_final"),
    )
    out = out.withColumn("coverage_initial", ratio("relevant_initial", "relevant_total")).withColumn("coverage_final", ratio("relevant_final", "relevant_total"))
    status = F.when(F.col("relevant_total") == 0, "missing_or_empty_qrels").when(F.col("coverage_final") >= least, "ok").otherwise("candidate_coverage_below_gate")
    return out.withColumn("status", status)


class CoverageError(RuntimeError):
    """Coverage stays too low after the one expansion; carries the audit."""

    def __init__(self, message: str, audit: DataFrame):
        super().__init__(message)
        self.audit = audit


def choose_pool(raw: DataFrame, least: float = 0.95) -> tuple[DataFrame, str]:
    """The rows of the initial depths, or of the larger ones if the initial
    coverage is below ``least``; one aggregate decides."""
    masks = masked(raw)
    got = masks.agg(coverage(masks, "initial").alias("initial"), coverage(masks, "final").alias("final")).first()
    depth = "initial" if got["initial"] >= least else "final"
    if got[depth] < least:
        raise CoverageError(f"coverage {got[depth]:.4f} is below {least}", coverage_audit(masks, least))
    return masks.where(depth), depth


def pool_coverage(pool: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, relevant_total, relevant_in_candidates, coverage) for every
    query, those with an empty pool included. coverage is null without positives."""
    wanted = qrels.where("relevance > 0").select("query_id", "page_id").distinct()
    hit = wanted.join(pool.select("query_id", "page_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "page_id"], "left")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_total"), F.count("hit").alias("relevant_in_candidates"))
    if queries is not None:
        per = queries.select("query_id").join(per, "query_id", "left").na.fill(0)
    return per.withColumn("coverage", ratio("relevant_in_candidates", "relevant_total"))


def coverage_by_role(per_query: DataFrame, roles: DataFrame, least: float = 0.95) -> DataFrame:
    """Macro coverage of every role and of all (role null), and PASS or BLOCKED."""
    d = per_query.join(roles, "query_id")
    out = d.rollup("role").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("coverage").alias("macro_coverage"), F.count_if(F.col("coverage") < 1).alias("uncovered"),
    )
    return out.withColumn("status", F.when(F.coalesce("macro_coverage", F.lit(1.0)) >= least, "PASS").otherwise("BLOCKED"))


def rescued(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, state): rescued or still_uncovered, for queries that were not
    wholly covered before."""
    b = before.select("query_id", F.col("coverage").alias("b"))
    a = after.select("query_id", F.col("coverage").alias("a"))
    return b.join(a, "query_id").where("b < 1").select("query_id", F.when(F.col("a") >= 1, "rescued").otherwise("still_uncovered").alias("state"))


def _fused(scores: DataFrame, k: int) -> DataFrame:
    """``scores`` with the channels' ranks, their reciprocal-rank fusion, from the
    same ranks, and the page's document."""
    ranked = with_ranks(label_free(scores), CHANNELS)
    return ranked.withColumn("rrf_score", rrf_of_ranks(CHANNELS, k)).withColumn("document_id", document_of("page_id"))


def _first() -> Column:
    """The best page's fusion, negative, and its document; first id among equals."""
    return F.min(F.struct((-F.col("rrf_score")).alias("less"), "document_id"))


def top_document(scores: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, document_id, document_rrf): the document whose best page has
    the highest reciprocal-rank fusion over the whole corpus, first id among equals."""
    best = _fused(scores, k).groupBy("query_id").agg(_first().alias("best"))
    return best.select("query_id", "best.document_id", (-F.col("best.less")).alias("document_rrf"))


def expand_top_document(scores: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, page_id, document_id, priority, rrf_score): pages of the top
    document that the union pool lacks, best first, up to 3k pages a query."""
    w = Window.partitionBy("query_id")
    ranked = _fused(scores, rrf_k).withColumn("base", F.least("bm25_rank", "dense_rank", "visual_rank") <= k)
    ranked = ranked.withColumns({"base_count": F.count_if("base").over(w), "top": _first().over(w)["document_id"]})
    missing = ranked.where("document_id = top AND NOT base")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "page_id")
    missing = missing.withColumn("priority", F.row_number().over(order)).where(F.col("priority") <= 3 * k - F.col("base_count"))
    return missing.select("query_id", "page_id", "document_id", "priority", "rrf_score")


def union_identity(top_lists: DataFrame, expansion: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidates missing from, and beyond, the union of both lists."""
    key = ["query_id", "page_id"]
    union = top_lists.select(key).unionByName(expansion.select(key)).distinct()
    both = union.withColumn("u", F.lit(1)).join(candidates.select(key).distinct().withColumn("c", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("c").isNull()).alias("not_candidates"), F.count_if(F.col("u").isNull()).alias("unexplained"))
