"""Table contracts: declared columns, and rules that are counted in one pass.

Label-free functions refuse tables that carry relevance, so labels cannot leak
into candidate building, normalization, features or scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite

KEY = ["dataset", "query_id"]
CHANNELS = ["bm25_score", "dense_score", "visual_score"]
BRANCHES = ["bm25", "dense", "stage1", "visual"]
LABELS = {"relevance", "label", "qrels", "relevant"}


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CONTRACTS = {
    "raw_scores": _schema("dataset:s query_id:s page_id:s source:s relevance:d bm25_score:d dense_score:d stage1_score:d visual_score:d full_score:d"),
    "retrieval_scores": _schema("dataset:s query_id:s page_id:s relevance:d bm25_score:d dense_score:d stage1_score:d visual_score:d branch_ranks:s source:s"),
    "query_metrics": _schema("dataset:s query_id:s source:s relevant_count:l ndcg_stage1:d ndcg_full:d recall_stage1:d recall_full:d stage1_margin:d stage2_ms:d stage2_flops:d"),
    "score_rows": _schema("query_id:s page_id:s bm25_score:d dense_score:d visual_score:d"),
    "candidate_set": _schema("query_id:s page_id:s"),
    "channel_top_lists": _schema("query_id:s page_id:s channel:s rank:i raw_score:d"),
    "expansion_log": _schema("query_id:s page_id:s document_id:s priority:i rrf_score:d reason:s"),
    "per_query_metrics": _schema("method:s query_id:s candidates:l relevant_total:l relevant_in_candidates:l ndcg_at_10:d recall_at_1:d recall_at_3:d mrr_at_10:d"),
    "page_manifest": _schema("page_id:s document_id:s page_number:i source_path:s file_sha256:s content_sha256:s split:s extraction_method:s review_status:s"),
}


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what}: missing columns {missing}")
    return df


def exact_columns(df: DataFrame, contract: str) -> DataFrame:
    """``df`` if its columns are those of the contract, in order."""
    want = CONTRACTS[contract].fieldNames()
    if df.columns != want:
        raise ContractError(f"{contract}: columns are {df.columns}, not {want}")
    return df


def label_free(df: DataFrame) -> DataFrame:
    held = LABELS & {c.lower() for c in df.columns}
    if held:
        raise ContractError(f"labels are not allowed here: {sorted(held)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule, the number of rows where it does not hold (a rule
    that is null does not hold)."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def numeric_rules(columns) -> dict[str, Column]:
    return {f"{c}_not_finite": finite(c) for c in columns}


def enforce(df: DataFrame, rules: dict[str, Column], what: str = "table") -> DataFrame:
    """``df``, or ContractError that names the broken rules. Runs one aggregate."""
    row = violations(df, rules).first().asDict()
    broken = {k: v for k, v in row.items() if v}
    if broken:
        raise ContractError(f"{what}: {broken}")
    return df


def id_rules(column: str) -> dict[str, Column]:
    c = F.col(column)
    return {f"{column}_clean": (c == F.trim(c)) & (c != "") & ~c.rlike("[\\r\\n\\t]")}


def key_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, surplus rows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("key_count"), F.sum(F.col("n") - 1).alias("surplus"))


def query_frame_report(df: DataFrame, pages: int | None = None) -> DataFrame:
    """Rows, distinct pages and non-finite scores of each query."""
    out = df.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("page_id").alias("page_count"),
        F.count_if(~(finite("bm25_score") & finite("dense_score") & finite("visual_score"))).alias("not_finite"),
    )
    good = (F.col("row_count") == F.col("page_count")) & (F.col("not_finite") == 0)
    return out.withColumn("ok", good & (F.col("row_count") == pages) if pages is not None else good)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows each side has beyond the other, as multisets."""
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return a.crossJoin(b)
