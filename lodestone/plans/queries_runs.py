"""Queries of whole runs: training, resumable searches, replays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, gate, oracle, sampling, training
from ..sources.clustered import apply_clustered, write_clustered
from ..sources.matrices import read_matrices, write_matrices
from ..sources.scratch import folder

from . import adapters as ad
from . import sharded
from .queries_core import METRICS, _EVAL, _UNI
from .queries_search import _ROWS
from .registry import query

SETTINGS = training.Settings()


def split_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with labels and the role of their query."""
    rows = ad.with_labels(gate.features(ad.candidates(spark, d)), ad.qrels(spark, d))
    return rows.join(sampling.ratio_split(ad.query_list(spark, d), "query_id", "gate", "2026"), "query_id")


@query("q7_o6_stochastic_gate", None, "value")
def q7(spark, d):
    """The page gate of the best epoch: Adam over seeded batches of the training
    queries, chosen on the validation queries. Checked against NumPy in the tests."""
    rows = training.records(split_features(spark, d).where("role <> 'test'"), SETTINGS, ["role"]).persist(StorageLevel.DISK_ONLY)
    try:
        best = training.fit(rows.where("role = 'train'"), rows.where("role = 'validation'"), SETTINGS).best
    finally:
        rows.unpersist()
    return spark.createDataFrame([(best["epoch"], best["ndcg10"], i, v) for i, v in enumerate(best["parameters"])], "epoch int, ndcg10 double, parameter int, value double")


@query("m10_x19_sharded_search", f"{_ROWS} SELECT query_id, global_profile, global_ndcg10, query_profile, query_ndcg10 FROM o", "global_ndcg10 query_ndcg10")
def m10(spark, d):
    """The search over shards of queries, each entered in a chained log."""
    run = sharded.ShardedSearch(ad.labelled(spark, d), oracle.W7, folder(spark, "search"))
    return run.run().select("query_id", "global_profile", "global_ndcg10", "query_profile", "query_ndcg10")


_FRAME = "query_id string, ndcg10 double, recall1 double, recall3 double, mrr10 double"


def frame_metrics(frame: pa.Table) -> pa.Table:
    """The graded metrics of one query's frame, whose pages must ascend."""
    pages, relevance, score = (frame.column(c).to_numpy() for c in ("page_id", "relevance", "score"))
    if (pages[1:] <= pages[:-1]).any():
        raise ValueError(f"pages of {frame.column('query_id')[0].as_py()} do not ascend")
    n, weight = len(pages), 1 / np.log2(np.arange(2, 12))
    if not n:
        return pa.table({c.split()[0]: pa.array([], pa.string() if i == 0 else pa.float64()) for i, c in enumerate(_FRAME.split(", "))})
    gain, order = np.exp2(relevance) - 1, np.argsort(-score, kind="stable")
    ideal, hits = (np.sort(gain)[::-1][:10] * weight[:n]).sum(), relevance[order] > 0
    first = np.flatnonzero(hits[:10])
    share = lambda k: hits[:k].sum() / hits.sum() if hits.any() else 0.0
    row = [(gain[order][:10] * weight[:n]).sum() / ideal if ideal else 0.0, share(1), share(3), 1 / (first[0] + 1) if len(first) else 0.0]
    return pa.table({"query_id": [frame.column("query_id")[0].as_py()]} | {c: [float(v)] for c, v in zip(("ndcg10", "recall1", "recall3", "mrr10"), row)})


@query("a6_a8_streamed_frames", _EVAL(_UNI), METRICS)
def a6(spark, d):
    """Whole queries from files ordered by query, without a shuffle
    of their rows."""
    rows = ad.labelled(spark, d).withColumn("score", fusion.uniform()).select("query_id", "page_id", "relevance", "score")
    ordered = write_clustered(rows, folder(spark, "ordered"), "query_id", "page_id")
    return apply_clustered(ordered, "query_id", frame_metrics, _FRAME)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("a22_b10_score_matrices", f"""WITH n AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT unnest({_SEGMENTS!r}) AS page_id),
  c AS (SELECT c_nationkey AS k, c_mktsegment AS page_id, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY 1, 2)
  SELECT CAST(n.k AS VARCHAR) AS query_id, s.page_id, ch.channel, coalesce(CASE WHEN channel = 'count' THEN CAST(c.n AS DOUBLE) ELSE CAST(most AS DOUBLE) END, 0.0) AS score
  FROM n CROSS JOIN s CROSS JOIN (SELECT unnest(['count', 'most']) AS channel) ch LEFT JOIN c ON c.k = n.k AND c.page_id = s.page_id""", "score")
def a22(spark, d):
    """Written as array files with receipts and read back: nations by market
    segments, two channels."""
    c = ad.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("query_id"))
    wide = c.pivot("c_mktsegment", _SEGMENTS).agg(F.count(F.lit(1)).cast("double").alias("count"), F.max("c_acctbal").cast("double").alias("most")).na.fill(0.0)
    cell = [F.struct(F.lit(s).alias("page_id"), F.lit(m).alias("channel"), F.col(f"{s}_{m}").alias("score")) for s in _SEGMENTS for m in ("count", "most")]
    rows = wide.select("query_id", F.explode(F.array(*cell)).alias("c")).select("query_id", "c.*")
    at = folder(spark, "matrices")
    write_matrices(rows, at, _SEGMENTS, "customers")
    return read_matrices(spark, at, identity="customers")
