"""Streaming forms: telemetry gaps, windowed counts with late data, and score
rows whose touched queries are evaluated anew with each batch from their state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def telemetry_gaps(events: DataFrame, seconds: float, key: str = "user_id") -> DataFrame:
    """(key, samples, gaps, longest): intervals between samples above a limit."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    d = events.withColumn("gap", (at - F.lag(at).over(w)) / 1e6)
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("gap") > seconds).alias("gaps"), F.max("gap").alias("longest"))


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and sums a window and type; on a stream, state is kept no longer
    than ``lateness`` behind the newest event."""
    d = events.withWatermark("ts", lateness) if events.isStreaming else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours", key: str = "user_id") -> DataFrame:
    d = events.withWatermark("ts", lateness) if events.isStreaming else events
    return d.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_STATE = "score array<double>, page array<string>, relevance array<double>, ideal array<double>, positives long"
_METRICS = "query_id string, ndcg10 double, recall1 double, recall3 double, mrr10 double"
TOP = 10


def _update(score: str):
    """The metrics of a query after some more rows, from its ten best rows, its
    ten largest gains and the number of its positive pages."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, ideal, positives = [], [], 0
        if state.exists:
            scores, pages, relevance, ideal, positives = state.get
            best = list(zip([-s for s in scores], pages, relevance))
            ideal = list(ideal)
        for f in frames:
            r = f["relevance"].to_numpy(float)
            best = sorted(best + list(zip((-f[score]).tolist(), f["page_id"].tolist(), r.tolist())))[:TOP]
            ideal = sorted(ideal + (np.exp2(r) - 1).tolist(), reverse=True)[:TOP]
            positives += int((r > 0).sum())
        state.update(([-b[0] for b in best], [b[1] for b in best], [b[2] for b in best], ideal, positives))
        weight, hits = 1 / np.log2(np.arange(2, TOP + 2)), np.array([b[2] > 0 for b in best])
        most = float(np.dot(ideal, weight[: len(ideal)]))
        gain = float(np.dot(np.exp2([b[2] for b in best]) - 1, weight[: len(best)]))
        first = np.flatnonzero(hits)
        share = lambda k: float(hits[:k].sum() / positives) if positives else 0.0
        yield pd.DataFrame([(key[0], gain / most if most else 0.0, share(1), share(3), 1.0 / (first[0] + 1) if len(first) else 0.0)], columns=[c.split()[0] for c in _METRICS.split(", ")])

    return run


def evaluate_stream(rows: DataFrame, results: str, checkpoint: str, score: str = "score") -> StreamingQuery:
    """Write the metrics of the queries that each batch of score rows touches to
    ``results``, by batch, over all their rows so far. What a batch reads is
    itself and a bounded state a query."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{results}/part={number}")

    d = rows.select(F.col("query_id").cast("string").alias("query_id"), "page_id", F.col("relevance").cast("double").alias("relevance"), F.col(score).cast("double").alias(score))
    d = d.groupBy("query_id").applyInPandasWithState(_update(score), _METRICS, _STATE, "update", GroupStateTimeout.NoTimeout)
    return d.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
