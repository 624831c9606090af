"""Score normalization inside each query. Labels are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import CHANNELS, label_free

EPSILON = 1e-15


def minmax_of(score: str, keys, eps: float = EPSILON) -> Column:
    """(x - min) / (max - min) over the query; 0 where the range is within
    ``eps`` (0: only where all are equal). An infinite range is scaled first."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    x, span = F.col(score), high - low
    big = F.greatest(F.abs(low), F.abs(high))
    scaled = (x / big - low / big) / (high / big - low / big)
    flat = (span <= eps) if eps else (high == low)
    return F.when(flat, 0.0).when(span == F.lit(float("inf")), scaled).otherwise((x - low) / span)


def minmax(df: DataFrame, scores=CHANNELS, keys=("query_id",), eps: float = EPSILON) -> DataFrame:
    return label_free(df).withColumns({s: minmax_of(s, keys, eps) for s in scores})


def zscore_of(score: str, keys) -> Column:
    w = Window.partitionBy(*keys)
    deviation = F.stddev_pop(score).over(w)
    return F.when(deviation == 0, 0.0).otherwise((F.col(score) - F.avg(score).over(w)) / deviation)


def zscore(df: DataFrame, scores=CHANNELS, keys=("query_id",)) -> DataFrame:
    return label_free(df).withColumns({s: zscore_of(s, keys) for s in scores})


def replayed(raw: DataFrame, normalized: DataFrame, scores=CHANNELS, keys=("query_id",), tol: float = 1e-12) -> DataFrame:
    """Rows whose stored normalized scores differ from a new normalization."""
    fresh = minmax(raw.select(*keys, "page_id", *scores), scores, keys).withColumnsRenamed({s: f"fresh_{s}" for s in scores})
    both = normalized.join(fresh, [*keys, "page_id"], "full")
    off = [F.coalesce(F.abs(F.col(s) - F.col(f"fresh_{s}")) > tol, F.lit(True)) for s in scores]
    bad = off[0]
    for x in off[1:]:
        bad = bad | x
    return both.where(bad)
