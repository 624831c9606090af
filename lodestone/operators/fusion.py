"""Fusion of channels into one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot3, softmax3
from .contracts import CHANNELS
from .normalize import zscore_of
from .ranking import rank_of

THIRD = 1.0 / 3.0
#: Weights of the fixed linear methods over (bm25, dense, visual).
FIXED = {
    "bm25": (1.0, 0.0, 0.0),
    "dense": (0.0, 1.0, 0.0),
    "visual": (0.0, 0.0, 1.0),
    "drop_bm25": (0.0, 0.5, 0.5),
    "drop_dense": (0.5, 0.0, 0.5),
    "drop_visual": (0.5, 0.5, 0.0),
}


def uniform() -> Column:
    a, b, c = (F.col(x) for x in CHANNELS)
    return (a + b + c) / 3.0


def weighted(weights) -> Column:
    return dot3(*CHANNELS, weights)


def rrf_of(channels, keys, k: int = 60) -> Column:
    """Reciprocal-rank fusion over the rows at hand, channels in this order."""
    parts = [1.0 / (k + rank_of(c, keys)) for c in channels]
    return sum(parts[1:], parts[0])


def rrf_of_ranks(channels, k: int = 60) -> Column:
    """``rrf_of`` where the rows have their ``<channel>_rank`` already."""
    parts = [1.0 / (k + F.col(c.removesuffix("_score") + "_rank")) for c in channels]
    return sum(parts[1:], parts[0])


def rrf_from_ranks(branch_ranks: str, branches=("bm25", "dense", "visual"), k: int = 60) -> Column:
    ranks = F.from_json(branch_ranks, "bm25 INT, dense INT, stage1 INT, visual INT")
    parts = [1.0 / (k + ranks[b]) for b in branches]
    return sum(parts[1:], parts[0])


def fixed_methods(raw: DataFrame, normalized: DataFrame, keys=("query_id",)) -> DataFrame:
    """(keys, page_id, method, score) of the fixed roster: single channels, drop
    one, uniform, uniform of z-scores, and RRF on raw scores."""
    keys = list(keys)
    z = [zscore_of(c, keys) for c in CHANNELS]
    own = raw.select(*keys, "page_id", rrf_of(CHANNELS, keys).alias("rrf"), ((z[0] + z[1] + z[2]) / 3.0).alias("uniform_z"))
    linear = {name: weighted(w) for name, w in FIXED.items()} | {"uniform": uniform()}
    wide = normalized.select(*keys, "page_id", *[c.alias(n) for n, c in linear.items()]).join(own, [*keys, "page_id"])
    return wide.unpivot([*keys, "page_id"], [*linear, "rrf", "uniform_z"], "method", "score")


def gated(logits: list[Column], temperature: float = 1.0) -> Column:
    """Scores weighted by a softmax gate."""
    return dot3(*CHANNELS, softmax3(*logits, temperature=temperature))


def co_strongest(df: DataFrame, value: str, tol: float = 1e-12) -> DataFrame:
    """Rows (methods) whose value is within ``tol`` of the best."""
    best = df.agg(F.max(value).alias("__best"))
    return df.crossJoin(best).where(F.col("__best") - F.col(value) <= tol).drop("__best")
