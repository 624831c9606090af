"""Weight searches over a profile grid: one profile for all queries, one for each
query, and the closed form for each page.

Candidate rows are shuffled once by query and scored under all profiles where
they lie, in page order, a task keeping the ten best of the query at hand; the
metrics table of (query, profile) is what the searches read. Metric
comparison has a tolerance, which makes it order-dependent: profiles are folded
in grid order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.scalars import ratio
from .contracts import CHANNELS
from .fusion import THIRD
from .metrics import _of_top, ideal_binary
from .ranking import rank_of

TOLERANCE = 1e-12
#: The seven hand-picked profiles, in order.
W7 = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5), (THIRD, THIRD, THIRD))


def simplex(divisions: int) -> tuple[tuple[float, float, float], ...]:
    """All weight triples with the given denominator, first weight slowest."""
    return tuple((a / divisions, b / divisions, (divisions - a - b) / divisions) for a in range(divisions + 1) for b in range(divisions + 1 - a))


def grid(name: str) -> tuple[tuple[float, float, float], ...]:
    if name == "w7":
        return W7
    if name.startswith("w66"):
        return simplex(10)
    raise ValueError(f"unknown grid {name}")


def checked(weights) -> tuple[tuple[float, float, float], ...]:
    """Weights on the simplex, each once."""
    out = tuple(tuple(float(x) for x in w) for w in weights)
    if not out or len(set(out)) != len(out) or any(len(w) != 3 or min(w) < 0 or abs(sum(w) - 1) > 1e-9 for w in out):
        raise ValueError("weights must be distinct triples on the simplex")
    return out


def grid_table(spark: SparkSession, profiles) -> DataFrame:
    rows = [(i, *w) for i, w in enumerate(profiles)]
    return spark.createDataFrame(rows, "profile int, w_bm25 double, w_dense double, w_visual double")


def profile_scores(df: DataFrame, profiles, keys=("query_id",)) -> DataFrame:
    """(keys, page_id, relevance, profile, score): the rows under each profile."""
    profiles = checked(profiles)
    a, b, c = (F.col(x) for x in CHANNELS)
    scores = F.array(*[F.lit(w[0]) * a + F.lit(w[1]) * b + F.lit(w[2]) * c for w in profiles])
    return df.select(*keys, "page_id", "relevance", F.posexplode(scores).alias("profile", "score"))


def _best_ten(score: np.ndarray) -> np.ndarray:
    """Places of the ten largest of each row, the first among equals."""
    n = min(K, score.shape[1])
    if not np.isfinite(score).all():  # NaN is the largest
        return np.lexsort((-score, ~np.isnan(score)), axis=1)[:, :n]
    left, rows, out = score.copy(), np.arange(len(score)), np.empty((len(score), n), int)
    for i in range(n):
        out[:, i] = left.argmax(1)
        left[rows, out[:, i]] = -np.inf
    return out


class _Rankings:
    """The ten best rows of one query under each profile so far, and what its
    labels allow, from runs of its rows in page order."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.positives = weights, 0
        self.score, self.label, self.most = np.zeros((len(weights), 0)), np.zeros((len(weights), 0)), np.zeros(0)

    def add(self, channels: np.ndarray, label: np.ndarray, lacking: np.ndarray) -> None:
        (a, b, c), w = channels, self.weights
        with np.errstate(invalid="ignore"):
            score = np.where(lacking > 0, -np.inf, w[:, :1] * a + w[:, 1:2] * b + w[:, 2:] * c)
        score, labels = np.concatenate([self.score, score], 1), np.concatenate([self.label, np.broadcast_to(label, score.shape)], 1)
        best = _best_ten(score)
        self.score, self.label = np.take_along_axis(score, best, 1), np.take_along_axis(labels, best, 1)
        self.positives += int((label > 0).sum())
        self.most = -np.sort(-np.concatenate([self.most, label]))[:K]

    def metrics(self) -> list[np.ndarray]:
        hit = self.label > 0
        gain = lambda x: np.exp2(x) - 1.0
        ideal, dcg = (gain(self.most) * _DISCOUNT[: len(self.most)]).sum(), (gain(self.label) * _DISCOUNT[: hit.shape[1]]).sum(1)
        share = lambda k: hit[:, :k].sum(1) / self.positives if self.positives else np.zeros(len(hit))
        return [dcg / ideal if ideal > 0 else np.zeros(len(dcg)), share(1), share(3), np.where(hit.any(1), 1.0 / (hit.argmax(1) + 1), 0.0)]


K = 10
_DISCOUNT = 1.0 / (np.log(np.arange(1, K + 1) + 1.0) / np.log(2.0))


def profile_metrics(df: DataFrame, profiles, keys=("query_id",)) -> DataFrame:
    """(keys, profile, ndcg10, recall1, recall3, mrr10), graded, pool ideals.

    Rows are shuffled once by their keys and come in page order; a task keeps the
    ten best rows of the query at hand under every profile. A row under a profile
    is never a row of a table. Rows without a label count as 0, those without a
    score come last.
    """
    keys, weights = list(keys), np.array(checked(profiles))
    d = df.select(
        *keys, "page_id", F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)).alias("relevance"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CHANNELS],
        F.greatest(*[F.col(c).isNull().cast("double") for c in CHANNELS]).alias("lacking"),
    )
    schema = StructType([d.schema[k] for k in keys] + [StructField("profile", IntegerType(), False)] + [StructField(n, DoubleType()) for n in ("ndcg10", "recall1", "recall3", "mrr10")])

    def run(batches):
        held, last = None, None

        def leave(done):
            found = [np.concatenate(x) for x in zip(*[r.metrics() for _, r in done])]
            owner = pa.array(np.repeat(np.arange(len(done)), len(weights)))
            ids = [pa.concat_arrays([k[i] for k, _ in done]).take(owner) for i in range(len(keys))]
            number = pa.array(np.tile(np.arange(len(weights), dtype=np.int32), len(done)))
            return pa.RecordBatch.from_arrays([*ids, number, *map(pa.array, found)], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([pc.fill_null(b.column(i).dictionary_encode().indices, -1).to_numpy() for i in range(len(keys))])
            edges = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            values, done = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in (*CHANNELS, "relevance", "lacking")]), []
            for low, high in zip(edges, edges[1:]):
                own = [b.column(i).slice(low, 1) for i in range(len(keys))]
                if held is None or any(x.to_pylist() != y.to_pylist() for x, y in zip(own, last)):
                    if held is not None:
                        done.append((last, held))
                    held, last = _Rankings(weights), own
                held.add(values[:3, low:high], *values[3:, low:high])
            if done:
                yield leave(done)
        if held is not None:
            yield leave([(last, held)])

    return d.repartition(*keys).sortWithinPartitions(*keys, "page_id").mapInArrow(run, schema)


def _better(x: Column, y: Column, names) -> Column:
    """x beats y in lexicographic comparison with tolerance."""
    out = F.lit(False)
    for n in reversed(names):
        out = F.when(x[n] > y[n] + TOLERANCE, True).when(x[n] < y[n] - TOLERANCE, False).otherwise(out)
    return out


NAMES = ("ndcg10", "recall3", "mrr10")
_FIELDS = ["profile", "ndcg10", "recall1", "recall3", "mrr10"]


def _in_grid_order(metrics: DataFrame, keys) -> DataFrame:
    """(keys, rows): the metrics of all profiles of a key, in grid order."""
    return metrics.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("rows"))


def _fold(names=NAMES) -> Column:
    """The best element of ``rows``: each is compared with the best before it."""
    return F.aggregate(F.slice("rows", 2, F.size("rows")), F.col("rows")[0], lambda best, x: F.when(_better(x, best, names), x).otherwise(best))


def best_profile(metrics: DataFrame, keys, names=NAMES) -> DataFrame:
    """The best profile of each key, folded in grid order."""
    return _in_grid_order(metrics, keys).select(*keys, _fold(names).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in _FIELDS])


def global_means(metrics: DataFrame) -> DataFrame:
    names = ["ndcg10", "recall1", "recall3", "mrr10"]
    return metrics.groupBy("profile").agg(*[F.avg(n).alias(n) for n in names])


def global_oracle(metrics: DataFrame) -> DataFrame:
    """One row: the profile that is best on average over all queries."""
    return best_profile(global_means(metrics), [])


def query_oracle(metrics: DataFrame, keys=("query_id",)) -> DataFrame:
    return best_profile(metrics, list(keys))


def page_oracle_binary(df: DataFrame, profiles, totals: DataFrame | None = None, keys=("query_id",)) -> DataFrame:
    """(keys, ndcg10): with binary labels the best assignment of profiles to pages
    gives positives their largest fused score and negatives their smallest."""
    keys = list(keys)
    a, b, c = (F.col(x) for x in CHANNELS)
    fused = [F.lit(w[0]) * a + F.lit(w[1]) * b + F.lit(w[2]) * c for w in checked(profiles)]
    hit = F.col("relevance") > 0
    d = df.withColumn("score", F.when(hit, F.greatest(*fused)).otherwise(F.least(*fused)))
    top = d.withColumn("rank", rank_of("score", keys)).where("rank <= 10")
    count = df.groupBy(*keys).agg(F.count_if(hit).alias("relevant_total")) if totals is None else totals
    out = _of_top(top, keys, graded=False).join(count.where("relevant_total > 0"), "query_id" if totals is not None else keys)
    return out.select(*keys, (F.col("dcg") / ideal_binary(F.col("relevant_total"))).alias("ndcg10"))


def fit_static(df: DataFrame, profiles, totals: DataFrame | None = None) -> DataFrame:
    """One row: the profile with the largest mean nDCG@10, the first within the
    tolerance of the maximum."""
    means = global_means(profile_metrics(df, profiles)).select("profile", "ndcg10")
    best = means.agg(F.max("ndcg10").alias("best"))
    return means.crossJoin(best).where(F.col("best") - F.col("ndcg10") <= TOLERANCE).agg(F.min("profile").alias("profile"), F.min_by("ndcg10", "profile").alias("ndcg10"))


def oracle_rows(df: DataFrame, profiles, keys=("query_id",), metrics: DataFrame | None = None) -> DataFrame:
    """(keys, global_profile, global_ndcg10, query_profile, query_ndcg10, delta)."""
    keys = list(keys)
    # both levels read the same arrays, so the metrics are computed once
    wide = _in_grid_order(profile_metrics(df, profiles, keys) if metrics is None else metrics, keys)
    chosen = global_oracle(wide.select(*keys, F.explode("rows").alias("r")).select("r.*")).select(F.col("profile").alias("global_profile"))
    d = wide.crossJoin(F.broadcast(chosen)).withColumn("q", _fold()).withColumn("g", F.filter("rows", lambda x: x["profile"] == F.col("global_profile"))[0])
    d = d.select(*keys, "global_profile", F.col("g.ndcg10").alias("global_ndcg10"), F.col("q.profile").alias("query_profile"), F.col("q.ndcg10").alias("query_ndcg10"))
    return d.withColumn("delta", F.col("query_ndcg10") - F.col("global_ndcg10"))


def gain_summary(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    """One row: mean gain, shares of queries with gains of 1, 3 and 5 points and
    the share of the largest 5 % of gains in all gains."""
    from .stats import top_share

    d = F.col(delta)
    base = deltas.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(d).alias("mean_delta"), F.avg((d >= 0.01).cast("double")).alias("gain_ge_001"),
        F.avg((d >= 0.03).cast("double")).alias("gain_ge_003"), F.avg((d >= 0.05).cast("double")).alias("gain_ge_005"),
    )
    return base.crossJoin(top_share(deltas, delta))


def profile_usage(choices: DataFrame, size: int, profile: str = "query_profile") -> DataFrame:
    """(profile, queries) for every profile of the grid, unused ones with 0."""
    every = choices.sparkSession.range(size).select(F.col("id").cast("int").alias("profile"))
    used = choices.groupBy(F.col(profile).alias("profile")).agg(F.count(F.lit(1)).alias("queries"))
    return every.join(used, "profile", "left").na.fill(0, ["queries"])
