"""Ranks, top lists and orderings.

One order holds everywhere: score descending, then page id ascending in
code-point order. Windows of one stage share their partition keys, so one
exchange serves all of them; top-k is a filter on the row number, which Spark
turns into limited sorts before and after the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .contracts import CHANNELS, label_free

QUERY = ["query_id"]


def by_score(score: str, keys=QUERY) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("page_id"))


def rank_of(score: str, keys=QUERY) -> Column:
    return F.row_number().over(by_score(score, keys))


def with_ranks(df: DataFrame, scores: list[str], keys=QUERY) -> DataFrame:
    """``df`` with ``<channel>_rank`` for each ``<channel>_score``."""
    return df.withColumns({s.removesuffix("_score") + "_rank": rank_of(s, keys) for s in scores})


def top(df: DataFrame, score: str, k: int, keys=QUERY, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, rank_of(score, keys)).where(F.col(rank) <= k)


def long_channels(df: DataFrame, channels=CHANNELS, keys=QUERY) -> DataFrame:
    """(keys, page_id, channel, raw_score), one row a channel."""
    out = df.unpivot([*keys, "page_id"], channels, "channel", "raw_score")
    return out.withColumn("channel", F.regexp_replace("channel", "_score$", ""))


def channel_top_lists(df: DataFrame, k: int, channels=CHANNELS, keys=QUERY) -> DataFrame:
    """The k best pages of every channel and query."""
    label_free(df)
    return top(long_channels(df, channels, keys), "raw_score", k, [*keys, "channel"]).select(*keys, "page_id", "channel", "rank", "raw_score")


def normalized_rank(score: str, keys=QUERY) -> Column:
    """1 for the best, 0 for the last; a single row has 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(n == 1, 1.0).otherwise(1.0 - (rank_of(score, keys) - 1) / (n - 1))


def reciprocal_rank(score: str, keys=QUERY) -> Column:
    return 1.0 / rank_of(score, keys)


def top_gap(df: DataFrame, score: str, out: str, keys=QUERY) -> DataFrame:
    """Difference of the two best scores of the query on each row; 0 for one row."""
    d = df.withColumn("__r", rank_of(score, keys))
    w = Window.partitionBy(*keys)
    gap = F.max(F.when(F.col("__r") == 1, F.col(score))).over(w) - F.max(F.when(F.col("__r") == 2, F.col(score))).over(w)
    return d.withColumn(out, F.coalesce(gap, F.lit(0.0))).drop("__r")


def margins(df: DataFrame, score: str, keys=QUERY) -> DataFrame:
    """(keys, margin): difference of the two best scores of each query."""
    d = top(df, score, 2, keys)
    gap = F.max(F.when(F.col("rank") == 1, F.col(score))) - F.max(F.when(F.col("rank") == 2, F.col(score)))
    return d.groupBy(*keys).agg(F.coalesce(gap, F.lit(0.0)).alias("margin"))


def median_margin(score: str, keys=QUERY) -> Column:
    return F.col(score) - F.median(score).over(Window.partitionBy(*keys))


def spread(*columns) -> Column:
    """Population standard deviation over the given columns of a row."""
    cs = [F.col(c) if isinstance(c, str) else c for c in columns]
    mean = sum(cs[1:], cs[0]) / len(cs)
    squares = [(c - mean) * (c - mean) for c in cs]
    return F.sqrt(sum(squares[1:], squares[0]) / len(cs))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ascending ranks in which ties share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def tolerant_rank(df: DataFrame, key: str, value: str, tol: float = 1e-12) -> DataFrame:
    """(key, value, rank): 1 + the number of rows that are better by more than
    ``tol``. The table is a method list, small by definition."""
    a, b = df.select(key, value).alias("a"), df.select(F.col(value).alias("other")).alias("b")
    better = F.count_if(F.col("other") - F.col(value) > tol)
    return a.crossJoin(b).groupBy(key, value).agg((better + 1).cast("long").alias("rank"))


def allocate(groups: DataFrame, size: str, total: int, keys: list[str]) -> DataFrame:
    """Largest-remainder shares of ``total`` by ``size``: adds exact, share."""
    w = Window.partitionBy(F.lit(0))
    d = groups.withColumn("exact", F.lit(float(total)) * F.col(size) / F.sum(size).over(w)).withColumn("base", F.floor("exact"))
    d = d.withColumn("left", F.lit(total) - F.sum("base").over(w))
    order = w.orderBy(F.desc(F.col("exact") - F.col("base")), *keys)
    return d.withColumn("share", (F.col("base") + (F.row_number().over(order) <= F.col("left")).cast("long"))).drop("base", "left")


def first_relevant(df: DataFrame, score: str, k: int = 10, keys=QUERY) -> DataFrame:
    """(keys, first_rank, top_page): rank of the first relevant page within k."""
    d = top(df, score, k, keys)
    return d.groupBy(*keys).agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first_rank"), F.min_by("page_id", "rank").alias("top_page"))


def hash_numbers(df: DataFrame, digest: Column, ties: list[str], out: str = "position", total: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` with 1-based positions in the order of a hex digest, without putting
    the table into one task: rows are numbered inside the 4,096 prefixes of the
    digest, and counts of prefixes give each its first number. With ``keys``, which
    have few values and no nulls, each of them is numbered for itself."""
    keys = keys or []
    d = df.withColumn("__h", digest).withColumn("__p", F.substring("__h", 1, 3))
    counts = d.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__p", before.alias("__s"), F.sum("__c").over(whole).alias("__n"))
    number = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__h", *ties)) + F.col("__s")
    d = d.join(F.broadcast(starts), [*keys, "__p"]).withColumn(out, number)
    return (d.withColumn(total, F.col("__n")) if total else d).drop("__h", "__p", "__s", "__n")


def numbered(df: DataFrame, order: list, out: str = "number", total: str | None = None) -> DataFrame:
    """``df`` with 1-based positions in any order, without putting the table into
    one task: rows are dealt into ranges of the order and written, a range's rows
    are numbered where they are, and the counts of the ranges before give each
    its first number. Equal rows of the order share a range, so ``order`` should
    tell most rows apart."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    d = scratch(df.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = d.groupBy("__range").agg(F.count(F.lit(1)).alias("__c"))  # a row a range
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__s"), F.sum("__c").over(whole).alias("__n"))
    d = d.join(F.broadcast(starts), "__range").withColumn(out, F.row_number().over(Window.partitionBy("__range").orderBy(*columns)) + F.col("__s"))
    return (d.withColumn(total, F.col("__n")) if total else d).drop("__range", "__s", "__n")


def systematic(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at positions floor(i * n / k) of the order."""
    d = numbered(df, order, "position", "__n").withColumn("position", F.col("position") - 1)
    i = F.ceil(F.col("position") * k / F.col("__n"))
    return d.where((F.floor(i * F.col("__n") / k) == F.col("position")) & (i < k)).drop("__n")
