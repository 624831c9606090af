"""Deterministic samples and splits by hash order.

Positions in hash order are counted by hash prefix, so no table goes into one
task; strata are window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from .ranking import allocate, hash_numbers


def hashed(*parts) -> Column:
    return F.sha2(F.concat_ws(":", *[F.lit(p) if not isinstance(p, Column) else p for p in parts]), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows with the smallest hash of seed:key."""
    return df.withColumn("__h", hashed(seed, F.col(key).cast("string"))).orderBy("__h", key).limit(n).drop("__h")


def ratio_split(df: DataFrame, key: str, namespace: str, seed: str, shares=(0.70, 0.15), roles=("train", "validation", "test")) -> DataFrame:
    """``df`` with role: hash order cut at half-even rounded counts; what is left
    goes to the last role."""
    d = hash_numbers(df, hashed(namespace, seed, F.col(key).cast("string")), [key], "__at", "__all")
    first = half_even(F.col("__all") * F.lit(shares[0]))
    second = first + half_even(F.col("__all") * F.lit(shares[1]))
    role = F.when(F.col("__at") <= first, roles[0]).when(F.col("__at") <= second, roles[1]).otherwise(roles[2])
    return d.withColumn("role", role).drop("__at", "__all")


def two_way_split(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``df`` with part: the first n in hash order are selected, others reserve."""
    d = hash_numbers(df, hashed(seed, F.col(key).cast("string")), [key], "__at")
    return d.withColumn("part", F.when(F.col("__at") <= n, "selected").otherwise("reserve")).drop("__at")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows over strata by largest remainder, first in hash order inside each."""
    shares = allocate(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size")), "size", n, strata)
    w = Window.partitionBy(*strata).orderBy(hashed(seed, F.col(key).cast("string")), key)
    on = [df[s].eqNullSafe(shares[s]) for s in strata]
    ranked = df.withColumn("__r", F.row_number().over(w))
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return ranked.join(shares, condition).where("__r <= share").select(*[ranked[c] for c in df.columns])


def positions(df: DataFrame, strata: list[str], key: str, seed: str, dev: int, holdout: int) -> DataFrame:
    """``df`` with part: the first ``dev`` of each stratum, then ``holdout``."""
    w = Window.partitionBy(*strata).orderBy(hashed(seed, F.col(key).cast("string")), key)
    r = F.row_number().over(w)
    return df.withColumn("part", F.when(r <= dev, "dev").when(r <= dev + holdout, "holdout")).where("part IS NOT NULL")


def probe_pages(df: DataFrame, group: str, order: str, size: str, k: int, seed: str) -> DataFrame:
    """k rows of each group: the first, the last, the smallest and the largest,
    then in hash order; each row once."""
    w = Window.partitionBy(group)
    d = df.withColumns({
        "__first": F.row_number().over(w.orderBy(F.asc(order))), "__last": F.row_number().over(w.orderBy(F.desc(order))),
        "__small": F.row_number().over(w.orderBy(F.asc(size), F.asc(order))), "__large": F.row_number().over(w.orderBy(F.desc(size), F.asc(order))),
    })
    pick = F.when(F.col("__first") == 1, 0).when(F.col("__last") == 1, 1).when(F.col("__small") == 1, 2).when(F.col("__large") == 1, 3).otherwise(4)
    d = d.withColumn("pick", pick).withColumn("__r", F.row_number().over(w.orderBy("pick", hashed(seed, F.col(order).cast("string")), order)))
    return d.where(F.col("__r") <= k).drop("__first", "__last", "__small", "__large", "__r")


def split_overlaps(roles: DataFrame, key: str = "query_id") -> DataFrame:
    """One row: rows, distinct keys, and keys that have more than one role."""
    per = roles.groupBy(key).agg(F.count_distinct("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("key_count"), F.count_if(F.col("roles") > 1).alias("overlapping"))
