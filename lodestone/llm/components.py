"""Connected components of a link table, by alternating star contractions.

Links are first contracted inside the tasks that hold them, a bounded number at a
time: each chunk becomes stars. Then every round gives each node the minimum of
its neighbours. The minimum is a grouping with partial sums, so no node's links
meet in one task for it; it goes back to the links by broadcast for hubs, which
have a thousandth of all links each and so are a thousand at most, and by a join
for all other nodes. Nothing is collected. Links are written to the shared folder
between rounds, and the number of rounds grows with the logarithm of the number
of nodes. Rounds end as soon as all links form stars, which a round would leave
as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: Nodes with this share of all links are hubs.
HUBS = 1000
#: Links that a task contracts at once.
CHUNK = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links of each node to the smallest node of its component among these."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        np.minimum.at(low, root[left], low[right])
        np.minimum.at(low, root[right], low[left])
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def _contract(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            have += batch.num_rows
            if have >= chunk:
                yield _stars(*map(np.concatenate, zip(*held)))
                held, have = [], 0
        if have:
            yield _stars(*map(np.concatenate, zip(*held)))

    return run


def _lowest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): links with the smallest b of all links of a; and the written
    table it reads."""
    low = table(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
    total = low.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") * HUBS >= total
    first = links.join(F.broadcast(low.where(hub).select(F.col("a").alias("hub"), F.col("m").alias("hub_m"))), F.col("a") == F.col("hub"), "left")
    at_hubs = first.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    return at_hubs.unionByName(first.where("hub IS NULL").select("a", "b").join(low.where(~hub).select("a", "m"), "a")), low


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low, held = _lowest(both)
    return low.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")), held


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    low, held = _lowest(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    # a node's smallest neighbour keeps its link to the node, the others get one to the smallest
    return low.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")), held


def _all_stars(links: DataFrame) -> bool:
    """Whether, of distinct links with b < a, no node is an a twice, or both an
    a and a b."""
    ends = links.select(F.explode(F.expr("array(struct(a AS node, 1 AS leaf), struct(b AS node, 0 AS leaf))")).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("all_leaf"))
    return not nodes.where("leaf > 1 OR (leaf = 1 AND all_leaf = 0)").agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame, left: str = "a", right: str = "b", chunk: int = CHUNK) -> DataFrame:
    """(a, b): each linked node with the smallest node of its component, that
    node itself left out. Nodes without links do not appear. Repeated links and
    links of a node to itself are allowed; links with a null end are ignored.
    The result is a written table of its own."""
    now = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a <> b")
    now = table(now.mapInArrow(_contract(chunk), "a long, b long").distinct(), "links")
    while not _all_stars(now):
        large, low = _large_star(now)
        middle = table(large, "links")
        drop(low, now)
        small, low = _small_star(middle)
        now = table(small.where("a <> b").distinct(), "links")
        drop(low, middle)
    return now
