"""Whole groups from files that are ordered by a key, without a shuffle.

A task reads its part of a file batch by batch and holds one group at a time; a
group that is whole inside the part is handed on at once. The first and the last
group of a part may go on in its neighbours: their rows are set aside, and only
those, two groups a part, are grouped by key afterwards. A part whose keys
descend, and parts of one file that overlap, raise: the file is not ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError
from .scratch import scratch

_FILE, _START = "__file", "__start"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, bool]]:
    """The groups of a task's parts in their order, and whether each lies at an
    end of its part."""
    held: list[pa.RecordBatch] = []
    last = part = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key))
        if k.null_count:
            raise ContractError(f"{key} is null")
        where = [batch.column(batch.schema.get_field_index(c)) for c in (_FILE, _START)]
        moved = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (k, *where)]
        changes = pc.indices_nonzero(pc.or_(moved[0], pc.or_(moved[1], moved[2]))).to_pylist()
        edges = [0, *(i + 1 for i in changes), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            now, here = k[a].as_py(), (where[0][a].as_py(), where[1][a].as_py())
            if held and (now, here) != (last, part):
                yield pa.Table.from_batches(held), first or here != part
                first, held = here != part, []
            if here == part and now < last:
                raise ContractError(f"{key} descends from {last!r} to {now!r} in {here[0]}")
            held.append(batch.slice(a, b - a))
            last, part = now, here
    if held:
        yield pa.Table.from_batches(held), True


def _split(key: str, columns: list[str], function: Callable[[pa.Table], pa.Table], names: list[str]):
    def structs(table: pa.Table) -> pa.Array:
        return pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], names=table.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, place = None, 0
        for group, edge in _groups(batches, key):
            rows = group.select(columns)
            done = None if edge else function(rows).select(names)
            n = group.num_rows if edge else done.num_rows
            if not n:
                continue
            if empty is None:
                empty = function(rows.slice(0, 0)).select(names), rows.slice(0, 0)
            null = lambda t: pa.nulls(n, structs(t).type)
            where = [pa.array([group.column(c)[0].as_py()] * n, kind) for c, kind in ((_FILE, pa.string()), (_START, pa.int64()))]
            both = (null(empty[0]), structs(rows)) if edge else (structs(done), null(empty[1]))
            yield pa.RecordBatch.from_arrays([*both, *where, pa.array(range(place, place + n), pa.int64())], names=["done", "edge", "file", "start", "place"])
            place += n

    return run


def split_groups(df: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """(done, edge, file, start, place): results of groups that are whole in their
    part, and rows of those at its ends, in turn. ``df`` is a scan of files."""
    out = T.StructType.fromDDL(schema)
    d = df.select("*", F.input_file_name().alias(_FILE), F.input_file_block_start().alias(_START))
    kinds = T.StructType([T.StructField("done", out), T.StructField("edge", df.schema), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("place", T.LongType())])
    return d.mapInArrow(_split(key, df.columns, function, out.fieldNames()), kinds)


def apply_clustered(df: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` of every group of ``df``, a scan of files that are ordered by
    ``key``; a group may be cut by the ends of tasks and files. The function gets
    the rows of a group in the order of the file and must also take no rows.

    A null key and a descending one raise; an empty table gives an empty result.
    A key that comes again in another file is one group only where it stands at
    the ends of both.
    """
    held = scratch(split_groups(df, key, function, schema), "groups")
    edges = held.where("edge IS NOT NULL")
    # parts of a file follow each other
    parts = edges.groupBy("file", "start").agg(F.min(f"edge.{key}").alias("low"), F.max(f"edge.{key}").alias("high"))
    odd = parts.withColumn("before", F.lag("high").over(Window.partitionBy("file").orderBy("start"))).where("before > low").first()
    if odd:
        raise ContractError(f"{key} descends from {odd['before']!r} to {odd['low']!r} in {odd['file']}")
    names = [f.name for f in T.StructType.fromDDL(schema)]
    at = ["__file", "__start", "__place"]

    def joined(table: pa.Table) -> pa.Table:
        return function(table.sort_by([(c, "ascending") for c in at]).drop_columns(at)).select(names)

    cut = edges.select("edge.*", *[F.col(c.strip("_")).alias(c) for c in at])
    return held.where("edge IS NULL").select("done.*").unionByName(cut.groupBy(key).applyInArrow(joined, schema))


def write_clustered(df: DataFrame, path: str, key: str, *order: str) -> DataFrame:
    """Write ``df`` in files ordered by ``key`` and ``order``, each key in one
    file, and read it back."""
    df.repartitionByRange(key).sortWithinPartitions(key, *order).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
