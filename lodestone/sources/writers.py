"""Writers: create-once tables, published bundles with a manifest, and their
verification by replay."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import binding_report, fingerprint_of
from ..operators.contracts import same_rows


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Fails if the path exists; a job's files appear together at its end."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_observed(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None, **options) -> dict[str, str]:
    """Write Parquet and give its order-free fingerprint (row_count, xor, total),
    taken of the rows as they are written, without reading them again."""
    seen = Observation()
    out = df.observe(seen, *fingerprint_of(sorted(df.columns)))
    out.write.mode(mode).options(**options).partitionBy(*(by or [])).parquet(path)
    return {k: str(v) for k, v in seen.get.items()}


def write_wide(long: DataFrame, path: str, methods: list[str], keys=("query_id", "page_id")) -> None:
    """Gzipped CSV with a column a method."""
    wide = pivot_methods(long, methods, keys)
    wide.write.mode("errorifexists").csv(path, header=True, compression="gzip")


#: The canonical order of each published list.
CANONICAL = {
    "manifest": ("document_id", "page_number", "page_id"), "aliases": ("canonical_page_id", "alias_id"), "duplicates": ("group_id", "left_page_id", "right_page_id"),
    "candidates": ("dataset", "query_id", "page_id"),
}


def write_canonical(df: DataFrame, path: str, kind: str, *ties: str) -> None:
    """CSV in the canonical order of its kind: sorted in ranges, so that the parts
    in the order of their names are the list. Quotes are doubled, nulls empty."""
    order = [c for c in (*CANONICAL[kind], *ties) if c in df.columns]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="", lineSep="\n")


def canonical_faults(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """(file, rows, descents, first, last, overlaps) of a canonical list: rows of a
    part that come before the one above them, and whether a part begins before
    the part above it ends."""
    names = [c for c in CANONICAL[kind] if c in T.StructType.fromDDL(schema).fieldNames()]
    d = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', emptyValue="")
    d = d.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("n"), F.struct(*names).alias("key"))
    w = Window.partitionBy("file").orderBy("start", "n")
    d = d.withColumn("down", F.coalesce(F.lag("key").over(w) > F.col("key"), F.lit(False)))
    per = d.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("down").alias("descents"), F.min("key").alias("first"), F.max("key").alias("last"))
    above = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("file"))  # a row a part
    return per.withColumn("overlaps", F.coalesce(above > F.col("first"), F.lit(False)))


def pivot_methods(long: DataFrame, methods: list[str], keys=("query_id", "page_id")) -> DataFrame:
    return long.groupBy(*keys).pivot("method", methods).agg(F.first("score"))


def publish(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables and a manifest of their row counts and fingerprints, which are
    taken while the rows are written; returns the manifest."""
    rows = []
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        f = write_observed(df, f"{folder}/{name}", compression="zstd")
        schema = spark.read.parquet(f"{folder}/{name}").schema  # of the files' footers
        rows.append((name, int(f["row_count"]), f["xor"], f["total"], json.dumps(schema.jsonValue())))
    manifest = spark.createDataFrame(rows, "table string, row_count long, xor string, total string, schema string")
    write_once(manifest, f"{folder}/_manifest", "json")
    return manifest


def verify(spark: SparkSession, folder: str, replayed: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """Rows that are only published, and only replayed, for each table."""
    out = {}
    for name, df in replayed.items():
        r = same_rows(spark.read.parquet(f"{folder}/{name}").select(df.columns), df).first()
        out[name] = (r["only_left"], r["only_right"])
    return out


def verify_files(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: files of a manifest that are bound, missing, unexpected, changed."""
    return binding_report(manifest, inventory, "path", "sha256")
