"""Readers: tables by extension, contract-checked score rows, annotations,
splits, OCR words, archives and file inventories."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import page_id
from ..operators.contracts import CONTRACTS, ContractError, exact_columns
from ..operators.ranking import numbered


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its extension: parquet, csv, tsv, json, jsonl or ndjson (csv and
    json also gzipped). Without a schema, CSV columns are strings."""
    kind = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path, multiLine=kind == "json")
    raise ContractError(f"unsupported table format: {path}")


def read_contract(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """Just the contract's columns, pruned at the scan; CSV gets its types."""
    schema = CONTRACTS[contract]
    df = read_table(spark, path, schema if not path.endswith(".parquet") else None)
    missing = set(schema.fieldNames()) - set(df.columns)
    if missing:
        raise ContractError(f"{contract}: missing {sorted(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_exact(spark: SparkSession, path: str, contract: str) -> DataFrame:
    return exact_columns(spark.read.parquet(path), contract)


def only(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given value or one of the given list; the
    filter reaches the scan."""
    for c, v in values.items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def for_queries(df: DataFrame, queries: DataFrame) -> DataFrame:
    return df.join(queries.select("query_id").distinct(), "query_id", "left_semi")


def query_order(df: DataFrame) -> DataFrame:
    """(query_id, query_index): first-seen order made explicit by id order, with
    duplicates counted in n."""
    g = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return numbered(g, ["query_id"], "query_index").withColumn("query_index", F.col("query_index") - 1)


def read_splits(spark: SparkSession, folder: str, roles=("train", "validation", "test")) -> DataFrame:
    """(query_id, role) from one text file of ids a role."""
    parts = [spark.read.text(f"{folder}/{r}.txt").select(F.trim("value").alias("query_id"), F.lit(r).alias("role")) for r in roles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("query_id <> ''")


ANNOTATIONS = "examples array<struct<uid:string,query:string,meta_info:struct<file_name:string,reference_page:array<int>,source_type:string,query_type:string>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, document_id, pages, source) of an annotation file."""
    e = spark.read.schema(ANNOTATIONS).json(path, multiLine=True).select(F.explode("examples").alias("e")).select("e.*")
    m = F.col("meta_info")
    source = F.concat_ws("|", F.concat(F.lit("source_type="), F.coalesce(m["source_type"], F.lit("unknown"))), F.concat(F.lit("query_type="), F.coalesce(m["query_type"], F.lit("unknown"))))
    return e.select(F.col("uid").alias("query_id"), F.col("query").alias("text"), F.regexp_replace(m["file_name"], r"\.[^.]*$", "").alias("document_id"), m["reference_page"].alias("pages"), source.alias("source"))


#: Fixed value: the form of a document's id in an annotation's uid.
DOCUMENT = "^[0-9a-f]{40}$"


def annotation_faults(queries: DataFrame, document: str = DOCUMENT) -> DataFrame:
    """(query_id, fault) of annotations that break a rule, the first each: the uid
    is a document's id, ``_`` and a suffix; it comes once; the file is that of the
    document; the query has a text; pages are there, positive and named once."""
    of_uid = F.regexp_extract("query_id", "^(.*)_[^_]+$", 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rules = [
        ("uid", of_uid.rlike(document)), ("repeated_uid", n == 1), ("file_name", F.col("document_id") == of_uid), ("query", F.trim("text") != ""),
        ("no_pages", F.size("pages") > 0), ("page_number", F.forall("pages", lambda p: F.coalesce(p >= 1, F.lit(False)))), ("repeated_page", F.size(F.array_distinct("pages")) == F.size("pages")),
    ]
    fault = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        fault = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(fault)
    return queries.select("query_id", fault.alias("fault")).where("fault IS NOT NULL")


def checked_annotations(spark: SparkSession, path: str, document: str = DOCUMENT) -> DataFrame:
    """``annotations``, or ContractError that counts what is wrong with them."""
    out = annotations(spark, path)
    broken = {r["fault"]: r["n"] for r in annotation_faults(out, document).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a rule
    if broken:
        raise ContractError(f"annotations: {broken}")
    return out


def annotation_qrels(queries: DataFrame) -> DataFrame:
    """(query_id, page_id, relevance): each referenced page once."""
    d = queries.select("query_id", "document_id", F.explode("pages").alias("number")).distinct()
    return d.select("query_id", page_id("document_id", "number").alias("page_id"), F.lit(1.0).alias("relevance"))


def annotation_qrels_checked(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Qrels by (document, page number), with known false where the page list
    has no such page."""
    d = queries.select("query_id", "document_id", F.explode("pages").alias("page_number")).distinct()
    return d.join(pages.select("document_id", "page_number", "page_id"), ["document_id", "page_number"], "left").withColumn("known", F.col("page_id").isNotNull())


def filtered_corpus(queries: DataFrame, qrels: DataFrame, pages: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Queries of a language, and positive qrels between them and known pages."""
    q = queries.where(F.col("language") == language)
    r = qrels.where("score > 0").join(q.select("query_id"), "query_id", "left_semi").join(pages.select("page_id"), "page_id", "left_semi")
    return q, r


def tsv_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of OCR TSV output; quotes are literal, only level 5 counts."""
    d = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    d = d.withColumn("text", F.trim("text")).where("level = 5 AND text <> ''")
    left, top, width, height = (F.col(c).cast("int") for c in ("left", "top", "width", "height"))
    return d.select("text", F.col("conf").cast("double").alias("confidence"), F.array(left, top, left + width, top + height).alias("box"), F.array(*[F.col(c).cast("int") for c in ("block_num", "par_num", "line_num")]).alias("line"))


def wide_predictions(spark: SparkSession, path: str, keys=("query_id", "page_id")) -> DataFrame:
    """(keys, method, score) of a wide CSV with one column a method."""
    d = read_table(spark, path)
    methods = [c for c in d.columns if c not in keys]
    return d.select(*keys, *[F.col(m).cast("double") for m in methods]).unpivot(list(keys), methods, "method", "score")


def file_inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size_bytes, sha256, category) of all files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    category = F.when(kind.isin("py", "ipynb", "sh"), "code").when(kind.isin("parquet", "csv", "json", "jsonl", "tsv"), "data").when(kind.isin("md", "txt", "pdf"), "document").when(kind.isin("png", "jpg", "jpeg"), "image").otherwise("other")
    return r.load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), category.alias("category"))


_MEMBER = "path string, member string, size_bytes long, sha256 string, problem string"


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size_bytes, sha256, problem) of every file in zip and tar
    archives: names that leave the archive and repeated names are marked."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                seen: set[str] = set()
                for name, data in _members(bytes(content)):
                    unsafe = name.startswith("/") or ".." in name.split("/")
                    rows.append((p, name, len(data), hashlib.sha256(data).hexdigest(), "unsafe_name" if unsafe else "repeated" if name in seen else None))
                    seen.add(name)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBER.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _MEMBER)


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
