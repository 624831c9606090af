"""Score matrices in array files with receipts, as a Spark data source.

A folder holds ``pages.json``, the page of each column, and for every channel
blocks of some rows: an array file and, beside it, a receipt with the channel,
the identity of the run, the query of each row, shape, type, size and SHA-256. A
task writes a block, and a task reads one: it compares the receipt with the pages
and the identity that are asked for and the bytes with the receipt, and gives
(query_id, page_id, channel, score) rows. Blocks of other channels than those
asked for, by option or by a filter on ``channel``, are not opened.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..operators.contracts import ContractError
from ..operators.ranking import hash_numbers

SCHEMA = "query_id string, page_id string, channel string, score double"
#: Rows of a block.
ROWS = 64


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    files, p = _at(path)
    with files.open_input_stream(p) as f:
        return f.read()


def _write(path: str, data: bytes, attempt: str) -> None:
    """The file appears whole, under its name, at the end."""
    files, p = _at(path)
    files.create_dir(p.rpartition("/")[0], recursive=True)
    with files.open_output_stream(f"{p}.{attempt}.part") as f:
        f.write(data)
    files.move(f"{p}.{attempt}.part", p)


def _exists(path: str) -> bool:
    files, p = _at(path)
    return files.get_file_info(p).type != fs.FileType.NotFound


def _block(folder: str, pages: list[str], identity: str):
    place = {p: i for i, p in enumerate(pages)}

    def run(rows: pa.Table) -> pa.Table:
        import uuid

        queries = sorted(set(rows.column("query_id").to_pylist()))
        row = {q: i for i, q in enumerate(queries)}
        i = np.array([row[q] for q in rows.column("query_id").to_pylist()])
        j = np.array([place.get(p, -1) for p in rows.column("page_id").to_pylist()])
        values = np.full((len(queries), len(pages)), np.nan)
        if len(i) != values.size or (j < 0).any():
            raise ContractError(f"{len(i)} scores for {len(queries)} queries and {len(pages)} pages, or unknown pages")
        values[i, j] = rows.column("score").to_numpy()
        if not np.isfinite(values).all():
            raise ContractError("a score is missing, repeated or not finite")
        out = io.BytesIO()
        np.save(out, values, allow_pickle=False)
        data, channel, block = out.getvalue(), rows.column("channel")[0].as_py(), rows.column("block")[0].as_py()
        receipt = {"channel": channel, "identity": identity, "query_ids": queries, "shape": list(values.shape), "dtype": str(values.dtype), "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        path = f"{folder}/channel={channel}/block-{block:08d}"
        _write(f"{path}.npy", data, uuid.uuid4().hex)
        _write(f"{path}.json", json.dumps(receipt).encode(), uuid.uuid4().hex)
        return pa.table({"channel": [channel], "block": [block], "queries": [len(queries)], "sha256": [receipt["sha256"]]})

    return run


def write_matrices(df: DataFrame, folder: str, pages: list[str], identity: str = "", rows: int = ROWS) -> DataFrame:
    """Write (query_id, page_id, channel, score) rows; gives (channel, block,
    queries, sha256). Every query of a channel needs one finite score for each of
    ``pages``, the columns of the matrix. Fails if the folder exists."""
    if not pages or len(set(pages)) != len(pages):
        raise ContractError("pages must be there and differ")
    if _exists(f"{folder}/pages.json"):
        raise FileExistsError(folder)
    _write(f"{folder}/pages.json", json.dumps(pages).encode(), "first")
    queries = hash_numbers(df.select("query_id").distinct(), F.sha2("query_id", 256), ["query_id"], "number")
    blocks = queries.select("query_id", F.floor((F.col("number") - 1) / rows).cast("long").alias("block"))
    placed = df.select("query_id", "page_id", "channel", F.col("score").cast("double").alias("score")).join(blocks, "query_id")
    done = placed.groupBy("channel", "block").applyInArrow(_block(folder, pages, identity), "channel string, block long, queries long, sha256 string")
    receipts = done.collect()  # a short row a block; writes the blocks once
    return df.sparkSession.createDataFrame(receipts, done.schema)


class _Blocks(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.identity = options["path"].rstrip("/"), options.get("identity")
        self.channels = set(options["channels"].split(",")) if options.get("channels") else None

    def partitions(self) -> list[_Blocks]:
        files, at = _at(self.folder)
        found = files.get_file_info(fs.FileSelector(at, recursive=True))
        names = sorted(f.path for f in found if f.path.endswith(".json") and not f.path.endswith("/pages.json"))
        wanted = [n for n in names if self.channels is None or n.rsplit("/", 2)[1].removeprefix("channel=") in self.channels]
        return [_Blocks(f"{self.folder}{n.removeprefix(at)}") for n in wanted]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        receipt, pages = json.loads(_read(partition.path)), json.loads(_read(f"{self.folder}/pages.json"))
        data = _read(partition.path.removesuffix(".json") + ".npy")
        if len(data) != receipt["size_bytes"] or hashlib.sha256(data).hexdigest() != receipt["sha256"]:
            raise ContractError(f"{partition.path}: the array differs from its receipt")
        if self.identity is not None and receipt["identity"] != self.identity:
            raise ContractError(f"{partition.path}: it belongs to another run")
        values = np.load(io.BytesIO(data), allow_pickle=False)
        if list(values.shape) != receipt["shape"] or str(values.dtype) != receipt["dtype"] or values.shape != (len(receipt["query_ids"]), len(pages)) or not np.isfinite(values).all():
            raise ContractError(f"{partition.path}: shape, type or values differ from the receipt and the pages")
        for q, row in zip(receipt["query_ids"], values):
            columns = [pa.array([q] * len(pages)), pa.array(pages, pa.string()), pa.array([receipt["channel"]] * len(pages)), pa.array(row.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "page_id", "channel", "score"])


class _Filtered(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("channel",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.channels = asked if self.channels is None else self.channels & asked
            else:
                yield f


class ScoreMatrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "score_matrices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Filtered if self.options.get("filtered") == "true" else _Reader)(self.options)


def read_matrices(spark: SparkSession, folder: str, channels: list[str] | None = None, identity: str | None = None) -> DataFrame:
    """(query_id, page_id, channel, score) of a folder that ``write_matrices``
    wrote; an array that differs from its receipt, and blocks of another
    ``identity``, raise when they are read."""
    spark.dataSource.register(ScoreMatrices)
    reader = spark.read.format("score_matrices")
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("filtered", "true")
    for k, v in (("channels", ",".join(channels) if channels else None), ("identity", identity)):
        reader = reader if v is None else reader.option(k, v)
    return reader.load(folder)
