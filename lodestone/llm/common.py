"""Shared pieces of the corpus operators: shared-folder tables, and vectorised
tokenisation of Arrow text batches.

Words follow one definition everywhere: maximal runs of bytes that are none of
space, tab, line feed, vertical tab, form feed and carriage return, after
lower-casing the letters A-Z only.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text bytes handled at once; a single longer text is handled alone.
SLICE_BYTES = 2 << 20

_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[_SPACES] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For loose matching: all ASCII but letters and digits separates words.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names
    none and all runs on this machine is a temporary one made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = threading.Lock(), {}, {}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs in here drop their shuffle files at their end. The session's setting
    comes back when the last thread leaves."""
    key = id(spark)
    with _lock:
        _writing[key] = _writing.get(key, 0) + 1
        if _writing[key] == 1:
            _before[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(_CLEANUP, _before.pop(key))


def write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write Parquet, in folders by the columns ``by``, drop the shuffle files of
    that job at its end, read back."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is
    cut, and a lost executor costs only a re-read."""
    return write(df, run_dir(df.sparkSession, name), by)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective avalanche) over a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, U64(base))
        out[0] = 1
        have = _powers[kind] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


class Spans:
    """64-bit hashes of byte spans: a polynomial hash read off one running sum,
    so a span's cost does not depend on its length."""

    def __init__(self, data: np.ndarray):
        n, self.data = len(data), data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _BASE_INVERSE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(starts, ends)


# ---------------------------------------------------------------- text batches
def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(batch.num_rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of one batch of texts, as byte spans into the lowered bytes."""

    def __init__(self, column: pa.Array, separators: np.ndarray = IS_SPACE):
        data, offsets = text_buffers(column)
        self.data = LOWER[data]
        self.offsets = offsets
        n = len(data)
        space = separators[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.starts = np.flatnonzero(~space & (before | first[:n]))
        self.ends = np.flatnonzero(~space & (after | first[1:])) + 1
        #: bounds[i]:bounds[i+1] are the words of text i
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one text's word hashes; a text with
    fewer words gives its whole sequence as one, a text without words none."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    m = n - width + 1
    if width > 8:  # read off one running sum, whatever the width
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power("up", _BASE, n), out=sums[1:])
        out = (sums[width:] - sums[:m]) * _power("down", _BASE_INVERSE, m)
    else:
        out = h[:m].copy()
        for i in range(1, width):
            out += h[i : m + i] * U64(pow(_BASE, i, 2**64))
    return mix(out + U64(width))


def running_hashes(h: np.ndarray):
    """A function of (starts, lengths) to hashes of the windows of ``h``."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("up", _BASE, len(h)), out=sums[1:])
    down = _power("down", _BASE_INVERSE, len(h) + 1)
    return lambda at, n: mix((sums[at + n] - sums[at]) * down[at] + n.astype(np.uint64))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
