"""Periodic runs of words, by a vectorised scan of all lags.

A run is a stretch of consecutive words with smallest period q, at least
max(6, 4 q) words long, that no neighbouring word extends. A document's words
become numbers; for every lag p up to n / 4 the array is compared with itself
shifted by p, and the true stretches of that comparison, p words longer each,
are the stretches of period p. A stretch found under several lags has the
smallest of them as its period: it is as long as four periods, so any smaller
period divides the larger one and extends exactly as far.

The comparisons of a lag are counted first, over the low bytes of the numbers
and over blocks that stay in cache. A lag with fewer equal places than the
shortest run needs has no run; only the other lags are compared in full and
split into stretches.

Short texts are scanned where they are read. A long text is work of the square
of its length: it goes to as many tasks as it has ranges of LAGS lags, and the
runs that come back are joined to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, Words, slices, table, text_buffers

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Texts of more bytes than this are scanned by ranges of LAGS lags.
LONG_BYTES = 1 << 19
LAGS = 16_384
_BLOCK = 1 << 15

_RUNS = "array<struct<start:int,length:int,period:int>>"
_FOUND = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def word_numbers(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes, return_inverse=True)[1].astype(np.int32)


def stretches(words: np.ndarray, low: int, high: int) -> np.ndarray:
    """(start, length, period) rows of the stretches of every period in
    [low, high) that are long enough for a run; a stretch may come under several
    periods."""
    n = len(words)
    high = min(high, n // LEAST_EXPONENT + 1)
    if n < LEAST_WORDS or low >= high:
        return np.zeros((0, 3), np.int64)
    small = (words & 255).astype(np.uint8)
    equal = np.zeros(high - low, np.int64)
    for at in range(0, n - low, _BLOCK):
        for p in range(low, min(high, n - at)):
            to = min(at + _BLOCK, n - p)
            equal[p - low] += np.count_nonzero(small[at:to] == small[at + p : to + p])
    lags = np.arange(low, high)
    need = np.maximum(LEAST_WORDS, LEAST_EXPONENT * lags) - lags
    out = []
    for p, least in zip(lags[equal >= need], need[equal >= need]):
        ends = np.flatnonzero(np.concatenate([[True], words[p:] != words[:-p], [True]]))
        true = np.diff(ends) - 1
        at = np.flatnonzero(true >= least)
        if len(at):
            out.append(np.stack([ends[at], true[at] + p, np.full(len(at), p)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def runs_of(found: np.ndarray) -> np.ndarray:
    """Of equal stretches the one with the smallest period, by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def outside(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Places of the words of a document whose tail repeats, by its id, in one of
    ten documents; else all places in turn."""
    places = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


class _Texts:
    """The words of a batch of texts, and their bytes as they stand."""

    def __init__(self, batch: pa.RecordBatch, repeat: bool):
        column = batch.column(batch.schema.get_field_index("text"))
        words = Words(column)
        data = text_buffers(column)[0]
        self.raw = data.tobytes()
        self.starts, self.ends, self.bounds = words.starts, words.ends, words.bounds
        self.hashes = Spans(data).hashes(self.starts, self.ends)
        self.ids, self.repeat = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), repeat

    def places(self, i: int) -> np.ndarray:
        a, b = self.bounds[i : i + 2]
        return a + (planted(self.ids[i], b - a) if self.repeat else np.arange(b - a))

    def numbers(self, i: int) -> np.ndarray:
        return word_numbers(self.hashes[self.places(i)])

    def joined(self, i: int, keep: np.ndarray) -> str:
        at = self.places(i)[keep]
        return b" ".join([self.raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())]).decode()


def _row(doc_id, n: int, runs: np.ndarray, joined: str) -> tuple:
    text = "".join(f"{s},{x},{q}\n" for s, x, q in runs.tolist())
    best = (None, None, None, None)
    if len(runs):
        s, x, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = (s, x, q, 1000 * x // q)
    return doc_id, n, len(runs), *best, hashlib.sha256(text.encode()).hexdigest(), joined


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _finish(repeat: bool):
    """Rows of documents; runs that come with them are not looked for again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, rows = _Texts(batch, repeat), []
            given = batch.schema.get_field_index("runs")
            for i in range(batch.num_rows):
                n = int(texts.bounds[i + 1] - texts.bounds[i])
                if given >= 0:
                    own = batch.column(given)[i].as_py() or []
                    found = np.array([[r["start"], r["length"], r["period"]] for r in own], np.int64).reshape(-1, 3)
                else:
                    found = stretches(texts.numbers(i), 1, n)
                runs = runs_of(found)
                rows.append(_row(texts.ids[i], n, runs, texts.joined(i, outside(n, runs))))
            yield _batch_of(rows)

    return run


def _range_runs(repeat: bool, lags: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, parts = _Texts(batch, repeat), batch.column(batch.schema.get_field_index("part")).to_pylist()
            for i, part in enumerate(parts):
                found = runs_of(stretches(texts.numbers(i), 1 + part * lags, 1 + (part + 1) * lags))
                if len(found):
                    one = batch.slice(i, 1)
                    keys = [pa.array(one.column(one.schema.get_field_index(c)).to_pylist() * len(found), k) for c, k in (("doc_id", pa.int64()), ("key", pa.string()))]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.astype(np.int32)) for c in found.T)], names=["doc_id", "key", "start", "length", "period"])

    return run


def periodic_runs(docs: DataFrame, repeat: bool = False, long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli,
    runs_sha256, collapsed) for every row of ``docs``.

    start, length, period and exponent_milli are those of the longest run (ties:
    smallest start, then period), null without runs. collapsed is the text with
    every run cut to its first period, words joined by one space. ``repeat``
    first makes the tails of some documents repeat, by their ids. Words are told
    apart by 64-bit hashes.

    Defined cases: null and empty texts and texts without words have no runs and
    an empty collapsed text; a document without an id has no repeated tail; rows
    that repeat get a row each; other columns are ignored; an empty table gives
    an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    out = d.where(~is_long).mapInArrow(_finish(repeat), _FOUND)
    long = d.where(is_long).withColumn("key", F.sha2("text", 256))
    # a text of b bytes has b / 2 words at most, and so many lags as a fourth of that
    ranges = F.expr(f"sequence(0L, octet_length(text) div {2 * LEAST_EXPONENT} div {lags})")
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: small texts are much work
    ranged = long.dropDuplicates(["doc_id", "key"]).withColumn("part", F.explode(ranges)).repartition(tasks, "doc_id", "key", "part")
    found = ranged.mapInArrow(_range_runs(repeat, lags), "doc_id long, key string, start int, length int, period int")
    lists = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    lists = table(lists.withColumnsRenamed({"doc_id": "of", "key": "of_key"}), "runs")
    own = long.join(lists, long["doc_id"].eqNullSafe(lists["of"]) & (long["key"] == lists["of_key"]), "left").select("doc_id", "text", F.col("runs").cast(_RUNS))
    return out.unionByName(own.mapInArrow(_finish(repeat), _FOUND))
