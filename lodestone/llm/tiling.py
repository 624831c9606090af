"""Benchmark decontamination by greedy string tiling.

Texts are compared as words: lower-cased A-Z, with everything in ASCII that is
neither letter nor digit as a separator. Runs of ``least`` words that a document
and a benchmark item have in common are the seeds of a candidate pair. Each
candidate is tiled: the longest common runs that overlap no earlier one are
marked first, then shorter ones, found by hashing all unmarked windows of a
length (Karp-Rabin) and shortening the length step by step. The item's share of
words under tiles is its coverage. As tiles may come in any order, a reordered
passage is covered like a verbatim one.

The benchmark is a query set: it is cut into blocks of bounded bytes, and each
block's seeds are joined with all documents in one scan, as an index that is sent
to the executors and taken back before the next block's is built. What a block
finds is a small table of its own, written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_MARK, U64, Words, drop, running_hashes, shingles, slices, table

BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, item_words long, covered long, coverage double, tiles long, longest long"
_BITS = 20


def _windows(h: np.ndarray, width: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows without marked words."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    used = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(used[width:] == used[:-width])
    return starts, shingles(h, width)[starts]


class _Common:
    """Lengths of common beginnings of two sequences of word hashes, for many
    pairs of places at once: bisection over hashes read off running sums."""

    def __init__(self, text: np.ndarray, item: np.ndarray):
        self.text, self.item = running_hashes(text), running_hashes(item)

    def lengths(self, start: np.ndarray, at: np.ndarray, known: int, limit: np.ndarray) -> np.ndarray:
        """Lengths from ``known`` to ``limit``."""
        low, high = np.full(len(start), known), limit.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.text(start[open_], middle) == self.item(at[open_], middle)
            low[open_], high[open_] = np.where(same, middle, low[open_]), np.where(same, high[open_], middle - 1)
        return low


def _reach(free: np.ndarray) -> np.ndarray:
    """How many free words stand from each place on."""
    n = len(free)
    used = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(used[::-1])[::-1] - np.arange(n)


def _beginnings(a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start in text, start in item) of the equal windows before which, on both
    sides, no equal windows stand: each common run once. Which places of the item
    these are depends on the hashes of a text's window and the one before alone,
    so equal pairs of hashes are looked up once."""
    kinds, of = np.unique(ha, return_inverse=True)
    order = np.argsort(of, kind="stable")
    places = np.split(a[order], np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1]) if len(kinds) else []
    at = np.searchsorted(kinds, hb)
    kind = np.where((at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == hb), at, -1) if len(kinds) else np.full(len(hb), -1)
    before = np.full(len(b), -1)
    before[1:] = np.where(b[1:] == b[:-1] + 1, kind[:-1], -1)
    hit = np.flatnonzero(kind >= 0)
    pairs, number = np.unique(np.stack([before[hit], kind[hit]], 1), axis=0, return_inverse=True)
    firsts = [places[k] if p < 0 else np.setdiff1d(places[k], places[p] + 1, assume_unique=True) for p, k in pairs.tolist()]
    count = np.array([len(f) for f in firsts], np.int64)
    number = number.reshape(-1)
    return np.repeat(b[hit], count[number]), np.concatenate([np.zeros(0, np.int64), *[firsts[i] for i in number.tolist()]])


def _pieces(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the free stretches of at least ``least`` words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return [(x, y - x) for x, y in edges.reshape(-1, 2).tolist() if y - x >= least]


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in text, start in item, length) of the greedy tiles of two
    sequences of word hashes; earlier starts first among equal lengths."""
    least = min(least, len(item)) or 1
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    width, common = len(item), None
    while width >= least and len(text):
        # longest first: windows of this width, extended to maximal runs
        a, ha = _windows(item, width, free_item)
        b, hb = _windows(text, width, free_text)
        start, at = _beginnings(a, ha, b, hb)
        if len(start):
            common = common or _Common(text, item)
            n = common.lengths(start, at, width, np.minimum(_reach(free_text)[start], _reach(free_item)[at]))
            order = np.lexsort((at, start, -n))
            found, left = np.stack([-n, start, at], 1)[order], []
            i = 0
            while i < len(found) or left:
                if left and (i == len(found) or left[0] < tuple(found[i].tolist())):
                    n, s, t = heappop(left)
                else:
                    (n, s, t), i = found[i].tolist(), i + 1
                free = free_text[s : s - n] & free_item[t : t - n]
                if not free.all():
                    for x, size in _pieces(free, width):  # what earlier tiles left of it
                        heappush(left, (-size, s + x, t + x))
                    continue
                free_text[s : s - n] = free_item[t : t - n] = False
                out.append((s, t, -n))
                if not _pieces(free_item, width):
                    break
        if free_item.sum() < least:
            break
        width = width // 2 if width // 2 > least else least if width > least else 0
    return out


class _Block:
    """Items as word hashes, and their seeds by hash."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int):
        words = Words(pa.array([t for _, t in rows], pa.string()), IS_MARK)
        h = words.hashes()
        self.least = least
        self.ids = [i for i, _ in rows]
        self.items = [h[words.bounds[i] : words.bounds[i + 1]] for i in range(len(rows))]
        self.seeds, self.windows = {}, {}
        widths = np.array([min(least, len(x)) for x in self.items])
        for width in np.unique(widths[widths > 0]):
            own = [(shingles(self.items[i], int(width)), i) for i in np.flatnonzero(widths == width)]
            self.windows |= {int(i): s for s, i in own}
            seed = np.concatenate([s for s, _ in own])
            item = np.repeat([i for _, i in own], [len(s) for s, _ in own])
            order = np.argsort(seed, kind="stable")
            seed, item = seed[order], item[order]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(seed >> U64(64 - _BITS)).astype(np.int64)] = True
            self.seeds[int(width)] = seed, item, bitmap

    def candidates(self, h: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(text, item) pairs that share a seed, of a batch of texts, where the
        item's words in shared seeds reach the threshold: tiles hold no others."""
        found = []
        for width, (seed, item, bitmap) in self.seeds.items():
            if len(h) < width:
                continue
            g = shingles(h, width)
            maybe = np.flatnonzero(bitmap[(g >> U64(64 - _BITS)).astype(np.int64)])
            low = np.searchsorted(seed, g[maybe], "left")
            hit = seed[np.minimum(low, len(seed) - 1)] == g[maybe]
            text = np.searchsorted(bounds, maybe[hit], "right") - 1
            inside = maybe[hit] + width <= bounds[text + 1]
            found.append((width, text[inside], g[maybe[hit]][inside]))
        texts = np.unique(np.concatenate([t for _, t, _ in found])) if found else []
        for t in texts:
            near = np.zeros(len(self.items), bool)
            own = {}
            for width, text, g in found:
                a, b = np.searchsorted(text, [t, t + 1])
                own[width] = np.unique(g[a:b])
                seed, item, _ = self.seeds[width]
                # one text at a time, each of its seeds once
                for low, high in zip(np.searchsorted(seed, own[width], "left"), np.searchsorted(seed, own[width], "right")):
                    near[item[low:high]] = True
            for i in np.flatnonzero(near):
                n = len(self.items[i])
                width = min(self.least, n)
                starts = np.flatnonzero(np.isin(self.windows[i], own[width]))
                inside = np.zeros(n + 1, np.int64)
                np.add.at(inside, starts, 1)
                np.add.at(inside, starts + width, -1)
                if (np.cumsum(inside[:n]) > 0).sum() >= threshold * n:
                    yield int(t), int(i)


def _leaks(block: _Block, batch: pa.RecordBatch, threshold: float) -> Iterator[tuple]:
    """(text number, item, covered, tiles, longest) of a batch."""
    words = Words(batch.column(batch.schema.get_field_index("text")).cast(pa.string()), IS_MARK)
    h = words.hashes()
    for t, i in block.candidates(h, words.bounds, threshold):
        found = tiles(h[words.bounds[t] : words.bounds[t + 1]], block.items[i], block.least)
        covered = sum(n for _, _, n in found)
        if found and covered >= threshold * len(block.items[i]):
            yield int(t), int(i), covered, len(found), max(n for _, _, n in found)


def _match(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches):
            ids, out = batch.column(0), []
            for t, i, covered, n, longest in _leaks(block, batch, threshold):
                words = len(block.items[i])
                out.append((ids[t].as_py(), block.ids[i], words, covered, covered / words, n, longest))
            if out:
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(7)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _drop(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in _leaks(block, batch, threshold)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _leaking(shared, threshold: float):
    """The digests of texts with a leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches):
            leaks = sorted({t for t, *_ in _leaks(block, batch, threshold)})
            if leaks:
                yield batch.select(["h1", "h2"]).take(pa.array(leaks))

    return run


def _blocks(benchmark: DataFrame, least: int, block_bytes: int) -> Iterator[tuple]:
    """The items in blocks of bounded bytes (of UTF-8), each sent to the
    executors once; with each, whether it is the only one."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows, size, blocks = [], 0, 0
    for r in items.toLocalIterator():
        if size >= block_bytes:
            blocks += 1
            yield sc.broadcast(_Block(rows, least)), False
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
    yield sc.broadcast(_Block(rows, least)), not blocks


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, tiles, longest) of every
    document and item whose coverage reaches ``threshold``.

    Defined cases: null and empty texts and items match nothing; an item with
    fewer than ``least`` words matches where all of them stand together;
    repeated documents or items give repeated rows; null ids are carried as
    null; other columns are ignored; empty tables give an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for shared, only in _blocks(benchmark, least, block_bytes):
        part = d.mapInArrow(_match(shared, threshold), SCHEMA)
        if only:
            return part
        parts.append(table(part, "tiles"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text has a contamination; all columns
    pass through. With one block of items no shuffle is needed; with several,
    every block leaves the digests of leaking texts, which are joined out."""
    parts = []
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    for shared, only in _blocks(benchmark, least, block_bytes):
        if only:
            return docs.mapInArrow(_drop(shared, threshold), docs.schema)
        texts = docs.select(F.col("text").cast("string").alias("text")).select("text", one.alias("h1"), two.alias("h2"))
        parts.append(table(texts.mapInArrow(_leaking(shared, threshold), "h1 long, h2 long"), "leaks"))
        shared.destroy()
    gone = table(reduce(DataFrame.unionByName, parts).distinct(), "leaks")
    drop(*parts)
    text = F.col("text").cast("string")
    return docs.join(gone, (F.xxhash64(text) == gone["h1"]) & (F.xxhash64(F.lit("second"), text) == gone["h2"]), "left_anti")
