"""LM scoring by subword lattice likelihood.

The vocabulary of an existing subword model, with its scores, spans a lattice
over every word: each way to cut the word into pieces is a path, weighted by its
pieces. A log-space forward recursion sums all paths, and a text's probability
is the product over its words and one end. The pieces stay those of the
vocabulary; their weights start from its scores and are fitted to the training
texts by expectation-maximisation over the same lattices (forward-backward).

Corpus plan: texts are dealt by hash into shards of bounded size, one a task. Each shard
sends its distinct words with counts; words are counted over all shards and
scored once each; every shard gets back the entries of its own words only, so
no dictionary of the corpus is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Spans, Words, drop, slices, span_hashes, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SHARD_BYTES = 32 << 20
#: Byte that stands for the start of a word; no word holds it.
START = 0x20
_SLOTS = 19


class Pieces:
    """A vocabulary as byte strings with log weights, and a hashed lookup."""

    def __init__(self, strings: list[bytes], log_weights: np.ndarray):
        self.strings, self.weights = strings, np.asarray(log_weights, float)
        self.longest = max(map(len, strings))
        self._table = None

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        """Pieces of a sentencepiece model file. Scores of a unigram model are
        log probabilities and are taken as they are; those of a merge model are
        negative merge ranks, which become weights by Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        ids = [i for i in range(model.vocab_size()) if not model.is_control(i) and not model.is_unknown(i)]
        scores = {i: model.get_score(i) for i in ids}
        by_rank = all(float(s).is_integer() for s in scores.values())
        lowest = min(scores.values())
        for i in ids:
            text = model.id_to_piece(i)
            score = lowest - 1 if model.is_byte(i) else scores[i]
            piece = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
            weight = -log(10 - score) if by_rank else score
            found[piece] = float(np.logaddexp(found.get(piece, -np.inf), weight))
        for b in range(256):
            found.setdefault(bytes([b]), min(found.values()))
        strings = sorted(found)
        weights = np.array([found[s] for s in strings])
        return cls(strings, weights - np.logaddexp.reduce(weights))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of the prefix of pieces that each hash is of, -1 where it is none."""
        if self._table is None:
            found = {s: i for i, s in enumerate(self.strings)}
            prefixes = sorted({s[:n] for s in self.strings for n in range(1, len(s) + 1)})
            self.piece = np.array([found.get(x, -1) for x in prefixes])
            # in sorted order a longer string with this prefix comes next
            self.goes_on = np.array([b.startswith(a) for a, b in zip(prefixes, prefixes[1:])] + [False])
            lengths = np.array([len(x) for x in prefixes])
            ends = np.cumsum(lengths)
            own = span_hashes(np.frombuffer(b"".join(prefixes), np.uint8), ends - lengths, ends)
            slot = (own >> U64(64 - _SLOTS)).astype(np.int64)
            first = np.full(1 << _SLOTS, -1, np.int32)
            first[slot[::-1]] = np.arange(len(own), dtype=np.int32)[::-1]
            rest = np.flatnonzero(first[slot] != np.arange(len(own)))
            order = rest[np.argsort(own[rest])]
            self._table = own, first, own[order], order
            # prefixes of one and two bytes are looked up by their bytes
            self._pairs = np.full(1 << 16, -1)
            self._bytes = np.full(256, -1)
            for i in np.flatnonzero(lengths <= 2):
                x = prefixes[i]
                if len(x) == 1:
                    self._bytes[x[0]] = i
                else:
                    self._pairs[x[0] << 8 | x[1]] = i
        own, first, late, order = self._table
        at = first[(h >> U64(64 - _SLOTS)).astype(np.int64)]
        hit = at >= 0
        good = np.zeros(len(h), bool)
        good[hit] = own[at[hit]] == h[hit]
        out = np.where(good, at, -1)
        if len(late):
            miss = np.flatnonzero(hit & ~good)
            where = np.minimum(np.searchsorted(late, h[miss]), len(late) - 1)
            out[miss] = np.where(late[where] == h[miss], order[where], -1)
        return out

    def matches(self, spans: Spans, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of the pieces that stand at ``starts`` and end
        by ``limits``. A start is looked at again one byte longer only while
        some piece begins like that."""
        if self._table is None:
            self.lookup(np.zeros(0, np.uint64))
        out, data = [], spans.data
        for n in range(1, self.longest + 1):
            inside = starts + n <= limits
            starts, limits = starts[inside], limits[inside]
            if not len(starts):
                break
            if n == 1:
                at = self._bytes[data[starts]]
            elif n == 2:
                at = self._pairs[data[starts].astype(np.int64) << 8 | data[starts + 1]]
            else:
                at = self.lookup(spans.hashes(starts, starts + n))
            hit = at >= 0
            starts, limits, at = starts[hit], limits[hit], at[hit]
            piece = self.piece[at]
            whole = piece >= 0
            out.append((starts[whole], np.full(whole.sum(), n), piece[whole]))
            on = self.goes_on[at]
            starts, limits = starts[on], limits[on]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


#: A longer word is handled window by window.
WINDOW = 1 << 20
#: Bytes of words handled at once, with some 300 bytes of arrays for each; a
#: longer word is handled alone.
TOGETHER = 1 << 18
#: Longest stretch of a word whose positions are steps over all stretches.
_SHORT = 64
_TINY, _LIFT = 1e-100, 1e100


def _edges(spans: Spans, a: int, b: int, end: int, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """Pieces at the positions a..b, by start: first edge of each, lengths, pieces."""
    start, length, piece = pieces.matches(spans, np.arange(a, b), np.full(b - a, end))
    order = np.argsort(start, kind="stable")
    return np.searchsorted(start[order], np.arange(a, b + 1)), length[order], piece[order]


def _long(spans: Spans, begin: int, end: int, pieces: Pieces, count: float | None, used: np.ndarray | None) -> float:
    """``word_likelihoods`` of one long stretch: position by position, on scaled
    probabilities, with the pieces of one window at a time."""
    n, reach, weight = end - begin, pieces.longest, np.exp(pieces.weights)
    windows = [(a, min(end, a + WINDOW)) for a in range(begin, end, WINDOW)]
    logs = np.full(n + 1, -np.inf) if used is not None else None
    now, shift = [1.0] + [0.0] * reach, 0.0
    for a, b in windows:
        first, length, piece = _edges(spans, a, b, end, pieces)
        value, first, length = weight[piece].tolist(), first.tolist(), length.tolist()
        ahead, shifts = now + [0.0] * (b - a), [0.0] * (b - a)
        for i in range(b - a):
            v = ahead[i]
            if v < _TINY:
                if v == 0.0:
                    continue
                for j in range(i, i + reach + 1):
                    ahead[j] *= _LIFT
                v, shift = ahead[i], shift - log(_LIFT)
            shifts[i] = shift
            for e in range(first[i], first[i + 1]):
                ahead[i + length[e]] += v * value[e]
        if logs is not None:
            with np.errstate(divide="ignore"):
                logs[a - begin : b - begin] = np.log(ahead[: b - a]) + shifts
        now = ahead[b - a :]
    total = log(now[0]) + shift if now[0] else -np.inf
    if used is None or total == -np.inf:
        return total
    after, shift = [1.0] + [0.0] * reach, 0.0
    known = np.array([0.0] + [-np.inf] * reach)  # logs of the positions from b on
    for a, b in reversed(windows):
        first, length, piece = _edges(spans, a, b, end, pieces)
        value, begins, steps = weight[piece].tolist(), first.tolist(), length.tolist()
        behind, own, shifts = [0.0] * (b - a) + after, [0.0] * (b - a), [0.0] * (b - a)
        for i in range(b - a - 1, -1, -1):
            v = 0.0
            for e in range(begins[i], begins[i + 1]):
                v += behind[i + steps[e]] * value[e]
            behind[i] = v
            if 0.0 < v < _TINY:
                for j in range(i, i + reach + 1):
                    behind[j] *= _LIFT
                shift -= log(_LIFT)
            own[i], shifts[i] = behind[i], shift
        with np.errstate(divide="ignore"):
            beta = np.concatenate([np.log(own) + shifts, known])
        start = np.repeat(np.arange(b - a), np.diff(first))
        share = np.exp(logs[a - begin + start] + pieces.weights[piece] + beta[start + length] - total)
        used += np.bincount(piece, share * count, minlength=len(used))
        after, known = behind[: reach + 1], beta[: reach + 1]
    return total


def _many(spans: Spans, starts: np.ndarray, ends: np.ndarray, pieces: Pieces, counts: np.ndarray | None, used: np.ndarray | None) -> np.ndarray:
    """``word_likelihoods`` of neighbouring spans.

    Words are cut where no piece crosses: all paths meet there, so a word's sum
    is the product of its stretches' sums, exactly. All short stretches then
    step together, one position and piece length at a time."""
    base, n = int(starts[0]), int(ends[-1] - starts[0])
    start, length, piece = pieces.matches(spans, np.arange(base, base + n), np.repeat(ends, ends - starts))
    start = start - base
    wide = length > 1
    crossed = np.cumsum(np.bincount(start[wide] + 1, minlength=n + 1)[: n + 1] - np.bincount(start[wide] + length[wide], minlength=n + 1)[: n + 1])
    cuts = np.flatnonzero(crossed[:n] == 0)
    size = np.diff(cuts, append=n)
    stretch = np.repeat(np.arange(len(cuts)), size)
    word = np.searchsorted(starts - base, cuts, "right") - 1
    # a stretch of n bytes has n + 1 nodes
    node = np.arange(n) + stretch
    first, last = node[cuts], node[cuts] + size
    alpha = np.full(n + len(cuts), -np.inf)
    alpha[first] = 0
    short = size[stretch[start]] <= _SHORT
    start, length, piece = start[short], length[short], piece[short]
    at, into, w = node[start], node[start] + length, pieces.weights[piece]
    rel = start - cuts[stretch[start]]

    def steps(key):
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order], prepend=-1))
        yield from (order[a:b] for a, b in zip(bounds, np.append(bounds[1:], len(order))))

    for e in steps((rel + length) * (pieces.longest + 1) + length):
        alpha[into[e]] = np.logaddexp(alpha[into[e]], alpha[at[e]] + w[e])
    if used is not None:
        beta = np.full(n + len(cuts), -np.inf)
        beta[last] = 0
        for e in steps((_SHORT - rel) * (pieces.longest + 1) + length):
            beta[at[e]] = np.logaddexp(beta[at[e]], beta[into[e]] + w[e])
        total = alpha[last][stretch[start]]
        with np.errstate(invalid="ignore"):
            share = np.exp(alpha[at] + w + beta[into] - total)
        share = np.where(total > -np.inf, share, 0) * counts[word[stretch[start]]]
        used += np.bincount(piece, share, minlength=len(used))
    for i in np.flatnonzero(size > _SHORT):
        a = base + int(cuts[i])
        alpha[last[i]] = _long(spans, a, a + int(size[i]), pieces, None if counts is None else float(counts[word[i]]), used)
    out = np.zeros(len(starts))
    np.add.at(out, word, alpha[last])
    return out


def word_likelihoods(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces, counts: np.ndarray | None = None):
    """Natural-log marginal of each of neighbouring spans (START included); with
    counts, also the expected use of every piece, summed over spans times counts."""
    result = np.zeros(len(starts))
    used = np.zeros(len(pieces.strings)) if counts is not None else None
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + min(TOGETHER, WINDOW), "right")))
        spans = Spans(data[starts[at] : ends[to - 1]])
        a, b = starts[at:to] - starts[at], ends[at:to] - starts[at]
        if b[-1] > WINDOW:
            result[at] = _long(spans, 0, int(b[-1]), pieces, None if counts is None else float(counts[at]), used)
        else:
            result[at:to] = _many(spans, a, b, pieces, None if counts is None else counts[at:to], used)
        at = to
    return result, used


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of binary words, each with START before it."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    shifted = np.full(len(data) + len(column), START, np.uint8)
    shifted[np.arange(len(data)) + np.repeat(np.arange(1, len(column) + 1), np.diff(offsets))] = data
    return shifted, offsets[:-1] + np.arange(len(column)), offsets[1:] + np.arange(1, len(column) + 1)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each shard of this task, once each, with training counts."""
    held: dict[int, list] = {}

    def flush():
        for shard, (h, n, text) in held.items():
            names = ["shard", "h", "n", "word"]
            for i in range(0, len(h), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), shard, np.int32)), pa.array(h[part].view(np.int64)), pa.array(n[part]), text.slice(i, 100_000)], names=names)

    for batch in slices(batches):
        at = batch.schema.get_field_index
        shards = batch.column(at("shard")).to_numpy(zero_copy_only=False)
        train = batch.column(at("n")).to_numpy(zero_copy_only=False) * batch.column(at("train")).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(shards, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            shard = int(shards[own[0]])
            words = Words(batch.column(at("text")).take(pa.array(own)))
            h, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            weight = np.repeat(train[own], np.diff(words.bounds))
            n = np.bincount(inverse, weight, minlength=len(h)).astype(np.int64)
            a, b = words.starts[first], words.ends[first]
            size = b - a
            offsets = np.zeros(len(h) + 1, np.int32)
            np.cumsum(size, out=offsets[1:])
            flat = words.data[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)]
            text = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            if shard in held:
                h0, n0, t0 = held[shard]
                both, first, inverse = np.unique(np.concatenate([h0, h]), return_index=True, return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n0, n]), minlength=len(both)).astype(np.int64)
                text = pa.concat_arrays([t0, text]).take(pa.array(first))
                h = both
            held[shard] = [h, n, text]
    yield from flush()


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 2 * TOGETHER) -> Iterator[pa.Table]:
    """Small batches put together and large ones cut, by bytes of words: the
    cost of a call has a part that does not depend on its rows."""
    held, n = [], 0
    for batch in batches:
        at = batch.schema.get_field_index("word")
        sums = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(sums[start - 1]) if start else 0
            to = max(start + 1, int(np.searchsorted(sums, before + size - n, "right")))
            held.append(batch.slice(start, to - start))
            n += int(sums[to - 1]) - before
            start = to
            if n >= size or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _expected(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.strings))
        for rows in _gathered(batches):
            total += word_likelihoods(*_spans(rows["word"]), pieces, rows["c"].to_numpy().astype(float))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "used"])

    return run


def _likelihood(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            value, _ = word_likelihoods(*_spans(rows["word"]), pieces)
            out = pa.table([rows["h"], rows["c"], pa.array(value / log(10))], names=["h", "c", "lp"])
            yield from out.to_batches(max_chunksize=10_000)

    return run


def _score(known_end: int, end_base: float, end_score: float, floor: float):
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        h = words["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c, lp = h[order], words["c"].to_numpy()[order], words["lp"].to_numpy()[order]
        base = np.log10(c + 0.5) + floor
        out = []
        for batch in slices(docs.combine_chunks().to_batches()):
            w = Words(batch.column(batch.schema.get_field_index("text")))
            at = np.searchsorted(h, w.hashes()) if len(h) else np.zeros(0, int)
            n = np.diff(w.bounds)

            def total(x, w=w, n=n):
                sums = np.concatenate([[0.0], np.cumsum(x)])
                out = np.zeros(len(n))
                some = n > 0
                out[some] = np.add.reduceat(x, w.bounds[:-1][some]) if len(x) else 0
                return out if len(sums) else out

            out.append([n + 1, total((c[at] > 0).astype(float)).astype(np.int64) + known_end, total(base[at]) + end_base, total(lp[at]) + end_score])
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.table([docs["doc_id"], docs["train"], docs["n"], *map(pa.array, cols)], names=["doc_id", "train", "n", "n_tokens", "n_known", "base_score", "score"])

    return run


#: Rows equal in id and text that are this share of all rows are scored once.
REPEATED = 1000
_STEP = 100_000


def _folded(d: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """``d`` with n, the number of rows that a row stands for, and whether some
    stand for several: rows equal in id and text all fall into one shard, so
    those that are many, of a thousand kinds at most, are made one row each."""
    key = F.xxhash64(F.lit("row"), "doc_id", "text")
    many = d.groupBy(key.alias("many")).count().where((F.col("count") > 1) & (F.col("count") * REPEATED >= rows)).select("many")
    many = table(many, "many")
    if many.isEmpty():
        drop(many)
        return d.withColumn("n", F.lit(1).cast("long")), False
    many = F.broadcast(many)  # REPEATED rows at most
    few = d.join(many, key == F.col("many"), "left_anti").withColumn("n", F.lit(1).cast("long"))
    return few.unionByName(d.join(many, key == F.col("many"), "left_semi").groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))), True


def _unfolded(scored: DataFrame) -> DataFrame:
    """Each row as often as it stands for rows, in steps that tasks share."""
    steps = scored.where("n > 1").withColumn("step", F.explode(F.expr(f"sequence(0L, (n - 1) div {_STEP})"))).repartition("doc_id", "n", "score", "step")
    every = steps.withColumn("i", F.explode(F.expr(f"sequence(step * {_STEP}, least(n, (step + 1) * {_STEP}) - 1)")))
    return scored.where("n = 1").unionByName(every.drop("step", "i"))


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 1, folds: int = 5, held: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    score is the log10 marginal probability of the whole text under the lattice
    model; base_score that of an add-half word unigram. Both learn from the rows
    whose crc32(doc_id as text) mod ``folds`` is not ``held``; ``rounds`` is the
    number of EM rounds that fit the weights.

    Defined cases: null and empty texts have one token, the end; a null doc_id
    hashes as an empty text (so it is a training row); repeated rows count as
    many times as they appear; other columns are ignored; an empty table gives
    an empty result; a word without spaces of any length is one word, scored
    whole; with no training rows, base_score falls back on V = N = 0
    and score on the vocabulary's own weights.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.crc32(key) % folds != held).alias("train"))
    size = d.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(F.col("train"), 1)).alias("ends"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes))
    d, repeats = _folded(d, size["rows"])
    dealt = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, "shard")  # one shard a task
    distinct = dealt.mapInArrow(_distinct, "shard int, h long, n long, word binary")
    distinct = table(distinct, "distinct")
    words = table(distinct.groupBy("h").agg(F.sum("n").alias("c"), F.first("word").alias("word")).select("word", "h", "c"), "words")
    stats = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = size["ends"]
    n_train, types = (stats["n"] or 0) + ends, stats["v"] + (ends > 0)

    pieces = Pieces.load(vocabulary)
    end_weight = -log(10)
    for _ in range(rounds if n_train else 0):
        used = np.full(len(pieces.strings), 1e-3)
        rows = words.where("c > 0").select("word", "c").mapInArrow(_expected(pieces), "piece long, used double")
        for r in rows.groupBy("piece").agg(F.sum("used").alias("used")).collect():  # one row a piece of the vocabulary
            used[r["piece"]] += r["used"]
        total = used.sum() + max(ends, 1e-3)
        pieces = Pieces(pieces.strings, np.log(used / total))
        end_weight = log(max(ends, 1e-3) / total)
    scored = table(words.mapInArrow(_likelihood(pieces), "h long, c long, lp double"), "likelihoods")
    entries = distinct.select("shard", "h").join(scored, "h").repartitionById(shards, "shard")
    floor = -np.log10(n_train + 0.5 * (types + 1))
    run = _score(int(ends > 0), float(np.log10(ends + 0.5) + floor), end_weight / log(10), float(floor))
    out = dealt.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(run, "doc_id long, train boolean, n long, n_tokens long, n_known long, base_score double, score double")
    if repeats:
        out = _unfolded(table(out, "scores"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
