"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte n-grams (3 and 4 bytes of the
lower-cased text, with runs of spaces and digits as one space, and one at both ends). A document is a mixture: every one
of its n-grams was drawn from one of the languages, and expectation-maximisation
finds the proportions that make the document likeliest. Languages are then left
out, the weakest first, as long as the likelihood penalised by the number of
languages (Bayesian information criterion) improves. Every set is fitted to its
maximum, starting from the shares of the larger set, as the criterion compares
maxima. The prediction is the language with the largest proportion in the chosen
set, the score that proportion.

The model is languages x buckets numbers, whatever the size of the corpus; every
training text is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, U64, fresh, lists, slices, text_buffers

BUCKETS = 1 << 14
_SLICE = 1 << 20
#: Log likelihood that a fit may miss, for short texts a thousandth of it an n-gram.
_MISSING = 1e-3
#: A fit starts near the best single language, with so much spread over all.
_SPREAD = 0.02
#: Most languages for Newton steps.
_NEWTON = 16
#: Numbers of a group's likelihood array (small enough for a cache).
_CELLS = 1 << 17
#: Texts whose n-gram tables are held at once.
_ROWS = 128


def _ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of a batch of texts."""
    data, offsets = text_buffers(column)
    data = LOWER[data]
    data = np.where(IS_SPACE[data] | ((data >= 0x30) & (data <= 0x39)), np.uint8(0x20), data)
    texts = len(offsets) - 1
    plain = np.repeat(np.arange(texts), np.diff(offsets))
    owner = np.repeat(np.arange(texts), np.diff(offsets) + 2)
    framed = np.full(len(owner), 0x20, np.uint8)
    framed[np.arange(len(data)) + 2 * plain + 1] = data
    data = framed
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint64), owner[keep]
    docs, grams = [], []
    for n in (3, 4):
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            code = code * U64(257) + data[i : len(data) - n + 1 + i]
        same = owner[n - 1 :] == owner[: len(owner) - n + 1]
        code = (code[same] + U64(n << 40)) * U64(0x9E3779B97F4A7C15)
        grams.append((code >> U64(50)).astype(np.int64))
        docs.append(owner[: len(owner) - n + 1][same])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(grams)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, limit=_SLICE):
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        docs, grams = _ngrams(batch.column(batch.schema.get_field_index("text")))
        for lang in set(langs):
            n = np.bincount(grams[(langs == lang)[docs]], minlength=BUCKETS)
            totals[lang] = totals.get(lang, 0) + n
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, every value of lang, and their (languages, buckets) n-gram
    probabilities from (text, lang); rows without lang are left out. The model
    takes BUCKETS doubles a value, 128 KB."""
    d = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = d.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in d.select("lang").distinct().collect())  # also those without n-grams
    found = counts.toArrow()  # a row a language and bucket: the model, which every task gets
    p = np.full((len(names), BUCKETS), 0.5)
    row = {x: i for i, x in enumerate(names)}
    at = np.array([row[x] for x in found["lang"].to_pylist()], np.int64)
    p[at, found["bucket"].to_numpy()] += found["n"].to_numpy()
    return names, p / p.sum(1, keepdims=True)


def _newton(like: np.ndarray, share: np.ndarray, p: np.ndarray, slope: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Proportions at the maximum of the likelihood's quadratic form; negative
    ones are set to zero and the others solved again."""
    k = slope.shape[1]
    curve, ratio = np.empty((len(slope), k, k)), share / p
    for i in range(k):
        part = like[:, i] * ratio
        for j in range(i + 1):
            curve[:, i, j] = curve[:, j, i] = np.einsum("tc,tc->t", part, like[:, j])
    curve += 1e-9 * np.eye(k) * curve
    on = np.ones(slope.shape, bool)
    for _ in range(k):
        both = on[:, :, None] & on[:, None]
        pi = np.linalg.solve(np.where(both, curve, np.eye(k)), np.where(on, 2 * slope - total[:, None], 0)[:, :, None])[:, :, 0]
        if (pi >= 0).all():
            break
        on &= pi > 0
    pi = np.maximum(pi, 0)
    whole = pi.sum(1, keepdims=True)
    return np.where(whole > 0, pi / np.maximum(whole, 1e-300), 1 / k)


def _em(like: np.ndarray, count: np.ndarray, total: np.ndarray, pi: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log likelihoods at the maximum, from
    the proportions ``pi`` on. ``like`` is (texts, languages, cells).

    The log likelihood is concave, so its largest derivative less the text's
    number of n-grams bounds what is missing to the maximum. Every text iterates
    until that bound is below its tolerance. A Newton step is tried between
    rounds of EM, and taken back unless it halves the bound.
    A text whose likelihood can be shown to stay below ``enough`` is left there,
    with minus infinity.
    """
    out, ll = pi.copy(), np.empty(len(pi))
    k, live, limit = pi.shape[1], np.arange(len(pi)), np.minimum(_MISSING, total * _MISSING / 1000)
    # the bound and the EM step of the last point that was kept
    bound, step = np.full(len(pi), np.inf), pi
    tried = np.zeros(len(pi), bool)
    # further from its maximum than this, a likelihood cannot be shown to stay below
    room = None if enough is None else 0.5 * np.log(np.maximum(total, 2))
    while True:
        p = pi[:, :1] * like[:, 0]
        for i in range(1, k):
            p += pi[:, i : i + 1] * like[:, i]
        share = count / np.maximum(p, 1e-300)
        slope = np.stack([np.einsum("tc,tc->t", like[:, i], share) for i in range(k)], 1)
        missing = slope.max(1) - total
        done = missing <= limit
        below = np.zeros(len(done), bool)
        if enough is not None and (near := np.flatnonzero(missing <= room)).size:
            below[near] = np.einsum("tc,tc->t", count[near], np.log(p[near])) + missing[near] <= enough[near]
            done &= ~below
        if done.any() or below.any():
            out[live[done]], ll[live[done]] = pi[done], np.einsum("tc,tc->t", count[done], np.log(p[done]))
            ll[live[below]] = -np.inf
            done |= below
            if done.all():
                return out, ll
            like, count, total, pi, live, limit, bound, step, tried, p, share, slope, missing, enough, room = (
                None if x is None else x[~done] for x in (like, count, total, pi, live, limit, bound, step, tried, p, share, slope, missing, enough, room)
            )
        kept = ~tried | (missing <= bound / 2)
        after = np.maximum(pi * slope / total[:, None], 1e-12)
        step = np.where(kept[:, None], after / after.sum(1, keepdims=True), step)
        bound = np.where(kept, missing, bound)
        tried = kept & (k <= _NEWTON)
        pi = step.copy()
        if tried.all():
            pi = _newton(like, share, p, slope, total)
        elif tried.any():
            pi[tried] = _newton(*(x[tried] for x in (like, share, p, slope, total)))


def _choose(like: np.ndarray, count: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages for texts of one table width, of which
    ``single`` has the log likelihood of every language alone.

    Whatever languages a set has, its likelihood is at most that of all, which
    during the fit is at most the likelihood so far and the slope's excess. Where
    that is no more than the best single language and one penalty, no set of two
    or more can win, and that language is chosen without further fits.
    """
    texts, k = like.shape[:2]
    total = count.sum(1)
    penalty = 0.5 * np.log(np.maximum(total, 2))
    best, score = np.zeros((texts, k)), np.full(texts, -np.inf)
    active, langs, pi = np.arange(texts), np.tile(np.arange(k), (texts, 1)), np.full((texts, k), _SPREAD / k)
    pi[np.arange(texts), single.argmax(1)] += 1 - _SPREAD
    for left in range(k, 0, -1):
        first = left == k and k > 1
        pi, ll = _em(like, count, total[active], pi, single.max(1) + penalty if first else None)
        value = ll - penalty[active] * (left - 1)
        if first and (alone := np.isneginf(ll)).any():
            best[alone, single[alone].argmax(1)] = 1
            score[alone] = np.inf
        better = value >= score[active]
        active, langs, pi, like, count = (x[better] for x in (active, langs, pi, like, count))
        score[active] = value[better]
        best[active] = 0
        best[active[:, None], langs] = pi
        if left == 1 or not len(active):
            return best
        # of equal shares (to a hundred-thousandth) the last language leaves
        weakest = left - 1 - pi[:, ::-1].round(5).argmin(1)
        keep = np.arange(left) != weakest[:, None]
        langs, pi = langs[keep].reshape(-1, left - 1), pi[keep].reshape(-1, left - 1)
        pi = pi / pi.sum(1, keepdims=True)
        like = like[keep].reshape(len(active), left - 1, -1)
    return best


def mixtures(docs: np.ndarray, grams: np.ndarray, n_docs: int, p: np.ndarray) -> np.ndarray:
    """Chosen proportions (texts x languages); rows of texts without n-grams are 0."""
    out = np.zeros((n_docs, len(p)))
    table = np.bincount(docs * BUCKETS + grams, minlength=n_docs * BUCKETS)
    cell = np.flatnonzero(table)
    if not len(cell):
        return out
    count, owner, gram = table[cell].astype(float), cell // BUCKETS, cell % BUCKETS
    some, starts, cells = np.unique(owner, return_index=True, return_counts=True)
    at = np.arange(len(cell)) - np.repeat(starts, cells)
    like = p / p.mean(0)
    alone = np.stack([np.add.reduceat(count * x[gram], starts) for x in np.log(like)], 1)
    # texts of similar size are one array, padded to a width that only the
    # text's own size decides, so equal texts are summed alike in any batch
    unit = np.maximum(16, 2 ** np.ceil(np.log2(cells)).astype(int) // 16)
    widths = -(-cells // unit) * unit
    for width in np.unique(widths):
        same = np.flatnonzero(widths == width)
        step = max(1, _CELLS // (int(width) * len(p)))
        for group in (same[i : i + step] for i in range(0, len(same), step)):
            mine = np.concatenate([np.arange(starts[i], starts[i] + cells[i]) for i in group])
            row = np.repeat(np.arange(len(group)), cells[group])
            n, bucket = np.zeros((len(group), width)), np.zeros((len(group), width), np.int64)
            n[row, at[mine]], bucket[row, at[mine]] = count[mine], gram[mine]
            out[some[group]] = _choose(like[:, bucket].transpose(1, 0, 2).copy(), n, alone[group])
    return out


def _shares(part: pa.RecordBatch, langs: list[str], p: np.ndarray, letters: str = "letters"):
    """Shares of the languages, their first largest and its share of every row;
    rows without letters or n-grams have none."""
    n = part.num_rows
    shares = mixtures(*_ngrams(part.column(part.schema.get_field_index("text"))), n, p) if langs else np.zeros((n, 1))
    known = part.column(part.schema.get_field_index(letters)).to_numpy(zero_copy_only=False).astype(bool)
    return np.where(known[:, None], shares, 0)


def _predict(langs: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_SLICE):
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                shares = _shares(part, langs, p)
                top, score = shares.argmax(1), shares.max(1)
                names = np.array([*langs, "und"], object)[np.where(score > 0, top, len(langs))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), lists(shares[:, : len(langs)].ravel(), np.full(part.num_rows, len(langs)), pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score", "shares"],
                )

    return run


def _letters():
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters")


def _held(folds: int, held: int):
    """Whether a row is out of training; a null doc_id hashes as an empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held).alias("held_out")


def _dominant(langs: list[str], p: np.ndarray, least: float, letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_SLICE):
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                top = _shares(part, langs, p, letters).max(1)
                yield part.filter(pa.array((top > 0) & (top >= least))).drop_columns([letters])

    return run


def keep_identified(docs: DataFrame, least_share: float, folds: int = 4, held: int = 2) -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose main language has less
    than ``least_share`` of the text; all columns pass through one scan."""
    langs, p = fit(docs.where(~_held(folds, held)))
    (letters,) = fresh(docs, "letters")
    return docs.withColumn(letters, _letters()).mapInArrow(_dominant(langs, p, least_share, letters), docs.schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares); shares follow the learned
    languages in code-point order.

    Trains on rows with a lang whose crc32(doc_id as text) mod ``folds`` is not
    ``held``. Prediction sees the text alone. Every value of lang is learnt.

    Defined cases: null texts and texts without a letter are ``und`` with score
    0, and so is everything if nothing could be learnt; a null doc_id hashes as
    an empty text; ties go to the language first in code-point order; equal
    texts get equal predictions; repeated rows are kept and count as often; the
    columns of the result replace any of the same name; an empty table gives an
    empty result.
    """
    out = _held(folds, held)
    langs, p = fit(docs.where(~out))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, F.col("text").cast("string").alias("text"), _letters())
    return d.mapInArrow(_predict(langs, p), "doc_id long, held_out boolean, lang_pred string, score double, shares array<double>")
