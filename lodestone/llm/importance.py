"""Quality selection by importance resampling.

Two generative models over hashed word uni- and bigrams, one of target texts
(labelled good) and one of all raw texts, give every document the log ratio of
its probabilities under them. Adding independent Gumbel noise and taking the k
largest sums draws k documents without replacement with odds proportional to
the ratio.

The k-th largest key is found by radix selection over counts of the leading bits
of the keys (all 64 bits of the double, in the order of the numbers), so neither
a global sort nor a collection of keys is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, shingles, slices, table

BUCKETS = 1 << 14
#: Most labelled target rows that the target model is fitted on (those with the
#: smallest hashed ids, if there are more).
TARGET_ROWS = 20_000
SHARE = 0.5


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all words and word pairs of a batch."""
    words = Words(column)
    h, bounds = words.hashes(), words.bounds
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = shingles(h, 2) if len(h) > 1 else h[:0]
    inside = owner[1:] == owner[:-1] if len(h) > 1 else np.zeros(0, bool)
    docs = np.concatenate([owner, owner[: len(pairs)][inside]])
    return docs, (np.concatenate([h, pairs[inside]]) >> U64(50)).astype(np.int64)


def _count(targets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            docs, grams = _features(batch.column(batch.schema.get_field_index("text")))
            raw += np.bincount(grams, minlength=BUCKETS)
            good += np.bincount(grams[(named & np.isin(ids, targets))[docs]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, grams = _features(batch.column(batch.schema.get_field_index("text")))
            n = np.bincount(docs, minlength=batch.num_rows)
            # bucket order makes equal texts sum in the same order in any batch
            order = np.lexsort((grams, docs))
            sums = np.bincount(docs[order], ratio[grams[order]], minlength=batch.num_rows)
            key = sums + batch.column(1).to_numpy(zero_copy_only=False)
            cols = [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(sums), pa.array(key), pa.array(ordered(key))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tie", "n_features", "log_weight", "gumbel_key", "bits"])

    return run


def ordered(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles (no NaN); -0 is 0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


_STEP = 12


def _cut(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(v, left): the rows above v in a 64-bit column are fewer than ``k`` and
    lack ``left`` rows of those equal to v; left is 0 if these are to go in whole.
    ``k`` is between 1 and the number of rows."""
    flipped = F.col(column).bitwiseXOR(F.lit(-(2**63)).cast("long"))
    low = 64
    rows, prefix = df, 0
    while True:
        low = max(0, low - _STEP)
        part = F.shiftrightunsigned(flipped, low)
        # 2^12 groups at most
        counts = sorted(((r["p"] % 2**64, r["count"]) for r in rows.groupBy(part.alias("p")).count().collect()), reverse=True)
        for p, n in counts:
            if k <= n:
                break
            k -= n
        prefix = p
        if k == n or not low:  # whole prefixes suffice, or all bits are read
            v = (prefix << low) - 2**63
            return (v - 1 if k == n else v), (0 if k == n else k)
        rows = rows.where(part == F.lit(prefix - 2**64 if prefix >= 2**63 else prefix).cast("long"))


def top_k(df: DataFrame, columns: list[str], k: int, out: str) -> DataFrame:
    """``df`` with a boolean ``out``, true in the ``k`` rows that are largest by
    the 64-bit ``columns``. Rows equal in all of them are taken all or none, so
    the last column should tell all rows apart. ``df`` should be a written table."""
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    if k >= df.count():
        return df.withColumn(out, F.lit(True))
    chosen, same, rows = F.lit(False), F.lit(True), df
    for c in columns:
        v, k = _cut(rows, c, k)
        if v >= -(2**63):
            chosen = chosen | (same & (F.col(c) > F.lit(v)))
        else:
            chosen = chosen | same
        if not k:
            break
        same, rows = same & (F.col(c) == F.lit(v)), rows.where(F.col(c) == F.lit(v))
    return df.withColumn(out, chosen)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 1, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected) for every row.

    log_weight is the summed log ratio of the features; ``share`` of the rows are
    selected, exactly (rounded half to even); target rows are those with label
    quality 1 and not toxic.

    Defined cases: null and empty texts have no features and weight 0; a row
    without an id is never a target and draws its noise by its text; rows equal
    in id and text have one key and are separated by their place in the table;
    equal keys of other rows by a hash of id and text; with no target rows every
    weight is 0 and the draw is uniform; labels without a document are ignored;
    other columns are ignored; an empty table gives an empty result.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = np.array([r["id"] for r in good.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(target_rows).collect()], np.int64)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), "text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    uniform = (F.pmod(key, F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", (-F.ln(-F.ln(uniform))).alias("noise"), F.xxhash64("doc_id", "text").alias("tie"), "text")
    counts = d.select("doc_id", "text").mapInArrow(_count(ids), "bucket long, raw long, good long")
    raw, target = np.full(BUCKETS, 1.0), np.full(BUCKETS, 1.0)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # one row a bucket
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["good"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if len(ids) else np.zeros(BUCKETS)
    weighed = d.mapInArrow(_weigh(ratio), "doc_id long, tie long, n_features long, log_weight double, gumbel_key double, bits long")
    weighed = table(weighed.withColumn("place", F.monotonically_increasing_id()), "weights")
    return top_k(weighed, ["bits", "tie", "place"], round(weighed.count() * share), "selected").drop("bits", "tie", "place")
