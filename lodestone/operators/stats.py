"""Statistics over per-query values."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .ranking import average_rank, numbered

SEED = 20260820  # fixed value: the bootstrap's seed
TOLERANCE = 1e-12


def win_tie_loss(delta: str, tol: float = TOLERANCE) -> list[Column]:
    d = F.col(delta)
    return [F.count_if(d > tol).alias("wins"), F.count_if(F.abs(d) <= tol).alias("ties"), F.count_if(d < -tol).alias("losses")]


def top_share(df: DataFrame, delta: str, share: float = 0.05, out: str = "top_5pct_share") -> DataFrame:
    """One row: the part of all positive values that the largest ``share`` of the
    rows hold (at least one row). ``df`` has one row a query."""
    x = F.greatest(F.col(delta), F.lit(0.0))
    count = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"))
    # values of zero add nothing, wherever they stand
    d = numbered(df.select(x.alias("x")).where("x > 0"), [F.desc("x")], "r").crossJoin(F.broadcast(count))
    keep = F.col("r") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))
    return d.agg(F.coalesce(F.try_divide(F.sum(F.when(keep, F.col("x"))), F.max("s")), F.lit(0.0)).alias(out))


def paired(df: DataFrame, left: str, right: str, value: str, keys=("query_id",)) -> DataFrame:
    """(keys, delta): left minus right of a (method, keys, value) table."""
    a = df.where(F.col("method") == left).select(*keys, F.col(value).alias("a"))
    b = df.where(F.col("method") == right).select(*keys, F.col(value).alias("b"))
    return a.join(b, list(keys)).select(*keys, (F.col("a") - F.col("b")).alias("delta"))


def paired_summary(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    d = F.col(delta)
    sd = F.stddev_samp(d)
    return deltas.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), sd.alias("std_delta"),
        F.try_divide(F.avg(d), sd).alias("effect_size"), *win_tie_loss(delta),
    )


#: Rows of a range that is put in order.
RANGE_ROWS = 500_000


def quantiles(df: DataFrame, value: str, shares: dict[str, float], keys=()) -> DataFrame:
    """(keys, a column a share): exact quantiles of a number, interpolated between
    neighbours as ``percentile`` does, for a few groups whose values no task can
    hold. Nulls are left out; a group of nulls has null.

    Rows are dealt into ranges of their order, into more the more there are, and
    written; the counts of the ranges tell in which of them a group's places lie,
    and only those are counted by value and put in order.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).alias("__v"))
    d = scratch(d.repartitionByRange(max(1, -(-d.count() // RANGE_ROWS)), *keys, "__v").withColumn("__range", F.spark_partition_id()), "values")
    at = {n: F.lit(float(q)) * (F.col("__n") - 1) for n, q in shares.items()}
    holds = lambda place, first, end: (F.col(first) <= place) & (place < F.col(end))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    parts = d.groupBy(*keys, "__range").agg(F.count("__v").alias("__c")).withColumn("__n", F.sum("__c").over(group))
    parts = parts.withColumn("__to", F.sum("__c").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__from", F.col("__to") - F.col("__c"))
    wanted = F.col("__n") == 0
    for x in at.values():
        wanted = wanted | holds(F.floor(x), "__from", "__to") | holds(F.ceil(x), "__from", "__to")
    parts = parts.where(wanted).select(F.col("__range").alias("__own"), "__from", "__n", *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = F.col("__range") == F.col("__own")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    order = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(F.broadcast(parts), same).groupBy(*keys, "__range", "__from", "__n", "__v").agg(F.count("__v").alias("__c"))
    d = d.withColumn("__end", F.col("__from") + F.sum("__c").over(order)).withColumn("__first", F.col("__end") - F.col("__c"))
    own = lambda place: F.max(F.when(holds(place, "__first", "__end"), F.col("__v"))).cast("double")
    found = d.groupBy(*keys).agg(F.max("__n").alias("__n"), *[own(f(x)).alias(f"__{side}_{n}") for n, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    low, high = (lambda n: F.col(f"__low_{n}")), (lambda n: F.col(f"__high_{n}"))
    between = lambda n, x: (F.ceil(x) - x) * low(n) + (x - F.floor(x)) * high(n)
    return found.select(*keys, *[F.when(low(n) == high(n), low(n)).otherwise(between(n, x)).alias(n) for n, x in at.items()])


def seed_report(per_seed: DataFrame) -> DataFrame:
    """One row from (seed, query_id, delta): seeds are averaged within a query
    first, then queries are summarized."""
    per_query = per_seed.groupBy("query_id").agg(F.avg("delta").alias("delta"))
    return paired_summary(per_query).crossJoin(top_share(per_query, "delta"))


def seed_spread(per_seed: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of the seeds' mean deltas."""
    means = per_seed.groupBy("seed").agg(F.avg("delta").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("seeds"), F.avg("m").alias("mean_of_seeds"), F.stddev_samp("m").alias("std_of_seeds"))


def median_split(df: DataFrame, value: str, measure: str) -> DataFrame:
    """Means of ``measure`` over queries above and not above the median of ``value``."""
    middle = df.agg(F.median(value).alias("__middle"))
    d = df.crossJoin(F.broadcast(middle)).withColumn("band", F.when(F.col(value) > F.col("__middle"), "high").otherwise("low"))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("queries"), F.avg(measure).alias("mean"))


def spearman(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """(keys, rho): Pearson correlation of average ranks."""
    group = list(keys) or ["__all"]
    d = df if keys else df.withColumn("__all", F.lit(0))
    d = d.withColumn("__a", average_rank(a, group)).withColumn("__b", average_rank(b, group))
    return d.groupBy(*group).agg(F.corr("__a", "__b").alias("rho")).select(*keys, "rho")


#: Words of the generator that a task looks through at once.
RANGE_WORDS = 1 << 22
#: Numbers of a chunk of resamples.
CHUNK = 1 << 21


def _draws(seed: int, at: int, words: int, n: int) -> np.ndarray:
    """The numbers below ``n`` (under 2^32) that NumPy's default generator makes
    of its 32-bit words [at, at + words), ``at`` even: the state is advanced to
    the place, low halves come before high ones, and words that would favour some
    numbers are passed over."""
    state = np.random.PCG64(seed).advance(at // 2)
    w = state.random_raw(-(-words // 2)).view(np.uint32)[:words] if words else np.zeros(0, np.uint32)
    wide = w.astype(np.uint64) * np.uint64(n)
    return (wide >> np.uint64(32))[(wide & np.uint64(0xFFFFFFFF)) >= (2**32 - n) % n].astype(np.int64)


def _resampled(df: DataFrame, values: list[str], order: str, resamples: int, seed: int, statistic, words: int) -> DataFrame:
    """(v): ``statistic`` of the columns' resampled means, a row a resample.

    The resamples are those of one stream of NumPy's default generator over the
    rows in the given order. Ranges of the stream's words are counted by as many
    tasks, as a few words give no number; with these counts every task finds the
    place of its own resamples. A task holds the values, one row a query, and a
    chunk of numbers.
    """
    spark = df.sparkSession
    n = df.count()
    if not n:
        return spark.createDataFrame([], "v double")
    if n == 1:  # one number takes no word
        words_needed, ranges = 0, 1
    else:
        words_needed = resamples * n
        # a word gives no number with a chance below n / 2^32
        ranges = -(-int(words_needed * 1.001 / (1 - n / 2**32) + 1024) // words)

    def count(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(_draws(seed, i * words, words, n)) for i in ids])], names=["id", "n"])

    firsts = np.zeros(ranges + 1, np.int64)
    if words_needed:
        for r in spark.range(ranges, numPartitions=ranges).mapInArrow(count, "id long, n long").collect():  # a row a range
            firsts[r["id"] + 1] = r["n"]
        firsts = np.cumsum(firsts)
        if firsts[-1] < words_needed:
            raise ValueError("the generator's words do not suffice")
    each = max(1, -(-resamples // ranges))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i + 1)[0].values.to_numpy(zero_copy_only=False) for i in range(len(values))]
            for part in b.column(0).to_pylist():
                low, high = part * each, min(resamples, (part + 1) * each)
                place, held = int(np.searchsorted(firsts, low * n, "right")) - 1, np.zeros(0, np.int64)
                skip = low * n - int(firsts[place]) if words_needed else 0
                at, rows, out = place * words, max(1, CHUNK // n), []
                for r in range(low, high, rows):
                    size = min(rows, high - r) * n
                    while len(held) - skip < size and words_needed:
                        take = min(words, 2 * (-(-(size - len(held) + skip) // 2)) + 64)
                        held, at = np.concatenate([held, _draws(seed, at, take, n)]), at + take
                    pick = held[skip : skip + size].reshape(-1, n) if words_needed else np.zeros((size, 1), np.int64)
                    held, skip = held[skip + size :], 0
                    out.append(statistic(*[x[pick].mean(1) for x in columns]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["v"])

    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    one = df.select(order, *[F.col(v).cast("double").alias(v) for v in values]).agg(rows.alias("r")).select(*[F.col(f"r.{v}").alias(v) for v in values])
    parts = spark.range(-(-resamples // each), numPartitions=-(-resamples // each))
    return parts.crossJoin(F.broadcast(one)).mapInArrow(run, "v double")  # one row, as long as the query list


def _interval(v: DataFrame) -> DataFrame:
    return v.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def bootstrap_mean(df: DataFrame, value: str, resamples: int = 10_000, seed: int = SEED, order: str = "query_id", words: int = RANGE_WORDS) -> DataFrame:
    """One row (low, high): 95 % percentile interval of the mean with NumPy's
    generator, over the rows in the given order. One row a query."""
    return _interval(_resampled(df, [value], order, resamples, seed, lambda x: x, words))


def _below(seed: int, n: int):
    """A function that gives the next numbers that the standard library's
    generator draws below ``n`` (under 2^32): its words' leading bits, less those
    too large."""
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    held = np.zeros(0, np.int64)

    def take(size: int) -> np.ndarray:
        nonlocal held
        parts, have = [held], len(held)
        while have < size:
            x = words.random_raw(max(1024, (size - have) * 5 // 4)) >> np.uint64(32 - n.bit_length())
            parts.append(x[x < n].astype(np.int64))
            have += len(parts[-1])
        out = np.concatenate(parts)
        held = out[size:]
        return out[:size]

    return take


def paired_bootstrap(df: DataFrame, value: str = "delta", resamples: int = 10_000, seed: int = SEED, tol: float = TOLERANCE, order: str = "query_id") -> DataFrame:
    """One row (mean_delta, low, high, wins, ties, losses): 95 % percentile
    interval with the standard library's generator, over the rows in the given
    order. One row a query."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        stream, n = _below(seed, len(x)), len(x)
        rows = max(1, CHUNK // max(n, 1))
        means = np.concatenate([x[stream(min(rows, resamples - i) * n)].reshape(-1, n).mean(1) for i in range(0, resamples, rows)])
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"mean_delta": [x.mean()], "low": [low], "high": [high], "wins": [int((x > tol).sum())], "ties": [int((np.abs(x) <= tol).sum())], "losses": [int((x < -tol).sum())]})

    return df.select(order, value).groupBy().applyInPandas(run, "mean_delta double, low double, high double, wins long, ties long, losses long")


def bootstrap_ratio(df: DataFrame, numerator: str, denominator: str, resamples: int = 10_000, seed: int = SEED, order: str = "query_id", words: int = RANGE_WORDS) -> DataFrame:
    """One row (low, high): interval of the ratio of means, 1 where the
    denominator vanishes."""
    ratio = lambda x, y: np.where(np.abs(y) > 1e-15, x / np.where(y == 0, 1, y), 1.0)
    return _interval(_resampled(df, [numerator, denominator], order, resamples, seed, ratio, words))


#: Numbers hashed at once, so that they stay in a core's cache, and rows of a block of values.
HASHED, BLOCK = 1 << 14, 1 << 16
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_head(words: list) -> np.ndarray:
    """The first 32 bits of the MD5 of many messages of one block each, as the
    number that its first eight hex digits are. ``words``: the block's 16 words,
    arrays or, where all messages agree, numbers."""
    size = max(np.size(w) for w in words)
    a, b, c, d = (np.full(size, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, y = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three rounds do not reach the first word
        if i < 32:  # the second sixteen as the first, with d, b and c for b, c and d
            u, v, w = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(v, w, f)
            np.bitwise_and(f, u, f)
            np.bitwise_xor(f, w, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        word, sine = words[g], _SINES[i]
        if isinstance(word, np.ndarray):
            np.add(f, word, f)
        else:
            sine = (sine + int(word)) & 0xFFFFFFFF
        np.add(f, np.uint32(sine), f)
        np.add(f, a, f)
        np.left_shift(f, np.uint32(_TURNS[i]), y)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), f)
        np.bitwise_or(f, y, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _hashed_draws(low: int, high: int, resamples: range):
    """(b, draws) for every resample: the first 32 bits of md5("b:i") for i from
    ``low`` to ``high``, numbers of equally many digits."""
    numbers, digits = np.arange(low, high), len(str(low))
    held, before = None, None
    for b in resamples:
        head = f"{b}:".encode()
        if len(head) != before:  # only the head differs between resamples of as many digits
            block = np.zeros((len(numbers), 64), np.uint8)
            for j in range(digits):
                block[:, len(head) + j] = numbers // 10 ** (digits - 1 - j) % 10 + 48
            block[:, len(head) + digits] = 128
            words = np.ascontiguousarray(block.view("<u4").T)
            last = (len(head) + digits) // 4
            held, before = [words[j] if j <= last else 0 for j in range(16)], len(head)
            held[14] = 8 * (len(head) + digits)
        fixed = np.frombuffer(head.ljust(64, b"\0"), "<u4")
        with np.errstate(over="ignore"):
            yield b, _md5_head([w + f if f else w for w, f in zip(held, fixed)])


def bootstrap_hashed(df: DataFrame, value: str, resamples: int = 200, order: str = "query_id") -> DataFrame:
    """One row (low, high) like bootstrap_mean, with draws from a hash instead of
    a generator: the same on any engine with MD5. Null values are left out of a
    mean.

    Values are numbered in ranges and written as blocks. A task reads the blocks
    (8 bytes a query), makes the draws of its own resamples a slice at a time and
    gives a row a resample: no draw becomes a row, nothing passes through the
    driver."""
    spark = df.sparkSession
    d = numbered(df.select(F.col(order).alias("k"), F.col(value).cast("double").alias("x")), ["k"], "i").withColumn("i", F.col("i") - 1)
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))
    blocks = scratch(d.groupBy(F.expr(f"i div {BLOCK}").alias("block")).agg(rows.alias("r")).select("block", "r.x"), "values")
    n = blocks.agg(F.sum(F.size("x"))).first()[0] or 0
    parts = min(resamples, max(1, n * resamples >> 22), 4 * spark.sparkContext.defaultParallelism)
    if not parts:
        return _interval(spark.createDataFrame([], "v double"))

    def run(batches):
        held = {}
        for batch in batches:
            for part, block, x in zip(*(batch.column(c) for c in range(3))):
                held.setdefault(part.as_py(), {})[block.as_py()] = x.values
        for part, found in held.items():
            x = pa.chunked_array([found[b] for b in sorted(found)], pa.float64())
            there = None if not x.null_count else x.is_valid().to_numpy().astype(float)
            x = x.fill_null(0.0).to_numpy() if x.null_count else x.to_numpy()
            own = range(part * resamples // parts, (part + 1) * resamples // parts)
            sums, counts = np.zeros(len(own)), np.zeros(len(own))
            edges = sorted({0, len(x), *range(0, len(x), HASHED), *(10**j for j in range(1, 20) if 10**j < len(x))})
            for low, high in zip(edges, edges[1:]):
                for b, draws in _hashed_draws(low, high, own):
                    pick = draws % np.uint32(len(x)) if len(x) < 1 << 32 else draws
                    sums[b - own.start] += x[pick].sum()
                    counts[b - own.start] += high - low if there is None else there[pick].sum()
            yield pa.RecordBatch.from_arrays([pa.array([s / c if c else None for s, c in zip(sums, counts)], pa.float64())], names=["v"])

    each = spark.range(0, parts, 1, parts).select(F.col("id").alias("part"))
    return _interval(each.crossJoin(blocks.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(run, "v double"))
