"""Preference formatting of chosen and rejected conversations, in DataFrame
operations only.

The longest common prefix of turns is rendered once as the prompt; what follows
in each conversation becomes its completion, with a mask that is set where a
model should learn (the assistant's turns). The result pairs the completions:
one row a pair, or for very long conversations one row for each stretch of
``STRETCH`` turn numbers, so that no conversation, however long, is gathered
into one row or task. Both sides of a stretch come together in one grouping;
the pair's shared length is a minimum over its stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Turn numbers of one row.
STRETCH = 64


def render(role, text):
    """One turn as training text. A null role reads as unknown, a null text as empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def _side(side: DataFrame, name: str) -> DataFrame:
    d = side.select(F.col("pair_id").cast("long").alias("pair_id"), F.lit(name).alias("side"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return d.where("pair_id IS NOT NULL AND turn IS NOT NULL")


def _of(name: str, extra=None) -> Column:
    """The messages of one side (less its name), in the order of turn, role and text."""
    keep = lambda m: (m["side"] == name) if extra is None else (m["side"] == name) & extra(m)
    return F.transform(F.filter("messages", keep), lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text")))


def format_preferences(chosen: DataFrame, rejected: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(pair_id, part, prompt, chosen, chosen_mask, rejected, rejected_mask,
    n_prompt) from two tables of (pair_id, turn, role, text).

    prompt is the rendered shared beginning; chosen and rejected are arrays of
    the rendered messages that follow in each conversation, the masks arrays
    beside them: 1 where a message is to be learnt (the assistant's), else 0.
    n_prompt is the pair's number of shared leading turns. part numbers the rows
    of a pair from 0 in the order of turns; a row covers ``stretch`` turn
    numbers, so conversations of fewer turns are one row, and the rows of longer
    ones are to be read one after another.

    Defined cases: turns are aligned by their number less the first of their own
    conversation; rows without pair_id or turn are left out; fully equal rows of
    a turn count once; different rows of one turn are several messages of it,
    read in the order of role and text (null first), and the turn is shared if
    all of them are; null roles and texts compare equal to each other; pairs of
    which one side is missing are left out; conversations that are equal
    throughout have no completions; one that ends inside the other has none on
    its side; empty tables give an empty result. Other columns are ignored.
    """
    both = _side(chosen, "chosen").unionByName(_side(rejected, "rejected"))
    turn = lambda side: F.min(F.when(F.col("side") == side, F.col("turn")))
    begin = both.groupBy("pair_id").agg(turn("chosen").alias("a"), turn("rejected").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # a written table, so that the join may split a pair with very many turns
    begin = table(begin, "begins")
    moved = both.join(begin, "pair_id").withColumn("turn", F.col("turn") - F.when(F.col("side") == "chosen", F.col("a")).otherwise(F.col("b")))
    message = F.struct("side", "turn", "role", "text")
    rows = moved.groupBy("pair_id", F.expr(f"turn div {stretch}").alias("part")).agg(F.array_sort(F.collect_set(message)).alias("messages"))
    good, bad = _of("chosen"), _of("rejected")
    turns = F.array_distinct(F.transform("messages", lambda m: m["turn"]))
    # the first turn whose messages differ
    apart = F.array_min(F.transform(F.concat(F.array_except(good, bad), F.array_except(bad, good)), lambda m: m["turn"]))
    rows = table(rows.withColumn("apart", F.when(good != bad, apart)), "stretches")
    split = table(rows.groupBy("pair_id").agg(F.min("apart").alias("split")), "splits")
    n = F.sum(F.size(F.filter(turns, lambda t: F.col("split").isNull() | (t < F.col("split")))))
    split = table(rows.join(split, "pair_id").groupBy("pair_id", "split").agg(n.cast("long").alias("n_prompt")), "splits")
    shared = lambda m: F.col("split").isNull() | (m["turn"] < F.col("split"))
    after = lambda m: ~shared(m)
    rendered = lambda x: F.transform(x, lambda m: render(m["role"], m["text"]))
    mask = lambda x: F.transform(x, lambda m: F.when(m["role"].eqNullSafe(F.lit("assistant")), 1).otherwise(0).cast("long"))
    return rows.join(split, "pair_id").select(
        "pair_id", "part", F.array_join(rendered(_of("chosen", shared)), "").alias("prompt"),
        rendered(_of("chosen", after)).alias("chosen"), mask(_of("chosen", after)).alias("chosen_mask"),
        rendered(_of("rejected", after)).alias("rejected"), mask(_of("rejected", after)).alias("rejected_mask"), "n_prompt",
    )
