"""Text functions without a built-in form, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC with white space made single spaces."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def sequence_edits(a, b) -> int:
    """Least insertions, deletions and substitutions between two sequences. A
    column of the table is two whole numbers, whose bits say where it rises and
    falls by one down the longer sequence; a step of the shorter one is a few
    operations on them (Myers 1999, Hyyro 2003)."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if not b:
        return len(a)
    at: dict = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    wanted, size = set(b), len(a) // 8 + 1
    equal = {}
    for w in wanted & at.keys():
        bits = bytearray(size)
        for i in at[w]:
            bits[i >> 3] |= 1 << (i & 7)
        equal[w] = int.from_bytes(bits, "little")
    every, last = (1 << len(a)) - 1, len(a) - 1
    rises, falls, edits = every, 0, len(a)
    for w in b:
        eq = equal.get(w, 0)
        across = ((((eq & rises) + rises) ^ rises) | eq) & every
        up, down = falls | ((across | rises) ^ every), rises & across
        edits += (up >> last & 1) - (down >> last & 1)
        up, down, x = (up << 1 | 1) & every, (down << 1) & every, eq | falls
        rises, falls = down | ((x | up) ^ every), up & x
    return edits


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, other: pd.Series) -> pd.Series:
    """Word edits a reference word; null without reference words."""
    def one(a, b):
        a, b = (a or "").split(), (b or "").split()
        return sequence_edits(a, b) / len(a) if a else None

    return pd.Series([one(a, b) for a, b in zip(reference, other)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def union_area(boxes: pd.Series) -> pd.Series:
    from ..operators.scorers import union_area as area

    return area(boxes)


def rotated_box(box: Column, width: Column, height: Column, degrees: Column) -> Column:
    """A (left, top, right, bottom) box of a page turned by 0, 90, 180 or 270
    degrees clockwise, in the coordinates of the turned page."""
    b = [box[i] for i in range(4)]
    return (
        F.when(degrees == 90, F.array(height - b[3], b[0], height - b[1], b[2])).when(degrees == 180, F.array(width - b[2], height - b[3], width - b[0], height - b[1]))
        .when(degrees == 270, F.array(b[1], width - b[2], b[3], width - b[0])).otherwise(F.array(*b))
    )


_ABSENT = object()


def changes(left: dict, right: dict) -> dict[str, list]:
    """What differs in two nested dicts, by dotted path, as [left, right], None
    where one side lacks it. Values of different types differ (1, 1.0, True)."""
    found, todo = {}, [((), left, right)]
    while todo:
        path, *pair = todo.pop()
        if all(isinstance(x, dict) for x in pair):
            todo += [((*path, str(k)), *(x.get(k, _ABSENT) for x in pair)) for k in {*pair[0], *pair[1]}]
        elif type(pair[0]) is not type(pair[1]) or pair[0] != pair[1]:
            found[".".join(path)] = [None if x is _ABSENT else x for x in pair]
    return dict(sorted(found.items()))
