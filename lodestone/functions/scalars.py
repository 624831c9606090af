"""Column functions used by the operators. All are built-in expressions, so
they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
BARE_WORD = r"[\p{L}\p{N}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Lower-cased Unicode words, underscore included."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def bare_words(text) -> Column:
    """Lower-cased Unicode words without underscore."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(BARE_WORD), F.lit(0))


def squeeze(text) -> Column:
    """Lower-cased text with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def page_id(document, number) -> Column:
    return F.format_string("%s_page_%04d", col(document), col(number).cast("int"))


def document_of(page, rule: str = "page") -> Column:
    """Document of a page id: before ``_page_NNNN``, or before the last ``_``."""
    p = col(page)
    if rule == "page":
        return F.regexp_extract(p, r"^(.+)_page_[0-9]+$", 1)
    return F.regexp_extract(p, r"^(.*)_[^_]*$", 1)


def page_number(page) -> Column:
    return F.regexp_extract(col(page), r"_page_([0-9]+)$", 1).cast("int")


def discount(rank) -> Column:
    return F.lit(1.0) / F.log2(col(rank).cast("double") + 1.0)


def gain(relevance) -> Column:
    return F.pow(F.lit(2.0), col(relevance).cast("double")) - 1.0


def dot3(a, b, c, w) -> Column:
    """w0*a + w1*b + w2*c, always summed in this order."""
    return F.lit(w[0]) * col(a) + F.lit(w[1]) * col(b) + F.lit(w[2]) * col(c) if not isinstance(w[0], Column) else w[0] * col(a) + w[1] * col(b) + w[2] * col(c)


def softmax3(a, b, c, temperature: float = 1.0) -> list[Column]:
    parts = [col(x) / temperature for x in (a, b, c)]
    top = F.greatest(*parts)
    e = [F.exp(x - top) for x in parts]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def half_even(x) -> Column:
    """Rounded to whole numbers, halves to even."""
    return F.rint(col(x)).cast("long")


def ratio(a, b, otherwise=None) -> Column:
    """a / b, or ``otherwise`` where b is zero."""
    out = F.try_divide(col(a), col(b))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def cleaned(text) -> Column:
    """Newline forms made one."""
    return F.regexp_replace(col(text), "\r\n?", "\n")


def printable_ratio(text) -> Column:
    t = col(text)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\x{FFFD}]", "")), F.length(t)), F.lit(0.0))


def length_feature(text, cap: int = 64) -> Column:
    return F.least(F.size(words(text)), F.lit(cap)) / float(cap)


def length_band(n) -> Column:
    n = col(n)
    return F.when(n <= 10, "short").when(n <= 18, "medium").otherwise("long")


def label_list(values) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(col(values))), "|")


def error_rate(reference, other) -> Column:
    """Character edits a reference character."""
    return F.try_divide(F.levenshtein(col(reference), col(other)), F.length(col(reference)))


def row_hash(*columns) -> Column:
    """SHA-256 of columns as canonical JSON (sorted names, nulls kept)."""
    names = sorted(columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def run_id(name: str, moment) -> Column:
    return F.concat(F.lit(f"RUN-{name}-"), F.date_format(col(moment), "yyyyMMdd'T'HHmmss'Z'"))


def run_moment(run) -> Column:
    return F.to_timestamp(F.regexp_extract(col(run), r"-([0-9]{8}T[0-9]{6})Z$", 1), "yyyyMMdd'T'HHmmss")
