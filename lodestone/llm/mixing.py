"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only.

Every source gets a target size; a document's expected copies are its source's
target over the source's size. The documents of a source are put in a fixed
order (by size, so that a sweep meets all sizes evenly), their expected copies
are summed up along it, one random offset per source is added, and a document
is emitted once for each integer boundary that its part of the sum crosses.

All documents of a source expect the same number of copies, so the running sum
before a document is its position times that number, and only positions are
needed. They are found without putting a source into one task: counts by
(source, size, one of 256 buckets of ids) give every bucket its first position,
and positions are summed up inside buckets. Rows that no column tells apart are
one counted row there, so a row repeated very often is no group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

SEED = "mix-1"
#: No word holds any of these (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Most rows that one row becomes in a step.
_STEP = 10_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _summed(rows: DataFrame, order: list[Column], before: dict[str, str], name: str) -> DataFrame:
    """``rows`` and, for each (new column, column), the sum of the column over
    all rows that ``order`` puts before; the rows are dealt by ranges, so one
    task sums a range, and only the sums of ranges meet in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), name)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{c}") for c in before.values()])
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{new}") for new, c in before.items()])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.col(f"__{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(new) for new, c in before.items()]
    return dealt.join(starts, "__range").select(*rows.columns, *sums)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, have the weights in turn, those of
    size 0 too. They share the sum of all sizes by weight; none gets more than
    ``cap`` times its size, and what is cut is shared again among the others by
    weight. With sources sorted by cap over weight the capped ones come first,
    so the level at which nothing is cut any more is found with running sums
    over the source table (one row a source), range by range.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    numbered = _summed(sizes.select("source", "source_size", F.lit(1).cast("long").alias("one")), by_name, {"number": "one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    s = numbered.select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most"))
    s = s.withColumn("ratio", F.col("most").cast("double") / F.col("w").cast("double"))
    s = _summed(s, [F.col("ratio"), *by_name], {"cut": "most", "spent": "w"}, "caps")
    total, all_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    s = s.withColumn("level", (F.lit(total or 0).cast("long") - F.col("cut")) / (F.lit(all_w or 0).cast("long") - F.col("spent")))
    fits = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))
    free = s.agg(F.min(fits)["level"]).first()[0]
    level = F.lit(float("inf") if free is None else free)
    return s.select("source", "source_size", F.least(level * F.col("w"), F.col("most").cast("double")).alias("target"))


def offset(source):
    """One number in [0, 1) for each source, the same in every run."""
    text = F.concat(F.lit(SEED), F.when(source.isNull(), F.lit("/null")).otherwise(F.concat(F.lit("/="), source)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _taken(d: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, size, doc_id, more, n, source_size, target, total) of every
    distinct (source, size, doc_id, more) of ``d``: n is the number of its rows,
    total what all of them take."""
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id"), F.col("more")).cast("string").cast("binary")), 1, 2), 16, 10).cast("int")
    d = table(d.groupBy("source", "size", "doc_id", "more").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket), "sizes")
    cells = d.groupBy("source", "size", "bucket").agg(F.sum("n").alias("n"))
    levels = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    want = table(targets(levels.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights=weights, cap=cap), "targets")
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, *keys: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    level = levels.select("source", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("level_at"))
    cell = cells.select("source", "size", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("cell_at"))
    start = cell.alias("c").join(level.alias("l"), same("c", "l", "source", "size")).select("c.source", "c.size", "c.bucket", (F.col("cell_at") + F.col("level_at")).alias("at"))
    start = start.alias("s").join(want.alias("t"), same("s", "t", "source")).select("s.*", "t.source_size", "t.target")
    upto = Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "more").rowsBetween(Window.unboundedPreceding, -1)
    ranked = d.withColumn("earlier", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    placed = ranked.alias("d").join(start.alias("s"), same("d", "s", "source", "size", "bucket")).select(
        "d.source", "d.size", "d.doc_id", "d.more", "d.n", "s.source_size", "s.target", (F.col("at") + F.col("earlier")).alias("first")
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda at: F.floor(at.cast("double") * each + offset(F.col("source")))
    return placed.withColumn("total", (crossed(F.col("first") + F.col("n")) - crossed(F.col("first"))).cast("long")).drop("first")


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row.

    Defined cases: null and empty texts have size 0 and take no copies of any
    effect; a null source is a source, the last; a source of total size 0 has
    its turn among the weights, target 0 and no copies; rows equal in doc_id,
    source and size share what they take as evenly as whole copies allow; an
    empty table gives an empty result. Columns beyond doc_id, text and source
    are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.lit(0).cast("long").alias("more"))
    taken = _taken(d, weights, cap)
    one = taken.where("n = 1").withColumn("copies", F.col("total"))
    # rows that repeat: in steps, as one row stands for all of them
    many = taken.where("n > 1").withColumn("step", F.explode(F.expr(f"sequence(0L, (n - 1) div {_STEP})")))
    many = many.withColumn("i", F.explode(F.expr(f"sequence(step * {_STEP}, least(n, (step + 1) * {_STEP}) - 1)")))
    many = many.withColumn("copies", F.expr("total div n + if(i < total % n, 1, 0)")).drop("step", "i")
    return one.unionByName(many).select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The mixed documents: every column of ``docs`` and ``copy`` (1, 2, ...),
    one row for each copy of a row.

    A row is identified by all its columns, so rows that share a doc_id or have
    none are mixed each for itself, and only fully equal rows share what they
    take: each gets the same number of copies, and what is left over is emitted
    from one of them. ``copy`` of the input is replaced.
    """
    docs = docs.drop("copy")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if _holds_map(f.dataType) else c for c, f in zip(columns, docs.schema.fields)]
    row = F.xxhash64(F.lit("row"), *plain, *[c.isNull() for c in columns])
    id_, mark, n, total, left, step, i = fresh(docs, "id_", "mark", "n", "total", "left", "step", "i")
    marked = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(mark, row)
    d = marked.select(F.col(id_).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.col(mark).alias("more"))
    taken = _taken(d, weights, cap).where("total > 0").select("doc_id", "more", "n", "total")
    taken = table(taken, "taken")

    def each(rows: DataFrame) -> DataFrame:
        """The rows of ``docs`` with what is taken of them."""
        named = rows.select(F.col("doc_id").alias("t_id"), F.col("more").alias("t_mark"), F.col("n").alias(n), F.col("total").alias(total))
        same = F.col(f"d.{id_}").eqNullSafe(F.col("t.t_id")) & (F.col(f"d.{mark}") == F.col("t.t_mark"))
        return marked.alias("d").join(named.alias("t"), same).select("d.*", f"t.{n}", f"t.{total}")

    out = each(taken).withColumn("copy", F.explode(F.expr(f"if({total} >= {n}, sequence(1, cast({total} div {n} as int)), array())"))).select(*columns, "copy")
    spares = taken.where("n > 1 AND total % n > 0")
    if spares.isEmpty():
        return out
    spare = each(spares).groupBy(id_, mark, n, total).agg(F.first(F.struct(*columns)).alias("r")).withColumn(left, F.expr(f"{total} % {n}"))
    spare = spare.withColumn(step, F.explode(F.expr(f"sequence(0L, ({left} - 1) div {_STEP})")))
    spare = spare.withColumn(i, F.explode(F.expr(f"sequence({step} * {_STEP}, least({left}, ({step} + 1) * {_STEP}) - 1)")))
    return out.unionByName(spare.select("r.*", F.expr(f"cast({total} div {n} as int) + 1").alias("copy")))


def _holds_map(kind: T.DataType) -> bool:
    """Whether a type is or holds a map, which has no hash of its own."""
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)
