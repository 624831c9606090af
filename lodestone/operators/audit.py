"""Duplicate, leakage, alias and parity audits.

Duplicates are grouped by content hash, not paired: pairs are an explicit
request (``duplicate_pairs``), and leakage needs only the splits of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import page_id, squeeze
from .ranking import hash_numbers

#: Alias forms in order of precedence, with their reasons.
ALIAS_FORMS = (
    (r"^(.+)_page_([0-9]+)$", "canonical_form"),
    (r"^(.+)#page=([0-9]+)$", "fragment"),
    (r"^(.+)[:/]([0-9]+)$", "separator"),
    (r"^(.+)_([0-9]+)$", "numbered"),
)
OPEN_SPLITS = ("shared", "unassigned")


def page_manifest(pages: DataFrame) -> DataFrame:
    """``pages`` with content_sha256, and checks of the id: its form and whether
    another page has it in other letter case."""
    same = Window.partitionBy(F.lower("page_id"))
    return pages.withColumns({
        "content_sha256": F.sha2(F.col("content"), 256), "canonical": F.col("page_id") == page_id("document_id", "page_number"),
        "case_twins": F.count(F.lit(1)).over(same) - 1,
    })


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """(content_sha256, pages, splits, group_id) of contents on several pages."""
    g = pages.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_set("split")).alias("splits")).where("pages > 1")
    return hash_numbers(g, F.col("content_sha256"), [], "__at").withColumn("group_id", F.format_string("DUP-%04d", "__at")).drop("__at")


def duplicate_pairs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(left_id, right_id, left_split, right_split) of pages with equal content."""
    a = pages.select("content_sha256", F.col(key).alias("left_id"), F.col("split").alias("left_split"))
    b = pages.select("content_sha256", F.col(key).alias("right_id"), F.col("split").alias("right_split"))
    return a.join(b, "content_sha256").where("left_id < right_id").drop("content_sha256")


def duplicate_members(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(content_sha256, member, representative) of contents on several pages: each
    page with the smallest of its content. ``duplicate_pairs`` has the square of
    that; a popular content should not be expanded."""
    g = pages.groupBy("content_sha256").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return pages.select("content_sha256", F.col(key).alias("member")).join(g, "content_sha256")


def leaks(groups: DataFrame) -> DataFrame:
    """Duplicate groups whose pages lie in several closed splits."""
    closed = F.filter("splits", lambda s: ~s.isin(*OPEN_SPLITS))
    return groups.withColumn("closed", closed).where(F.size("closed") > 1)


def normalize_alias(reference: str = "reference") -> DataFrame:
    """(canonical id, reason) struct of a reference, by the first form that fits."""
    stem = F.regexp_replace(F.trim(reference), r"\.[^./]+$", "")
    out = F.struct(F.lit(None).cast("string").alias("page"), F.lit("unresolved").alias("reason"))
    for form, reason in reversed(ALIAS_FORMS):
        page = page_id(F.regexp_extract(stem, form, 1), F.regexp_extract(stem, form, 2))
        out = F.when(stem.rlike(form), F.struct(page.alias("page"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def resolve_aliases(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """(alias_id, reference, page_id, reason, resolved): the first reference of
    an alias counts; targets must exist."""
    d = aliases.withColumn("a", normalize_alias("reference"))
    first = d.withColumn("__r", F.row_number().over(Window.partitionBy("alias_id").orderBy("position"))).where("__r = 1")
    known = pages.select(F.col("page_id").alias("known")).distinct()
    out = first.join(known, F.col("a.page") == F.col("known"), "left")
    return out.select("alias_id", "reference", F.col("a.page").alias("page_id"), F.col("a.reason").alias("reason"), F.col("known").isNotNull().alias("resolved"))


def qrel_consistency(qrels: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: valid and orphan queries, missing targets, unreferenced pages. A
    query with a missing target, or without a valid one, is an orphan."""
    known = pages.select("page_id").distinct()
    hit = qrels.where("relevance > 0").select("query_id", "page_id").distinct().join(known.withColumn("k", F.lit(1)), "page_id", "left")
    per = hit.groupBy("query_id").agg(F.count("k").alias("valid"), F.count_if(F.col("k").isNull()).alias("missing"))
    base = per.agg(
        F.count_if((F.col("valid") > 0) & (F.col("missing") == 0)).alias("valid_queries"),
        F.count_if((F.col("valid") == 0) | (F.col("missing") > 0)).alias("orphan_queries"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_targets"),
    )
    unused = known.join(qrels.select("page_id").distinct(), "page_id", "left_anti").agg(F.count(F.lit(1)).alias("unreferenced_pages"))
    return base.crossJoin(unused)


def overlap_report(df: DataFrame, text: str, split: str) -> DataFrame:
    """One row: texts and normalized texts that lie in several splits."""
    exact = df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count_distinct(split).alias("s"), F.count(F.lit(1)).alias("n"))
    loose = df.groupBy(F.sha2(squeeze(text), 256).alias("h")).agg(F.count_distinct(split).alias("s"), F.count(F.lit(1)).alias("n"))
    a = exact.agg(F.count_if(F.col("s") > 1).alias("exact_overlaps"), F.count_if(F.col("n") > 1).alias("exact_groups"))
    b = loose.agg(F.count_if(F.col("s") > 1).alias("loose_overlaps"), F.count_if(F.col("n") > 1).alias("loose_groups"))
    return a.crossJoin(b)


def asset_identity(assets: DataFrame) -> DataFrame:
    """(page_id, state, canonical_path, aliases): one hash makes a page, with its
    smallest path; several hashes are a conflict."""
    g = assets.groupBy("page_id").agg(F.count_distinct("asset_sha256").alias("hashes"), F.min("asset_path").alias("canonical_path"), F.sort_array(F.collect_set("asset_path")).alias("paths"))
    return g.select("page_id", F.when(F.col("hashes") == 1, "canonical").otherwise("conflict").alias("state"), "canonical_path", F.array_remove("paths", F.col("canonical_path")).alias("aliases"))


def binding_report(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys missing on either side and keys whose values differ."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full")
    return j.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("bound"),
        F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unexpected"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("different"),
    )


def fingerprint_of(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("row_count"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("total")]


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that does not depend on row order: count, xor and sum of row hashes."""
    return df.agg(*fingerprint_of(columns))


def prediction_parity(left: DataFrame, right: DataFrame, score: str = "score", keys=("query_id",)) -> DataFrame:
    """One row: largest score difference, unmatched rows, queries ranked differently."""
    from .ranking import rank_of

    keys = list(keys)
    a = left.select(*keys, "page_id", F.col(score).alias("a"), rank_of(score, keys).alias("ra"))
    b = right.select(*keys, "page_id", F.col(score).alias("b"), rank_of(score, keys).alias("rb"))
    j = a.join(b, [*keys, "page_id"], "full")
    off = F.count_if(F.col("a").isNull() | F.col("b").isNull())
    per = j.groupBy(*keys).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"), off.alias("u"), F.max((~F.col("ra").eqNullSafe(F.col("rb"))).cast("int")).alias("moved"))
    return per.agg(F.max("d").alias("max_difference"), F.sum("u").alias("unmatched"), F.sum("moved").cast("long").alias("reordered_queries"))


def missed_relevant(scores: DataFrame, qrels: DataFrame, pool: DataFrame, k: int, channels) -> DataFrame:
    """(query_id, page_id, channel, rank, raw_score, cutoff) of positives outside
    the pool: how far each channel was from taking them."""
    from .ranking import long_channels

    w = Window.partitionBy("query_id", "channel")
    d = long_channels(scores, channels).withColumn("rank", F.row_number().over(w.orderBy(F.desc("raw_score"), "page_id")))
    d = d.withColumn("cutoff", F.max(F.when(F.col("rank") == k, F.col("raw_score"))).over(w))
    out = qrels.where("relevance > 0").select("query_id", "page_id").distinct().join(pool.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    return d.join(out, ["query_id", "page_id"])


def top_list_join(top_lists: DataFrame, candidates: DataFrame, tol: float = 1e-12) -> DataFrame:
    """One row: top-list rows without a candidate, and with another raw score
    than the candidate's column of that channel (wide rows)."""
    from .ranking import long_channels

    wide = long_channels(candidates).withColumnRenamed("raw_score", "own")
    j = top_lists.join(wide, ["query_id", "page_id", "channel"], "left")
    return j.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("own").isNull()).alias("without_candidate"), F.count_if(F.abs(F.col("own") - F.col("raw_score")) > tol).alias("other_score"))


def component_parity(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(component, equal): whether tables of the same name have the same rows."""
    spark = next(iter(left.values())).sparkSession
    rows = []
    for name in sorted({*left, *right}):
        a, b = (t[name] if name in t else None for t in (left, right))
        same = a is not None and b is not None and sorted(a.columns) == sorted(b.columns)
        rows.append((name, bool(same and fingerprint(a, sorted(a.columns)).first() == fingerprint(b, sorted(a.columns)).first())))
    return spark.createDataFrame(rows, "component string, equal boolean")


def probe_case(rows: DataFrame, pages: int) -> DataFrame:
    """A label-free timing case: ``pages`` evenly spaced pages a query, with two
    made-up positives (the first and the middle one)."""
    from .contracts import label_free

    w = Window.partitionBy("query_id")
    d = label_free(rows).withColumn("__i", F.row_number().over(w.orderBy("page_id")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    slots = F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (pages - 1)))
    d = d.where(F.array_contains(slots, F.col("__i"))).withColumn("__r", F.row_number().over(w.orderBy("page_id")) - 1)
    return d.withColumns({"stage1_score": F.lit(0.0), "relevance": F.col("__r").isin(0, pages // 2).cast("double")}).drop("__i", "__n", "__r")


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of a table."""
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(fields, "position int, name string, type string, nullable boolean")


def record_limits(rows: DataFrame, most: int = 600) -> DataFrame:
    """One row: queries with more than ``most`` pages, or with a page twice."""
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("d"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") > most).alias("too_long"), F.count_if(F.col("n") != F.col("d")).alias("repeated"))
