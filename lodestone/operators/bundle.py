"""The contract of a published bundle: raw scores, normalized scores with branch
ranks, an audit row a query, and facts about the whole.

Rules are of three kinds. A page rule is a condition on the rows that both tables
have of a page; a query rule is one on facts of a query; a table rule compares a
number of the whole with what was promised. All tables are brought together by
one shuffle on the query: pages, windows for the normalization and queries are
all grouped inside it. The outcome is one row a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .contracts import BRANCHES, KEY, require_columns

SCORES = [f"{b}_score" for b in BRANCHES]
PAGE = [*KEY, "page_id"]
#: The least range that is scaled, and the difference allowed.
FLAT, TOLERANCE = 1e-15, 1e-12


def with_places(files: DataFrame) -> DataFrame:
    """A scan with the place of each row in its file, as ``file`` and ``place``."""
    return files.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def _side(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    held = F.struct(*columns)
    return df.select(*KEY, F.col("page_id") if name != "audit" else F.lit(None).cast("string").alias("page_id"), F.lit(name).alias("side"), held.alias(name))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def page_rules(provenance: str | None) -> dict[str, Column]:
    """Conditions on (raw, score, n_raw, n_score, low_*, high_*) of a page."""
    raw, score = (lambda c: F.col(f"raw.{c}")), (lambda c: F.col(f"score.{c}"))
    both = F.col("n_raw").cast("boolean") & F.col("n_score").cast("boolean")
    fresh = {s: F.when(F.col(f"high_{s}") - F.col(f"low_{s}") <= FLAT, 0.0).otherwise((raw(s) - F.col(f"low_{s}")) / (F.col(f"high_{s}") - F.col(f"low_{s}"))) for s in SCORES}
    in_raw, in_score = F.col("n_raw") == 0, F.col("n_score") == 0  # what a table lacks is told by key_sets_match alone
    rules = {
        "raw_keys_unique": F.col("n_raw") <= 1, "score_keys_unique": F.col("n_score") <= 1, "key_sets_match": both,
        "page_ids_clean": (F.col("page_id") == F.trim("page_id")) & (F.col("page_id") != ""),
        "common_values_match": ~both | (raw("source").eqNullSafe(score("source")) & raw("relevance").eqNullSafe(score("relevance"))),
        "raw_numeric_finite": in_raw | _all([finite(raw(c)) for c in ("relevance", *SCORES)]),
        "score_numeric_finite": in_score | _all([finite(score(c)) for c in ("relevance", *SCORES)]),
        "relevance_nonnegative": in_raw | (raw("relevance") >= 0), "normalized_scores_bounded": in_score | _all([score(s).between(0, 1) for s in SCORES]),
        "branch_ranks_valid": in_score | _all([F.col(f"rank_{b}") >= 1 for b in BRANCHES]),
        "normalization_matches_raw": ~both | _all([F.abs(fresh[s] - score(s)) <= TOLERANCE for s in SCORES]),
    }
    if provenance is not None:
        rules["candidate_provenance_matches"] = in_raw | (raw("candidate_provenance") == provenance)
    return rules


def query_rules(cap: int | None, places: bool) -> dict[str, Column]:
    """Conditions on the facts of a query."""
    n = F.col("scores")
    rules = {
        "branch_rank_permutation": (n == 0) | _all([(F.col(f"{b}_least") == 1) & (F.col(f"{b}_most") == n) & (F.size(f"{b}_ranks") == n) for b in BRANCHES]),
        "audit_row_there": F.col("audits") == 1, "audit_has_relevant_candidates": (F.col("audits") == 0) | (F.col("selected") > 0), "has_relevant_candidate": F.col("relevant") > 0,
    }
    if cap is not None:
        rules["candidate_cap"] = (n > 0) & (n <= cap)
    if places:
        rules["rows_contiguous"] = (n == 0) | ((F.size("files") == 1) & (F.col("last") - F.col("first") + 1 == n))
        rules["pages_in_order"] = (n == 0) | (F.col("pages_by_place") == F.array_sort("pages_by_place"))
    return rules


def check(
    raw: DataFrame, scores: DataFrame, audit: DataFrame, coverage: DataFrame, *, rows: int, queries: int, provenance: str | None = None, cap: int | None = None, keys: str | None = None
) -> DataFrame:
    """(rule, level, checked, broken, example) of a bundle; a rule holds where
    broken is 0, and example is the first key that breaks it.

    ``rows``, ``queries`` and ``keys`` (an order-free digest of the keys of the
    score table, see ``key_digest``) are what was promised. ``scores`` may come
    ``with_places``; then rows of a query must stand together and in order.
    ``coverage`` is one row with final_coverage and minimum_required. A condition
    that is null does not hold. Tables without a needed column raise.
    """
    places = "place" in scores.columns
    require_columns(raw, [*PAGE, "source", "relevance", *SCORES, *(["candidate_provenance"] if provenance is not None else [])], "raw scores")
    require_columns(scores, [*PAGE, "source", "relevance", *SCORES, "branch_ranks"], "scores")
    require_columns(audit, [*KEY, "relevant_selected"], "audit")
    sides = [
        _side(raw, "raw", ["source", "relevance", *SCORES, *(["candidate_provenance"] if provenance is not None else [])]),
        _side(scores, "score", ["source", "relevance", *SCORES, "branch_ranks", *(["file", "place"] if places else [])]), _side(audit, "audit", ["relevant_selected"]),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).repartition(*KEY)  # the one shuffle of rows
    is_ = lambda side: F.col("side") == side
    pages = together.groupBy(*PAGE).agg(
        F.count_if(is_("raw")).alias("n_raw"), F.count_if(is_("score")).alias("n_score"), F.count_if(is_("audit")).alias("n_audit"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("raw", "score", "audit")],
    )
    # ranks are read and rules judged once a row, whatever reads them
    pages = pages.withColumn("ranks", F.from_json("score.branch_ranks", ", ".join(f"{b} INT" for b in BRANCHES)))
    w = Window.partitionBy(*KEY)
    pages = pages.withColumns({f"rank_{b}": F.col(f"ranks.{b}") for b in BRANCHES} | {f"low_{s}": F.min(f"raw.{s}").over(w) for s in SCORES} | {f"high_{s}": F.max(f"raw.{s}").over(w) for s in SCORES})
    page = page_rules(provenance)
    real = F.col("n_raw") + F.col("n_score") > 0
    breaks = lambda rule: real & ~F.coalesce(rule, F.lit(False))
    pages = pages.withColumns({f"b:{r}": breaks(rule) for r, rule in page.items()} | {"name": F.concat_ws("/", *PAGE)})
    facts = [
        F.sum(F.when(real, F.col("n_raw")).otherwise(0)).alias("raws"), F.sum("n_score").alias("scores"), F.sum("n_audit").alias("audits"), F.max("audit.relevant_selected").alias("selected"),
        F.count_if(real).alias("pages"), F.count_if((F.col("n_score") > 0) & (F.col("score.relevance") > 0)).alias("relevant"), F.bit_xor(F.when(F.col("n_score") > 0, F.xxhash64(*PAGE))).alias("xor"), F.sum(F.when(F.col("n_score") > 0, F.pmod(F.xxhash64(*PAGE), F.lit(1_000_003)))).alias("total"),
        *[x for b in BRANCHES for x in (F.min(f"rank_{b}").alias(f"{b}_least"), F.max(f"rank_{b}").alias(f"{b}_most"), F.collect_set(f"rank_{b}").alias(f"{b}_ranks"))],
        *[x for r in page for x in (F.count_if(f"b:{r}").alias(f"n:{r}"), F.min(F.when(F.col(f"b:{r}"), F.col("name"))).alias(f"e:{r}"))],
    ]
    if places:
        by_place = F.transform(F.array_sort(F.collect_list(F.when(F.col("n_score") > 0, F.struct("score.place", "page_id")))), lambda x: x["page_id"])
        facts += [F.collect_set("score.file").alias("files"), F.min("score.place").alias("first"), F.max("score.place").alias("last"), by_place.alias("pages_by_place")]
    per = pages.groupBy(*KEY).agg(*facts)
    query = query_rules(cap, places)
    broken = lambda rule: ~F.coalesce(rule, F.lit(False))
    key = F.concat_ws("/", *KEY)
    one = per.agg(
        F.sum("raws").alias("raws"), F.sum("scores").alias("scores"), F.sum("pages").alias("pages"), F.count_if(F.col("scores") > 0).alias("queries"), F.count(F.lit(1)).alias("all_queries"),
        F.bit_xor("xor").alias("xor"), F.sum("total").alias("total"),
        *[x for r in page for x in (F.sum(f"n:{r}").alias(f"n:{r}"), F.min(f"e:{r}").alias(f"e:{r}"))],
        *[x for r, rule in query.items() for x in (F.count_if(broken(rule)).alias(f"n:{r}"), F.min(F.when(broken(rule), key)).alias(f"e:{r}"))],
    )
    one = one.crossJoin(coverage.select("final_coverage", "minimum_required"))
    digest = F.concat_ws(":", F.col("scores").cast("string"), F.col("xor").cast("string"), F.col("total").cast("string"))
    table = {
        "row_count_matches": (F.col("raws") == rows) & (F.col("scores") == rows), "query_count_matches": F.col("queries") == queries,
        "coverage_gate": F.col("final_coverage") >= F.col("minimum_required"), **({"key_digest_matches": digest == keys} if keys is not None else {}),
    }
    row = lambda rule, level, checked, n, example: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.coalesce(checked, F.lit(0)).cast("long").alias("checked"), F.coalesce(n, F.lit(0)).cast("long").alias("broken"), example.cast("string").alias("example"))
    out = [row(r, "page", F.col("pages"), F.col(f"`n:{r}`"), F.col(f"`e:{r}`")) for r in page] + [row(r, "query", F.col("all_queries"), F.col(f"`n:{r}`"), F.col(f"`e:{r}`")) for r in query]
    out += [row(r, "table", F.lit(1), broken(rule).cast("int"), F.lit(None)) for r, rule in table.items()]
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def key_digest(scores: DataFrame) -> str:
    """What ``check`` compares ``keys`` with."""
    h = F.xxhash64(*PAGE)
    r = scores.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("t")).first()
    return f"{r['n']}:{r['x']}:{r['t']}"
