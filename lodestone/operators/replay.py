"""Replay of page extraction records against the schedule they were made from.

The schedule is rebuilt from the pages and a seed; it must give the order and the
digest that were declared. Each record is then folded again: the states that it
went through, the text that they lead to and its hashes, and the link of the
chain that ties it to the record before it in its document. A record is given
with the first rule that it breaks. Pages and records meet by page, and links by
document and number; nothing is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import hash_numbers
from .sampling import hashed

#: The states of an extraction and what may follow each.
FOLLOWS = {
    "SCHEDULED": ["RENDERED", "RENDER_ERROR", "NOT_RUN"], "RENDERED": ["NATIVE", "NATIVE_PARSE_ERROR"], "NATIVE": ["OCR_OK", "NO_TEXT_DETECTED", "OCR_ERROR", "OCR_TIMEOUT"],
    "OCR_OK": ["RESOLVED", "OCR_PARSE_ERROR", "GEOMETRY_ERROR"], "NO_TEXT_DETECTED": ["RESOLVED"],
}
#: The last states that mean a technical failure.
FAILURES = ["RENDER_ERROR", "NATIVE_PARSE_ERROR", "GEOMETRY_ERROR", "OCR_ERROR", "OCR_TIMEOUT", "OCR_PARSE_ERROR", "NOT_RUN"]


def canonical_id(document: str = "document_id", number: str = "page_number") -> Column:
    return F.format_string("%s_page_%04d", document, number)


def schedule(pages: DataFrame, seed: str) -> DataFrame:
    """``pages`` (page_id, document_id, page_number, source_sha256) with position,
    their place in the seeded order."""
    return hash_numbers(pages, hashed("schedule", seed, F.col("page_id")), ["page_id"], "position")


def schedule_digest(rows: DataFrame) -> str:
    """Order-free digest of (position, page_id)."""
    h = F.xxhash64("position", "page_id")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("t")).first()
    return f"{r['n']}:{r['x']}:{r['t']}"


def schedule_faults(rows: DataFrame) -> DataFrame:
    """(document_id, fault) of documents whose pages are not 1 to n, each once,
    with their canonical ids and one source."""
    n = F.count(F.lit(1))
    faults = F.when(F.count_if(~F.coalesce(F.col("page_id") == canonical_id(), F.lit(False))) > 0, "page_id").when(
        (F.min("page_number") != 1) | (F.max("page_number") != n) | (F.count_distinct("page_number") != n), "page_sequence"
    ).when(F.count_distinct("source_sha256") != 1, "source")
    return rows.groupBy("document_id").agg(faults.alias("fault")).where("fault IS NOT NULL")


def state_fault(states: str) -> Column:
    """The first state that may not follow the one before; null if all may."""
    allowed = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    empty = F.struct(F.lit("SCHEDULED").alias("at"), F.lit(None).cast("string").alias("bad"))

    def step(held, s):
        good = F.coalesce(F.array_contains(F.try_element_at(allowed, held["at"]), s), F.lit(False))
        return F.struct(s.alias("at"), F.coalesce(held["bad"], F.when(~good, F.coalesce(s, F.lit("null")))).alias("bad"))

    return F.aggregate(F.col(states), empty, step)["bad"]


def record_digest() -> Column:
    return F.sha2(F.concat_ws("\x1f", "page_id", F.col("source_sha256"), F.array_join("states", ","), "native_sha256", "text_sha256"), 256)


def link(before: Column) -> Column:
    """The chain's value at a record, from that of the record before (the first
    of a document: its id)."""
    return F.sha2(F.concat(before, record_digest()), 256)


def replay(planned: DataFrame, records: DataFrame, resolve: Column) -> DataFrame:
    """(position, page_id, document_id, fault) of every scheduled page and every
    record: the first rule broken, null if none.

    ``records`` are (page_id, document_id, page_number, source_sha256, states,
    technical_failure, reason, native, native_sha256, text, text_sha256, chain);
    ``resolve`` gives the text that a record's columns lead to. Rules in order:
    orphan and missing records, repeated ones, identity, states, failure (the
    last state and the flag must agree, with a reason), native_hash, text_hash,
    resolution, chain.
    """
    plan = planned.select(F.col("page_id").alias("p_id"), "position", F.struct("document_id", "page_number", "source_sha256").alias("planned"))
    times = records.groupBy("page_id").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("page_id", "t_id")
    d = records.join(times, F.col("page_id") == F.col("t_id")).join(plan, F.col("page_id") == F.col("p_id"), "full")
    before = records.groupBy("document_id", "page_number").agg(F.max("chain").alias("before"))
    before = before.select(F.col("document_id").alias("b_doc"), (F.col("page_number") + 1).alias("b_number"), "before")
    d = d.join(before, (F.col("document_id") == F.col("b_doc")) & (F.col("page_number") == F.col("b_number")), "left")
    first = F.when(F.col("page_number") == 1, F.col("document_id")).otherwise(F.col("before"))
    last = F.element_at("states", -1)
    same = F.struct("document_id", "page_number", "source_sha256") == F.col("planned")
    failed = F.coalesce(last.isin(FAILURES), F.lit(False))
    rules = [
        ("missing", F.col("t_id").isNotNull()), ("orphan", F.col("p_id").isNotNull()), ("repeated", F.col("times") == 1), ("identity", same),
        ("states", (F.size("states") > 0) & state_fault("states").isNull() & (failed | (last == "RESOLVED"))),
        ("failure", (F.col("technical_failure") == failed) & (F.col("reason") != "")),
        ("native_hash", F.col("native_sha256") == F.sha2("native", 256)), ("text_hash", F.col("text_sha256") == F.sha2("text", 256)),
        ("resolution", F.col("text") == resolve), ("chain", F.col("chain") == link(first)),
    ]
    fault = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        fault = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(fault)
    return d.select("position", F.coalesce("page_id", "p_id").alias("page_id"), F.coalesce("document_id", F.col("planned.document_id")).alias("document_id"), fault.alias("fault"))


def first_faults(replayed: DataFrame) -> DataFrame:
    """(fault, records, first_page): how often each rule is broken first, and the
    earliest scheduled record that breaks it (orphans by their id)."""
    d = replayed.where("fault IS NOT NULL")
    return d.groupBy("fault").agg(F.count(F.lit(1)).alias("records"), F.min(F.struct(F.col("position").isNull(), "position", "page_id"))["page_id"].alias("first_page"))
