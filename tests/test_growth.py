"""Shares of a task that stay the same however large the tables are."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import scorers
from test_top_k import best, rows, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_length_of_a_vector_is_taken_once(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>").select(scorers.unit("v").alias("u"))
    assert [r.u for r in d.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert "zip_with" not in plan(d)


def test_pairs_without_a_vector_are_kept(spark):
    one = lambda data: [(i, v[0]) for i, v in data]
    p = spark.createDataFrame([*one(vectors(30, 3)), ("none", None)], "page_id string, vector array<double>")
    q = spark.createDataFrame([*one(vectors(4, 4)), ("none", None)], "query_id string, vector array<double>")
    pairs = lambda df: sorted((r.query_id, r.page_id, r.score is None) for r in df.collect())
    assert pairs(scorers.dense_blocks(p, q, 8, 2)) == pairs(scorers.dense(p, q)) and len(pairs(scorers.dense_blocks(p, q))) == 31 * 5


def test_dense_is_dealt_out_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(scorers, "TASK_PAIRS", 10)
    p = spark.range(40).select(F.col("id").alias("page_id"), F.array(F.lit(1.0)).alias("vector"))
    d = scorers.dense(p, p.where("page_id < 5").withColumnRenamed("page_id", "query_id"))
    assert "hashpartitioning(page_id" in plan(d) and ", 20)" in plan(d) and d.count() == 200


def test_dense_query_uses_blocks(spark, sf):
    from lodestone.plans.queries_text import j4

    assert "FlatMapCoGroupsInArrow" in plan(j4(spark, sf))


def test_word_edits_are_dealt_out_by_documents(spark, sf, monkeypatch):
    from lodestone.plans import queries_more

    monkeypatch.setattr(queries_more, "EDITED", 10)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    d = queries_more.i4w(spark, sf)
    assert "hashpartitioning(doc_id" in plan(d) and f", {-(-n // 10)})" in plan(d)


def test_long_word_sequences():
    from lodestone.functions.text import sequence_edits

    a = [str(i) for i in np.random.default_rng(1).integers(0, 400, 30_000)]
    began = time.process_time()
    assert sequence_edits(a, a[7:] + ["end"] * 5) == 12 == sequence_edits(a[7:] + ["end"] * 5, a)
    assert time.process_time() - began < 4  # a table of 9e8 cells


def test_outcomes_read_the_tables_beforehand(spark, sf):
    from lodestone.plans.queries_gates import r5

    assert "lineitem" not in plan(r5(spark, sf))


def test_bundle_facts_are_a_row_a_query(spark, sf):
    """What the bundle's check is told of the whole is read from a written table."""
    from lodestone.plans.queries_bundle import c16

    assert plan(c16(spark, sf)).count("lineitem.parquet") <= 2  # once a side


def test_bm25_is_dealt_out_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(scorers, "TASK_PAIRS", 20)
    monkeypatch.setattr(scorers, "LEAST_PAGES", 5)
    p = spark.createDataFrame([(f"p{i:03d}", f"some words w{i % 7} w{i % 3}") for i in range(60)], "page_id string, text string")
    q = spark.createDataFrame([("a", "w1 w2"), ("b", "words w0")], "query_id string, text string")
    d = scorers.bm25_top(p, q, 4)
    assert "hashpartitioning(page_id" in plan(d) and ", 6)" in plan(d) and rows(d) == best(scorers.bm25(p, q), 4)


def test_blocks_are_ranked_in_slices():
    r = np.random.default_rng(2)
    some = lambda n: pa.array([[list(v)] for v in r.integers(-9, 9, (n, 4)).astype(float)])
    pages, queries = pa.table({"page_id": pa.array(range(5_000)), "vectors": some(5_000)}), pa.table({"query_id": pa.array(range(1_500)), "asked": some(1_500)})
    tracemalloc.start()
    out = scorers._block_top(10, ["query_id", "page_id", "score"])(pages, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 15_000 and peak < 50_000_000
