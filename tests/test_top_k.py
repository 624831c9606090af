"""The best pages of a query without the others, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import scorers
from lodestone.operators.ranking import top


def best(df, k):
    return rows(top(df.withColumn("r", F.round("score", 9)), "r", k))


def rows(df):
    return sorted((r.query_id, r.page_id, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bm25(spark, k):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    pages = [(f"p{i:04d}", " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(600)] + [("none", None)]
    queries = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)) + ["w0", "w0", "w1"])) for i in range(12)] + [("rare", "w299"), ("absent", "zzz"), ("empty", ""), ("null", None)]
    p, q = spark.createDataFrame(pages, "page_id string, text string"), spark.createDataFrame(queries, "query_id string, text string")
    assert rows(scorers.bm25_top(p, q, k)) == best(scorers.bm25(p, q), k)
    assert scorers.bm25_top(p.where("false"), q, k).collect() == [] == scorers.bm25_top(p, q.where("false"), k).collect()


def test_bm25_ties_go_to_the_first_page(spark):
    p = spark.createDataFrame([(f"p{i:03d}", "same words here") for i in range(100)], "page_id string, text string")
    q = spark.createDataFrame([("q", "same words")], "query_id string, text string")
    assert [r[1] for r in rows(scorers.bm25_top(p, q, 3))] == ["p000", "p001", "p002"]


def vectors(n, seed, length=6):
    rng = np.random.default_rng(seed)
    return [(f"{seed}-{i:03d}", [rng.integers(-3, 4, length).astype(float).tolist() for _ in range(1 + i % 3)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"page_block": 20, "query_block": 3}])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_late_interaction(spark, k, blocks):
    p = spark.createDataFrame([*vectors(90, 1), ("none", None), ("empty", [])], "page_id string, vectors array<array<double>>")
    q = spark.createDataFrame([*vectors(8, 2), ("none", None)], "query_id string, vectors array<array<double>>")
    some = "size(vectors) > 0"
    assert rows(scorers.max_sim_top(p, q, k, **blocks)) == best(scorers.max_sim(p.where(some), q.where(some)), k)


def test_dense(spark):
    one = lambda data: [(i, v[0]) for i, v in data]
    p = spark.createDataFrame(one(vectors(70, 3)), "page_id string, vector array<float>")
    q = spark.createDataFrame(one(vectors(5, 4)), "query_id string, vector array<float>")
    assert rows(scorers.dense_top(p, q, 4, page_block=16, query_block=2)) == best(scorers.dense(p, q), 4)
    assert rows(scorers.dense_blocks(p, q)) == rows(scorers.dense(p, q))
    assert scorers.dense_top(p, q.where("false"), 4).collect() == []


def test_plan_does_not_grow_with_queries(spark):
    plans = []
    for n in (3, 40):
        p = spark.createDataFrame(vectors(30, 5), "page_id string, vectors array<array<double>>")
        q = spark.createDataFrame(vectors(n, 6), "query_id string, vectors array<array<double>>")
        plan = scorers.max_sim_top(p, q, 2, query_block=2)._jdf.queryExecution().executedPlan().toString()
        plans.append(plan.count("\n"))
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plans[0] == plans[1]


def test_containing(spark):
    pages = [("a", "One two three four five"), ("b", "xone two threex"), ("c", "one two"), ("d", None), ("e", ""), ("f", "ONE TWO THREE")]
    passages = [("whole", "One two three"), ("cut", "ne two three"), ("two", "one two"), ("single", "x"), ("none", "zero one two three"), ("absent", "one seven three"), ("null", None), ("empty", "")]
    p, q = spark.createDataFrame(pages, "page_id string, text string"), spark.createDataFrame(passages, "query_id string, text string")
    want = sorted((i, a) for i, x in passages for a, t in pages if x is not None and t is not None and x in t)
    assert sorted(map(tuple, scorers.containing(p, q).collect())) == want


def test_numbers_without_one_task(spark):
    from lodestone.operators import ranking

    rng = random.Random(2)
    rows = [(f"k{i:04d}", rng.choice([None, 0.0, 0.5, float(i)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = ranking.numbered(df, [F.desc("v"), "k"], "n", "all")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.n, r["all"]) for r in sorted(got.collect(), key=lambda r: r.n)] == [(k, i + 1, 500) for i, (k, _) in enumerate(want)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SinglePartition") <= 1  # the counts of ranges
    assert ranking.numbered(df.where("false"), ["k"]).collect() == []


def test_duplicate_members(spark):
    from lodestone.operators import audit

    df = spark.createDataFrame([("p1", "a", "x"), ("p2", "b", "x"), ("p3", "a", "y"), ("p0", "a", "z")], "page_id string, content_sha256 string, split string")
    assert sorted(map(tuple, audit.duplicate_members(df).collect())) == [("a", "p0", "p0"), ("a", "p1", "p0"), ("a", "p3", "p0")]


def test_all_pairs_leave_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 2, 4)).round(3).tolist()
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "page_id long, vectors array<array<double>>")
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(v[:13])], "query_id long, vectors array<array<double>>")
    sizes, inner = [], scorers._pairs
    monkeypatch.setattr(scorers, "_pairs", lambda *a: sizes.append(a[2] * a[3]) or inner(*a))
    got = {(r.query_id, r.page_id): r.score for r in scorers.max_sim(pages, queries, page_block=16, query_block=4).collect()}
    assert got == {(i, j): pytest.approx(sum(max(np.dot(a, b) for b in v[j]) for a in v[i])) for i in range(13) for j in range(90)}
    one = lambda df: df.withColumn("vector", F.col("vectors")[0]).drop("vectors")
    out = scorers.dense_blocks(one(pages), one(queries))
    assert {(r.query_id, r.page_id): r.score for r in out.collect()} == {(i, j): pytest.approx(np.dot(v[i][0], v[j][0])) for i in range(13) for j in range(90)}
    assert sizes == [64, scorers.ALL_PAGES * scorers.ALL_QUERIES]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # all pairs are not ranked
