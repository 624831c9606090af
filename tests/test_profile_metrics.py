"""Rankings under many profiles are made in place."""

import numpy as np
import pytest

from lodestone.operators import oracle
from lodestone.plans import adapters


def plain(rows, weights):
    """Metrics of one query's (page_id, relevance, a, b, c)."""
    w, ranked = weights, []
    for page, rel, *x in rows:
        score = -np.inf if None in x else w[0] * x[0] + w[1] * x[1] + w[2] * x[2]
        ranked.append((-score, page, rel or 0.0))
    label = [r[2] for r in sorted(ranked)]
    gain = lambda ls: sum((2.0**v - 1) / np.log2(i + 2) for i, v in enumerate(ls[:10]))
    ideal, positives = gain(sorted(label, reverse=True)), sum(v > 0 for v in label)
    first = [i + 1 for i, v in enumerate(label[:10]) if v > 0]
    share = lambda k: sum(v > 0 for v in label[:k]) / positives if positives else 0.0
    return gain(label) / ideal if ideal > 0 else 0.0, share(1), share(3), 1 / first[0] if first else 0.0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_metrics_equal_brute_force(spark, batch):
    rng, rows = np.random.default_rng(4), []
    for q in range(23):
        for p in rng.permutation(int(rng.integers(1, 40))):
            x = [float(v) for v in rng.integers(0, 4, 3) / 4]  # many ties
            if q % 7 == 3 and p % 5 == 0:
                x[1] = None
            rows.append((q // 12, f"q{q % 12}", f"p{p:03d}", None if p % 9 == 8 else float(max(0, rng.integers(-4, 4))), *x))
    df = spark.createDataFrame(rows, "part int, query_id string, page_id string, relevance double, bm25_score double, dense_score double, visual_score double").repartition(5)
    grid = oracle.simplex(10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = oracle.profile_metrics(df, grid, ["part", "query_id"])
        got = {(r.part, r.query_id, r.profile): (r.ndcg10, r.recall1, r.recall3, r.mrr10) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    queries = {r[:2] for r in rows}
    assert len(got) == len(queries) * 66
    for (part, q, profile), values in got.items():
        assert values == pytest.approx(plain([r[2:] for r in rows if r[:2] == (part, q)], grid[profile]), abs=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(part") == 1  # no row a profile
    assert oracle.profile_metrics(df.where("false"), grid, ["part", "query_id"]).count() == 0


def test_score_table_is_dealt_by_query_into_more_parts_the_longer_it_is(spark, sf, monkeypatch):
    monkeypatch.setattr(adapters, "LINES", 500)
    parts = -(-adapters.table(spark, sf, "lineitem").count() // 500)
    assert parts > 4 and adapters.raw(spark, sf).rdd.getNumPartitions() == parts
    plan = adapters.candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = sorted(tuple(r) for r in adapters.raw(spark, sf).where("relevance > 0").select("query_id", "page_id", "relevance").collect())
    assert want and sorted(tuple(r) for r in adapters.qrels(spark, sf).collect()) == want
