from lodestone.operators import budget, oracle, stats
from lodestone.plans import catalogue, queries_search


def test_fold_of_more_than_ten_thousand_profiles(spark):
    n = len(oracle.simplex(140))
    df = spark.range(n).selectExpr("int(id) AS profile", "1 AS query_id", f"IF(id = {n - 1}, 0.9D, 0.5D) AS ndcg10", "0.5D AS recall1", "0.5D AS recall3", "0.5D AS mrr10")
    assert n > 10_001 and oracle.query_oracle(df).first().profile == n - 1


def test_queries_have_the_sizes_of_the_reference(spark, sf):
    q, row = catalogue.queries(), lambda df: [tuple(round(x, 6) for x in r) for r in df.collect()]
    assert row(q["n1_bootstrap_mean"](spark, sf)) == row(stats.bootstrap_mean(queries_search._deltas(spark, sf), "delta", 10_000))
    assert row(q["n2_bootstrap_ratio"](spark, sf)) == row(stats.bootstrap_ratio(queries_search._metrics(spark, sf), "ndcg_stage1", "ndcg_full", 10_000))
    assert sorted(row(q["m11_random_arm"](spark, sf))) == sorted(row(budget.random_arm(queries_search._metrics(spark, sf), 100)))
