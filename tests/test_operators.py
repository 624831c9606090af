"""Operators on small inputs with known or brute-force results."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import budget, contracts, decisions, fusion, gate, metrics, normalize, oracle, page_oracle, pool, ranking, scorers, stats, training

ROW = "query_id string, page_id string, bm25_score double, dense_score double, visual_score double"


def ndcg(relevance, k=10):
    gains = [(2.0**r - 1) / math.log2(i + 2) for i, r in enumerate(relevance[:k])]
    best = [(2.0**r - 1) / math.log2(i + 2) for i, r in enumerate(sorted(relevance, reverse=True)[:k])]
    return sum(gains) / sum(best) if sum(best) else 0.0


def test_metric_vectors(spark):
    rows = [("q", "a", 0.5, 0.0), ("q", "b", 0.5, 1.0), ("r", "b", 0.5, 0.0), ("r", "a", 0.5, 1.0), ("z", "a", 1.0, 0.0)]
    got = {r.query_id: r for r in metrics.evaluate(spark.createDataFrame(rows, "query_id string, page_id string, s double, relevance double"), "s").collect()}
    assert abs(got["q"].ndcg10 - (1 / math.log2(3))) < 1e-12 and got["q"].recall1 == 0 and got["q"].mrr10 == 0.5
    assert got["r"].recall1 == 1 and got["r"].ndcg10 == 1
    assert (got["z"].ndcg10, got["z"].recall3, got["z"].mrr10) == (0, 0, 0)


def test_binary_ideal_counts_labels_outside_the_pool(spark):
    rows = spark.createDataFrame([("q", "a", 1.0, 1.0), ("q", "b", 0.5, 0.0)], "query_id string, page_id string, s double, relevance double")
    got = metrics.evaluate_against(rows, "s", spark.createDataFrame([("q", 3), ("none", 0)], "query_id string, relevant_total long")).collect()
    assert len(got) == 1 and abs(got[0].ndcg10 - 1 / (1 + 1 / math.log2(3) + 0.5)) < 1e-12 and abs(got[0].recall1 - 1 / 3) < 1e-12


def _matrix(spark):
    b, d, v = [[8, 8, -100, 1], [4, 4, 4, 4]], [[0, 0, -30, 10], [5, 1, -50, 3]], [[11, 0, -5, 0], [9, 0, -5, 0]]
    rows = [(q, p, float(b[i][j]), float(d[i][j]), float(v[i][j])) for i, q in enumerate(("q2", "q1")) for j, p in enumerate(("p3", "p1", "p4", "p2"))]
    return spark.createDataFrame(rows, ROW)


def test_union_pool_and_renaming(spark):
    m = _matrix(spark)
    got = sorted(map(tuple, pool.union_pool(m, 1).collect()))
    assert got == [("q1", "p1"), ("q1", "p3"), ("q2", "p1"), ("q2", "p2"), ("q2", "p3")]
    renamed = m.withColumn("query_id", F.concat(F.lit("x"), "query_id"))
    assert sorted((r[0][1:], r[1]) for r in pool.union_pool(renamed, 1).collect()) == got
    assert sorted((r.query_id, r.page_id) for r in pool.pool_rows(m, 1).collect()) == got


@pytest.mark.parametrize("f", [lambda d: pool.union_pool(d, 1), normalize.minmax, normalize.zscore, gate.features, gate.features_first, pool.top_document, lambda d: ranking.channel_top_lists(d, 1)])
def test_labels_are_refused(spark, f):
    with pytest.raises(contracts.ContractError):
        f(_matrix(spark).withColumn("relevance", F.lit(1.0)))


def test_minmax_edges(spark):
    def one(values, eps=1e-15):
        df = spark.createDataFrame([("q", f"p{i}", float(v)) for i, v in enumerate(values)], "query_id string, page_id string, s double")
        return [r.s for r in normalize.minmax(df, ["s"], eps=eps).orderBy("page_id").collect()]

    assert one([0, 1e-15]) == [0, 0] and one([0, np.nextafter(1e-15, 1)]) == [0, 1]
    assert one([0, 1e-15], eps=0) == [0, 1] and one([2, 2]) == [0, 0] and one([3]) == [0]
    assert one([-1.7e308, 0, 1.7e308]) == [0, 0.5, 1]


def test_expansion(spark):
    pages = ["docA_page_0001", "docA_page_0002", "docA_page_0003", "docB_page_0001", "docB_page_0002"]
    b, d, v = [[5, 3, 1, 4, 0], [9, 1, 2, 0, 0]], [[5, 1, 3, 0, 0], [9, 1, 2, 0, 0]], [[0, 2, 1, 9, 0], [9, 2, 1, 0, 0]]
    rows = [(f"q{i}", p, float(b[i][j]), float(d[i][j]), float(v[i][j])) for i in range(2) for j, p in enumerate(pages)]
    got = [(r.query_id, r.page_id) for r in pool.expand_top_document(spark.createDataFrame(rows, ROW), 1).orderBy("query_id", "priority").collect()]
    assert got == [("q0", "docA_page_0002"), ("q1", "docA_page_0003"), ("q1", "docA_page_0002")]


def test_coverage_failure_names_its_audit(spark):
    rows = [("d", "q", f"p{i:03d}", "s", float(i == 399), *[float(-i)] * 5) for i in range(400)]
    raw = spark.createDataFrame(rows, contracts.CONTRACTS["raw_scores"])
    with pytest.raises(pool.CoverageError) as e:
        pool.choose_pool(raw)
    assert [r.status for r in e.value.audit.collect()] == ["candidate_coverage_below_gate"]
    kept, depth = pool.choose_pool(raw.withColumn("relevance", (F.col("page_id") == "p250").cast("double")))
    assert depth == "final" and kept.count() == 300


def test_contract_rules(spark):
    bad = spark.createDataFrame([("q", "a", float("nan"), 1.0, 1.0), ("q", "a", 1.0, None, float("inf"))], ROW)
    assert contracts.violations(bad, contracts.numeric_rules(contracts.CHANNELS)).first().asDict() == {"bm25_score_not_finite": 1, "dense_score_not_finite": 1, "visual_score_not_finite": 1}
    with pytest.raises(contracts.ContractError):
        contracts.enforce(bad, contracts.numeric_rules(["bm25_score"]))
    with pytest.raises(contracts.ContractError):
        contracts.exact_columns(bad.select("page_id", "query_id"), "candidate_set")
    assert contracts.duplicate_keys(bad, ["query_id", "page_id"]).first().n == 2


def test_baselines(spark):
    rows = spark.createDataFrame([("q", "b", 10.0, 0.0, 1.0), ("q", "a", 0.0, 10.0, 1.0), ("q", "c", 5.0, 5.0, 1.0)], ROW)
    got = {(r.method, r.page_id): r.score for r in fusion.fixed_methods(rows, normalize.minmax(rows)).collect()}
    assert [got["bm25", p] for p in "bac"] == [1, 0, 0.5] and all(abs(got["uniform", p] - 1 / 3) < 1e-12 for p in "bac")
    assert got["rrf", "a"] > got["rrf", "b"]


def _brute(channels, relevance, profiles, pages):
    # products summed left to right, as in the operators: ties are exact then
    fused = channels[:, :1] * profiles[:, 0] + channels[:, 1:2] * profiles[:, 1] + channels[:, 2:] * profiles[:, 2]

    def of(scores):
        order = sorted(range(len(pages)), key=lambda i: (-scores[i], pages[i]))
        r = relevance[order]
        hits = np.flatnonzero(r[:10] > 0)
        return ndcg(r.tolist()), (r[:3] > 0).sum() / max(1, (r > 0).sum()), 1 / (hits[0] + 1) if len(hits) else 0.0

    best = 0
    for i in range(1, len(profiles)):
        x, y = of(fused[:, i]), of(fused[:, best])
        if next((a > b for a, b in zip(x, y) if abs(a - b) > 1e-12), False):
            best = i
    scores, chosen, start = fused[:, best].copy(), [best] * len(pages), of(fused[:, best])[0]
    now, order = start, sorted(range(len(pages)), key=lambda i: (-fused[i, best], pages[i]))
    for _ in range(2):
        changed = False
        for page in order:
            pick, value = chosen[page], now
            for i in range(len(profiles)):
                trial = scores.copy()
                trial[page] = fused[page, i]
                v = of(trial)[0]
                if i != chosen[page] and v > value + 1e-12:
                    pick, value = i, v
            if pick != chosen[page]:
                chosen[page], scores[page], changed = pick, fused[page, pick], True
                now = of(scores)[0]
        if not changed:
            break
    return best, start, now


@pytest.mark.parametrize("n,seed,grid", list(itertools.product((1, 2, 5, 11, 32), (0, 1), (oracle.W7, oracle.simplex(4)))))
def test_page_search_against_brute_force(n, seed, grid):
    rng = np.random.default_rng(seed * 100 + n)
    channels, relevance = rng.random((n, 3)).round(1 + seed), rng.integers(0, 4, n).astype(float)
    pages = [f"p{i:04d}" for i in range(n)]
    best, base, value, chosen, _ = page_oracle.search(channels, relevance, np.array(grid))
    want = _brute(channels, relevance, np.array(grid), pages)
    assert best == want[0] and abs(base - want[1]) < 1e-9 and abs(value - want[2]) < 1e-9 and value >= base - 1e-12


def test_oracle_levels(spark):
    rng = np.random.default_rng(5)
    rows = [(f"q{q}", f"p{p:02d}", *map(float, rng.random(3)), float(rng.random() < 0.2)) for q in range(6) for p in range(15)]
    df = spark.createDataFrame(rows, ROW + ", relevance double")
    table = oracle.oracle_rows(df, oracle.W7).collect()
    page = {r.query_id: r for r in page_oracle.page_oracle(df, oracle.W7).collect()}
    closed = {r.query_id: r.ndcg10 for r in oracle.page_oracle_binary(df, oracle.W7).collect()}
    for r in table:
        assert r.query_ndcg10 >= r.global_ndcg10 - 1e-9
        assert page[r.query_id].query_profile == r.query_profile and abs(page[r.query_id].query_ndcg10 - r.query_ndcg10) < 1e-9
        if r.query_id in closed:
            assert closed[r.query_id] >= page[r.query_id].page_ndcg10 - 1e-9


def test_closed_form_over_all_assignments(spark):
    rng = np.random.default_rng(2)
    channels, relevance = rng.random((4, 3)), np.array([1.0, 0, 1, 0])
    grid = np.array(oracle.W7[:4])
    best = max(ndcg(relevance[sorted(range(4), key=lambda i: (-s[i], i))].tolist()) for s in ([(channels[i] @ grid[a[i]]) for i in range(4)] for a in itertools.product(range(4), repeat=4)))
    df = spark.createDataFrame([("q", f"p{i}", *map(float, channels[i]), float(relevance[i])) for i in range(4)], ROW + ", relevance double")
    assert abs(oracle.page_oracle_binary(df, oracle.W7[:4]).first().ndcg10 - best) < 1e-12


def test_grid_rules():
    assert len(oracle.simplex(10)) == 66 and oracle.simplex(10)[0] == (0.0, 0.0, 1.0) and oracle.simplex(10)[-1] == (1.0, 0.0, 0.0)
    for bad in ([(1.0, 1.0, 0.0)], [(1.0, 0.0)], [(0.5, 0.5, 0.0)] * 2, [(-0.5, 1.0, 0.5)], []):
        with pytest.raises(ValueError):
            oracle.checked(bad)


def _metric_table(spark):
    rows = [(f"q{i}", "s", a, b, m, 5.0 + i, 100.0 + i) for i, (a, b, m) in enumerate([(0.2, 0.8, 0.1), (0.3, 0.7, 0.4), (0.6, 0.6, 0.2), (0.8, 0.7, 0.3)])]
    return spark.createDataFrame(rows, "query_id string, source string, ndcg_stage1 double, ndcg_full double, stage1_margin double, stage2_ms double, stage2_flops double")


def test_budget_ends(spark):
    m = _metric_table(spark)
    c = {r.budget_percent: r for r in budget.curve(m).collect()}
    assert len(c) == 21 and abs(c[0].oracle_ndcg10 - 0.475) < 1e-12 and abs(c[100].margin_ndcg10 - 0.7) < 1e-12
    assert c[50].invocations == 2 and abs(c[50].oracle_ndcg10 - (0.8 + 0.7 + 0.6 + 0.8) / 4) < 1e-12
    arm = {r.budget_percent: r.random_ndcg10 for r in budget.random_arm(m, 50).collect()}
    assert abs(arm[0] - 0.475) < 1e-12 and abs(arm[100] - 0.7) < 1e-12 and abs(arm[50] - c[50].random_ndcg10) < 0.1
    star = budget.b_star(budget.curve(m))
    assert sum(r.selected_at_b_star for r in budget.per_query(m, star).collect()) == c[star.first().b_star].invocations


def test_bootstrap_is_the_numpy_stream(spark):
    x = np.random.default_rng(1).normal(size=171)
    df = spark.createDataFrame([(f"q{i:03d}", float(v)) for i, v in enumerate(x)], "query_id string, d double")
    rng = np.random.default_rng(stats.SEED)
    want = np.quantile(x[rng.integers(0, 171, (1000, 171))].mean(1), [0.025, 0.975])
    got = stats.bootstrap_mean(df, "d", 1000).first()
    assert np.allclose([got.low, got.high], want, atol=1e-12)
    r = stats.bootstrap_ratio(df.withColumn("one", F.lit(1.0)), "d", "one", 1000).first()
    assert np.allclose([r.low, r.high], want, atol=1e-12)
    zero = stats.bootstrap_ratio(df.withColumn("z", F.lit(0.0)), "d", "z", 300).first()
    assert (zero.low, zero.high) == (1.0, 1.0)


def test_gates(spark):
    df = spark.createDataFrame([(0.04, 0.01, 0.035, 0.001), (0.04, 0.01, 0.035, -0.001), (0.005, 0.0, 0.5, 0.1)], "w7_mean_delta double, w7_low double, w66_mean_delta double, w66_low double")
    assert [r[0] for r in df.select(decisions.discovery()).collect()] == ["pass", "inconclusive", "fail"]
    pair = spark.createDataFrame([("pass", "fail"), ("fail", "pass"), ("fail", "fail"), ("fail", "inconclusive")], "fusion_gate string, budget_gate string")
    assert [r[0] for r in pair.select(decisions.final()).collect()] == ["page_fusion", "budget_aware", "reject_both", "inconclusive"]


def test_features_and_gate(spark):
    rows = spark.createDataFrame([("q", p, float(a), float(b), float(c)) for p, a, b, c in (("c", 4, 20, 7), ("a", 2, 10, 7), ("b", 0, 30, 7))], ROW)
    texts = spark.createDataFrame([("q", "Apple pear")], "query_id string, text string")
    f = {r.page_id: r for r in gate.features(rows, texts).collect()}
    assert f["c"].bm25_minmax == 1 and f["a"].dense_rr == pytest.approx(1 / 3) and f["b"].visual_rr == 0.5 and f["a"].bm25_gap == 0.5 and f["a"].visual_gap == 0
    assert f["a"].query_length == 2 / 64 and f["b"].bm25_dense_apart == 1
    zero = gate.predict(gate.features(rows, texts), [[0.0] * 13] * 3, [0.0] * 3).collect()
    assert all(abs(r.w_bm25 - 1 / 3) < 1e-12 and abs(r.score - (f[r.page_id].bm25_minmax + f[r.page_id].dense_minmax) / 3) < 1e-12 for r in zero)
    level = gate.predict(gate.features(rows, texts), [[0.3] * 13, [0.1] * 13, [0.0] * 13], [0.0] * 3, level="query")
    assert gate.gate_profile(level).first().varying_queries == 0


def test_training_gradient_by_differences(spark):
    rng = np.random.default_rng(4)
    rows = [(f"q{q}", f"p{p}", *map(float, rng.random(3)), float(p < 2)) for q in range(4) for p in range(6)]
    df = spark.createDataFrame(rows, ROW + ", relevance double")
    feats = gate.features(df.drop("relevance")).join(df.select("query_id", "page_id", "relevance"), ["query_id", "page_id"]).cache()
    loss = lambda w, b: gate.pairwise_loss(gate.predict(feats, w, b).join(feats.select("query_id", "page_id", "relevance"), ["query_id", "page_id"])).first().loss
    p, losses = training.descend(feats, epochs=1, rate=1e-3)
    w, b = training.unpack(p, training.Settings())
    assert abs(losses[0] - loss([[0.0] * 13] * 3, [0.0] * 3)) < 1e-9
    for i, j in ((0, 0), (2, 5)):
        up = [[0.0] * 13 for _ in range(3)]
        up[i][j] = 1e-4
        slope = (loss(up, [0.0] * 3) - losses[0]) / 1e-4
        assert abs(-w[i, j] / 1e-3 - slope) < 1e-3
    _, more = training.descend(feats, epochs=6, rate=2.0)
    assert more[-1] < more[0]


def test_bm25_counts_query_terms(spark):
    pages = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", "bird"), ("d", "")], "page_id string, text string")
    queries = spark.createDataFrame([("q", "Cat cat dog"), ("n", "zebra")], "query_id string, text string")
    got = {r.page_id: r.score for r in scorers.bm25(pages, queries).collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    tf = lambda f, n: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 1.25))
    assert set(got) == {"a", "b"} and abs(got["a"] - (2 * idf(1) * tf(2, 3) + idf(2) * tf(1, 3))) < 1e-12


def test_page_resolution(spark):
    kind = "native string, boxes array<array<int>>, words array<struct<text:string,confidence:double,box:array<int>,line:array<int>>>"
    w = lambda t, c, b, n: (t, c, b, n)
    rows = [("Text", [[0, 0, 10, 10]], [w("in", 90.0, [0, 0, 5, 5], [1]), w("new", 90.0, [20, 0, 30, 5], [1]), w("word", 61.0, [31, 0, 40, 5], [1]), w("--", 99.0, [50, 0, 60, 5], [1]), w("low", 20.0, [70, 0, 80, 5], [1]), w("next", 80.0, [20, 20, 30, 30], [2])]), ("", [], [w("all", 70.0, [0, 0, 2, 2], [1])]), ("keep", [], [])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(scorers.resolve_page("words", "native", "boxes")).collect()]
    assert got == ["Text\nnew word\nnext", "all", "keep"]
    assert scorers.union_area(pd.Series([[[0, 0, 2, 2], [1, 1, 3, 3]], [], None])).tolist() == [7.0, 0.0, 0.0]


def test_scalar_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scalars.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert value(scalars.ratio(F.lit(1.0), F.lit(0.0))) is None and value(scalars.ratio(F.lit(1.0), F.lit(0.0), 1.0)) == 1.0
    assert value(scalars.words(F.lit("Été_1 d'or  ²"))) == ["été_1", "d", "or", "²"]
    assert value(scalars.document_of(F.lit("a_b_page_0012"))) == "a_b" and value(scalars.document_of(F.lit("a_b_7"), "last")) == "a_b"
    assert value(scalars.softplus(F.lit(1000.0))) == 1000.0
    assert json.loads(json.dumps(value(scalars.label_list(F.array(F.lit("b"), F.lit("a"), F.lit("b")))))) == "a|b"


def test_word_edits_and_changes():
    from lodestone.functions import text

    def brute(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return table[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        assert text.sequence_edits(a, b) == brute(a, b)
    assert text.changes({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3, "c": 2}}) == {"a.b": [1, 3], "d": [1, None]}


def test_weights_are_bound_to_settings():
    held = gate.save([[1.0, 2.0]], [0.5], {"k": 1})
    w, b = gate.load(held, {"k": 1})
    assert w.tolist() == [[1.0, 2.0]] and b.tolist() == [0.5]
    with pytest.raises(ValueError):
        gate.load(held, {"k": 2})


def test_standard_library_draws(spark):
    import random

    from lodestone.operators import stats

    rng = random.Random(stats.SEED)
    assert stats._below(stats.SEED, 7)(3000).tolist() == [rng.randrange(7) for _ in range(3000)]
    deltas = [0.1, -0.2, 0.0, 0.4, 0.05]
    got = stats.paired_bootstrap(spark.createDataFrame([(str(i), x) for i, x in enumerate(deltas)], "query_id string, delta double"), resamples=200).first()
    rng = random.Random(stats.SEED)
    means = sorted(sum(deltas[rng.randrange(5)] for _ in range(5)) / 5 for _ in range(200))
    at = lambda p: means[int(p)] + (means[int(p) + 1] - means[int(p)]) * (p % 1)
    assert abs(got.low - at(199 * 0.025)) < 1e-12 and abs(got.high - at(199 * 0.975)) < 1e-12
    assert (got.wins, got.ties, got.losses) == (3, 1, 1)


def test_budget_confirmation(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import decisions

    good = (0.03, 0.4, 0.6, 30, 0.02, 0.99)
    cases = [(good, good, "pass"), (good, (0.005, *good[1:]), "fail"), (good, (*good[:3], 80, *good[4:]), "fail"), ((*good[:5], 0.9), good, "inconclusive"), (good, (*good[:5], None), "inconclusive")]
    s = "struct<full_minus_stage1:double,beneficial_fraction:double,non_beneficial_fraction:double,b_star:int,control_gap:double,retention_low:double>"
    df = spark.createDataFrame(cases, f"discovery {s}, confirmation {s}, want string")
    assert df.where(decisions.budget_confirmation() != F.col("want")).count() == 0


def test_changes_of_type():
    from lodestone.functions import text

    assert text.changes({"a": 1, "b": {"c": True, "d": 2}}, {"a": 1.0, "b": {"c": 1, "d": 2}}) == {"a": [1, 1.0], "b.c": [True, 1]}
    assert text.changes({"a": {"b": 1}}, {"a": 5}) == {"a": [{"b": 1}, 5]}
