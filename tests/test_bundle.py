import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bundle

B = ["bm25", "dense", "stage1", "visual"]


def rows():
    """raw and score rows of 4 queries with 5 pages, in order."""
    raw, score = [], []
    for q in range(4):
        own = []
        for p in range(5):
            s = [float((p * (i + 1) + q) % 5 + i) for i in range(4)]
            own.append((f"q{q}", f"p{p}", "chart", float(p == q), *s, "union"))
        raw += own
        for r in own:
            unit, rank = [], {}
            for i, b in enumerate(B):
                col = [x[4 + i] for x in own]
                unit.append((r[4 + i] - min(col)) / (max(col) - min(col)))
                rank[b] = sorted(((-x[4 + i], x[1]) for x in own)).index((-r[4 + i], r[1])) + 1
            score.append((*r[:4], *unit, json.dumps(rank)))
    return raw, score, [(f"q{q}", 1) for q in range(4)]


def tables(spark, raw, score, audit):
    kinds = ", ".join(f"{b}_score double" for b in B)
    d = F.lit("d").alias("dataset")
    a = spark.createDataFrame(raw, f"query_id string, page_id string, source string, relevance double, {kinds}, candidate_provenance string").select(d, "*")
    b = spark.createDataFrame(score, f"query_id string, page_id string, source string, relevance double, {kinds}, branch_ranks string").select(d, "*")
    return a, b, spark.createDataFrame(audit, "query_id string, relevant_selected int").select(d, "*")


def broken(spark, raw, score, audit, final=0.99, places=None, **kw):
    a, b, c = tables(spark, raw, score, audit)
    if places:
        b.coalesce(1).write.mode("overwrite").parquet(places)
        b = bundle.with_places(spark.read.parquet(places))
    cover = spark.createDataFrame([(final, 0.95)], "final_coverage double, minimum_required double")
    df = bundle.check(a, b, c, cover, **{"rows": 20, "queries": 4, "provenance": "union", "cap": 5} | kw)
    out = {r.rule: r for r in df.collect()}
    assert len(out) >= 19
    return {r: (x.broken, x.example) for r, x in out.items() if x.broken}


def change(rows, i, **new):
    names = ["query_id", "page_id", "source", "relevance", *[f"{b}_score" for b in B], "last"]
    r = list(rows[i])
    for k, v in new.items():
        r[names.index(k)] = v
    return rows[:i] + [tuple(r)] + rows[i + 1 :]


def test_a_good_bundle_breaks_nothing(spark, tmp_path):
    raw, score, audit = rows()
    keys = bundle.key_digest(tables(spark, raw, score, audit)[1])
    assert broken(spark, raw, score, audit, keys=keys, places=str(tmp_path / "s")) == {}


FAULTS = {
    "raw_keys_unique": lambda r, s, a: (r + [r[3]], s, a), "score_keys_unique": lambda r, s, a: (r, s + [s[3]], a), "key_sets_match": lambda r, s, a: (r, s[:7] + s[8:], a),
    "page_ids_clean": lambda r, s, a: (change(r, 1, page_id=" p1"), change(s, 1, page_id=" p1"), a), "common_values_match": lambda r, s, a: (r, change(s, 6, source="table"), a),
    "raw_numeric_finite": lambda r, s, a: (change(r, 2, dense_score=float("nan")), s, a), "score_numeric_finite": lambda r, s, a: (r, change(s, 2, visual_score=None), a),
    "relevance_nonnegative": lambda r, s, a: (change(r, 9, relevance=-1.0), change(s, 9, relevance=-1.0), a), "normalized_scores_bounded": lambda r, s, a: (r, change(s, 4, bm25_score=1.5), a),
    "branch_ranks_valid": lambda r, s, a: (r, change(s, 4, last="{broken"), a), "normalization_matches_raw": lambda r, s, a: (r, change(s, 4, bm25_score=s[4][4] / 2 + 1e-9), a),
    "candidate_provenance_matches": lambda r, s, a: (change(r, 5, last="other"), s, a), "branch_rank_permutation": lambda r, s, a: (r, change(s, 0, last=s[1][-1]), a),
    "audit_row_there": lambda r, s, a: (r, s, a[1:]), "audit_has_relevant_candidates": lambda r, s, a: (r, s, [("q0", 0), *a[1:]]),
    "has_relevant_candidate": lambda r, s, a: (change(r, 0, relevance=0.0), change(s, 0, relevance=0.0), a),
}


@pytest.mark.parametrize("rule", FAULTS)
def test_planted_faults_are_found(spark, rule):
    found = broken(spark, *FAULTS[rule](*rows()))
    assert found[rule][0] == 1 and found[rule][1].startswith("d/q")
    # a fault breaks its own rule, and only those that it cannot but break too
    also = {"raw_keys_unique": {"row_count_matches"}, "score_keys_unique": {"row_count_matches", "branch_rank_permutation", "candidate_cap"}, "key_sets_match": {"row_count_matches", "branch_rank_permutation"}}
    also |= {"raw_numeric_finite": {"normalization_matches_raw"}, "score_numeric_finite": {"normalized_scores_bounded", "normalization_matches_raw"}, "normalized_scores_bounded": {"normalization_matches_raw"}, "branch_ranks_valid": {"branch_rank_permutation"}}
    assert set(found) - {rule} <= also.get(rule, set())


def test_facts_of_the_whole(spark):
    raw, score, audit = rows()
    assert set(broken(spark, raw, score, audit, rows=21, queries=5, final=0.9, cap=4, keys="20:0:0")) == {"row_count_matches", "query_count_matches", "coverage_gate", "candidate_cap", "key_digest_matches"}


def test_places(spark, tmp_path):
    raw, score, audit = rows()
    apart = score[:3] + score[5:8] + score[3:5] + score[8:]
    assert broken(spark, raw, apart, audit, places=str(tmp_path / "a")) == {"rows_contiguous": (2, "d/q0")}
    swapped = [score[1], score[0], *score[2:]]
    assert broken(spark, raw, swapped, audit, places=str(tmp_path / "b")) == {"pages_in_order": (1, "d/q0")}


def test_one_shuffle_of_rows(spark):
    a, b, c = tables(spark, *rows())
    cover = spark.createDataFrame([(1.0, 0.95)], "final_coverage double, minimum_required double")
    plan = bundle.check(a, b, c, cover, rows=20, queries=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    found = broken(spark, [], [], [])
    assert set(found) == {"row_count_matches", "query_count_matches"}
