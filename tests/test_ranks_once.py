"""A channel is ranked once, however many columns are made from its rank."""

from lodestone.operators import pool


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def scores(spark):
    rows = [("q", f"d{i % 3}_page_{i:04d}", float(i * 7 % 30), float(i * 11 % 30), float(i * 13 % 30)) for i in range(30)] + [("r", f"d{i}_page_0000", 1.0, 1.0, float(i % 2)) for i in range(4)]
    return spark.createDataFrame(rows, "query_id string, page_id string, bm25_score double, dense_score double, visual_score double")


def plain(rows, k=60):
    """(query, document, fusion) of the best document, and the ranks of every page."""
    out, ranks = {}, {}
    for q in {r.query_id for r in rows}:
        own = [r for r in rows if r.query_id == q]
        for c in ("bm25_score", "dense_score", "visual_score"):
            for n, r in enumerate(sorted(own, key=lambda r: (-r[c], r.page_id)), 1):
                ranks.setdefault((q, r.page_id), []).append(n)
        best = min((-sum(1 / (k + n) for n in ranks[q, r.page_id]), r.page_id.split("_page_")[0]) for r in own)
        out[q] = (best[1], round(-best[0], 12))
    return out, ranks


def test_top_document(spark):
    d = pool.top_document(scores(spark))
    assert sorts(d) <= 3
    assert {r.query_id: (r.document_id, round(r.document_rrf, 12)) for r in d.collect()} == plain(scores(spark).collect())[0]


def test_expansion(spark):
    d = pool.expand_top_document(scores(spark), 4)
    assert sorts(d) <= 5
    top, ranks = plain(scores(spark).collect())
    want = []
    for q in top:
        left = 12 - sum(min(n) <= 4 for (o, _), n in ranks.items() if o == q)
        found = sorted((-sum(1 / (60 + x) for x in n), p) for (o, p), n in ranks.items() if o == q and p.split("_page_")[0] == top[q][0] and min(n) > 4)
        want += [(q, p, i) for i, (_, p) in enumerate(found[:left], 1)]
    assert sorted((r.query_id, r.page_id, r.priority) for r in d.collect()) == sorted(want) and want
