"""Operators and stages whose rows keep their columns, over columns with the
names that are used inside, in both cases and with and without underscores."""

import pytest
from helpers import table

import corpus_pipeline
from lodestone.llm import langmix, line_runs, mixing, ngram_join, tiling

INSIDE = """gone gone_id gone_row lines cuts whole any own sig set lost letters id_ mark n total left step i row r d t t_id t_mark more h1 h2 keeper
  copies root shape __gone __gone_id __gone_row __lines __cuts __id __row __n __total __sig __letters __set component_id held_out n_links number""".split()
AT_A_TIME = 30


def crowded(spark, names):
    df = table(spark)
    df = df.drop(*[c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")])
    return df.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("at", range(0, len(INSIDE), AT_A_TIME))
def test_names_used_inside(spark, sf, at):
    names = INSIDE[at : at + AT_A_TIME]
    plain, docs = crowded(spark, []), crowded(spark, names)
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "item_id long, text string")
    cases = {
        "lines": lambda d: line_runs.dedup_lines(d),
        "near": lambda d: ngram_join.first_of_classes(d, 3, 90),
        "language": lambda d: langmix.keep_identified(d, corpus_pipeline.LEAST_SHARE),
        "tiling": lambda d: tiling.decontaminate(d, benchmark),
        "mixture": lambda d: mixing.mixture(d),
    }
    own = ["doc_id", "text", "lang", "source"]
    for case, f in cases.items():
        got = f(docs)
        assert set(docs.columns) <= set(got.columns), case
        if case != "mixture":  # its offsets of equal rows depend on all columns
            assert rows(got, own) == rows(f(plain), own), case
        for r in got.collect():
            assert all(r[c] is None if r.doc_id is None else r[c] == f"{c}{r.doc_id}" for c in names), case


def test_other_case_of_a_name(spark):
    docs = crowded(spark, ["Gone", "LINES", "ID_", "Letters"])
    for f in (line_runs.dedup_lines, mixing.mixture, lambda d: langmix.keep_identified(d, 0.35), lambda d: ngram_join.first_of_classes(d, 3, 90)):
        assert {"Gone", "LINES", "ID_", "Letters"} <= set(f(docs).columns)


def test_maps_inside_other_types(spark):
    docs = table(spark).selectExpr("doc_id", "text", "source", "array(map('a', n_chars)) AS listed", "struct(map(1, map('b', doc_id)) AS m) AS nested", "map('k', text) AS plain")
    got = mixing.mixture(docs)
    assert got.columns == [*docs.columns, "copy"] and got.count() > 0
