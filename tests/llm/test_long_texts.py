"""Texts longer than what is handled at once, through every operator of texts."""

import random

import pytest

from lodestone.llm import common, importance, langmix, lattice, licences, line_runs, media, mixing, ngram_join, periodic_runs, tiling


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    assert len(long) > common.SLICE_BYTES
    lines = "\n".join(" ".join(rng.choice(words) for _ in range(9)) + " and this end of it" for _ in range(40_000))
    twin = long.replace(" ", "  ", 1)  # the same words
    rows = [(1, long, "en", "a"), (2, twin, "en", "b"), (3, lines, "de", "a"), (4, "short text", "de", "b"), (5, "x" * (common.SLICE_BYTES + 5), None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_counts_and_sets(spark, docs):
    near = by_id(ngram_join.jaccard_classes(docs, k=5, percent=80))
    assert near[2].component_id == 1 and near[3].component_id == 3 and near[1].n_links == 1
    assert by_id(mixing.systematic_mix(docs))[1].size == 400_000
    assert by_id(line_runs.dedup_lines(docs, min_docs=1))[3].n_lines == 40_000


def test_scores(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert by_id(importance.resample(docs, labels))[1].n_features > 400_000
    assert by_id(langmix.identify(docs))[1].lang_pred in ("en", "de")
    scores = by_id(lattice.lattice_scores(docs))
    assert scores[1].n_tokens == 400_001 and scores[1].score == pytest.approx(scores[2].score, rel=1e-9) and scores[5].n_tokens == 2


def test_bytes_lines_and_places(spark, docs):
    stored = by_id(media.media_features(media.to_media(docs)))
    assert stored[5].n_bytes == common.SLICE_BYTES + 5
    files = docs.selectExpr("doc_id AS file_id", "concat('a/', doc_id, '.txt') AS path", "text")
    assert licences.scan_licences(files).count() == 5
    item = docs.where("doc_id = 1").selectExpr("1L AS item_id", "substring(text, 1500000, 400) AS text")
    assert {r.doc_id for r in tiling.contaminations(docs, item).collect()} == {1, 2}
    runs = by_id(periodic_runs.periodic_runs(docs.where("doc_id > 2").unionByName(docs.where("doc_id = 4").selectExpr("9L AS doc_id", "repeat('round and about ', 150000) AS text", "lang", "source"))))
    assert (runs[9].n_runs, runs[9].length, runs[9].period, runs[9].collapsed) == (1, 450_000, 3, "round and about") and runs[5].n_words == 1
