from helpers import table

import corpus_pipeline


def _row(i, text):
    return (i, text, "en", "s", len(text), None, None, None)


def test_rows_without_an_id_and_repeated_ids(spark, sf):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    data = [_row(1, a), _row(None, a + "more"), _row(None, b), _row(None, c), _row(None, c), _row(5, a + "end"), _row(5, "another text with the same id as one that goes"), _row(1, "another text of one")]
    got = corpus_pipeline.near_duplicates(spark, table(spark, data), sf)
    assert got.columns == table(spark, data).columns
    want = [data[0], data[2], data[3], data[4], data[6], data[7]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
