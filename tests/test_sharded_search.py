import json
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import oracle, page_oracle
from lodestone.plans.sharded import ShardedSearch
from lodestone.sources.ledger import Ledger, LedgerError

SHARDS = 3


def scores_of(spark, seed=1, queries=11):
    rng = np.random.default_rng(seed)
    rows = [(f"q{q}", f"p{p:02d}", float(rng.random() < 0.2), *map(float, rng.random(3))) for q in range(queries) for p in range(13)]
    return spark.createDataFrame(rows, "query_id string, page_id string, relevance double, bm25_score double, dense_score double, visual_score double")


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def search(scores, folder, **kw):
    return ShardedSearch(scores, oracle.W7, str(folder), shards=SHARDS, **kw)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    return rows(search(scores_of(spark), folder).run()), folder


def test_equals_the_plain_search(spark, whole):
    d = scores_of(spark)
    want = oracle.oracle_rows(d, oracle.W7).drop("delta").join(page_oracle.page_oracle(d, oracle.W7).select("query_id", "page_ndcg10", "changed", "updates"), "query_id")
    got = whole[0]
    for a, b in zip(got, rows(want), strict=True):
        assert all(x == pytest.approx(y, abs=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("ends", [(1,), (2, 2), (4, 1, 1), (6,)])
def test_goes_on_after_any_end(spark, whole, tmp_path, ends):
    done = 0
    for n in ends:
        assert search(scores_of(spark), tmp_path).run(stop_after=n) is None
        done += n
        assert len(search(scores_of(spark), tmp_path).ledger.entries) == done
    # what a run wrote without entering it is written again
    half = tmp_path / "search" / "shard=1"
    half.mkdir(parents=True, exist_ok=True)
    (half / "part-00000.parquet").write_bytes(b"half")
    again = search(scores_of(spark).repartition(2), tmp_path)
    assert rows(again.run()) == whole[0]
    assert len(again.ledger.entries) == 2 + 2 * SHARDS
    again.verify()
    # a finished run starts nothing anew
    assert list(search(scores_of(spark), tmp_path)._steps()) == []


def copy_of(folder, to):
    shutil.copytree(folder, to, dirs_exist_ok=True)
    for crc in Path(to).rglob(".*.crc"):
        crc.unlink()
    return Path(to)


def test_other_inputs_and_settings_are_refused(spark, whole):
    for other in (lambda: search(scores_of(spark, 2), whole[1]), lambda: search(scores_of(spark), whole[1], sweeps=1), lambda: ShardedSearch(scores_of(spark), oracle.W7, str(whole[1]), shards=4)):
        with pytest.raises(LedgerError, match="entry 0"):
            other()


def test_a_broken_chain_is_refused(spark, whole, tmp_path):
    folder = copy_of(whole[1], tmp_path / "a")
    entry = folder / "log" / "00000003.json"
    held = json.loads(entry.read_text())
    entry.write_text(json.dumps(held | {"content": held["content"] | {"row_count": "99"}}))
    with pytest.raises(LedgerError, match="entry 3"):
        search(scores_of(spark), folder)
    folder = copy_of(whole[1], tmp_path / "b")
    (folder / "log" / "00000002.json").unlink()
    with pytest.raises(LedgerError, match="entry 2"):
        search(scores_of(spark), folder)


def test_a_changed_shard_is_found(spark, whole, tmp_path):
    folder = copy_of(whole[1], tmp_path / "a")
    spark.read.parquet(f"{whole[1]}/search/shard=2").withColumn("updates", F.col("updates") + 1).write.mode("overwrite").parquet(f"{folder}/search/shard=2")
    with pytest.raises(LedgerError, match="shard 2 of search"):
        search(scores_of(spark), folder).verify()


def test_entries_are_never_replaced(spark, tmp_path):
    a, b = Ledger(spark, str(tmp_path), "x"), Ledger(spark, str(tmp_path), "x")
    a.commit({"step": "one"})
    with pytest.raises(LedgerError, match="another run"):
        b.commit({"step": "two"})
    assert Ledger(spark, str(tmp_path), "x").contents() == [{"step": "one"}]


def test_publication_digest_is_that_of_the_files(spark, tmp_path):
    from lodestone.operators.audit import fingerprint
    from lodestone.sources import writers

    d = scores_of(spark).repartition(7)
    seen = writers.write_observed(d, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert seen == {k: str(v) for k, v in fingerprint(back, sorted(back.columns)).first().asDict().items()}
    empty = writers.write_observed(d.where("false"), f"{tmp_path}/e")
    assert empty["row_count"] == "0"
    parts = writers.write_observed(d, f"{tmp_path}/p", by=["query_id"])
    assert parts == seen and spark.read.parquet(f"{tmp_path}/p").count() == d.count()
