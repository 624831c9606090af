import json

import numpy as np
import pytest

from lodestone.sources.matrices import read_matrices, write_matrices

PAGES = ["p2", "p1", "é p3"]


def rows(queries=9, channels=("bm25", "dense")):
    rng = np.random.default_rng(4)
    return sorted((f"q{i}", p, c, float(rng.normal())) for i in range(queries) for p in PAGES for c in channels)


def table(spark, data):
    return spark.createDataFrame(data, "query_id string, page_id string, channel string, score double").repartition(3)


@pytest.fixture
def folder(spark, tmp_path):
    at = f"{tmp_path}/m"
    receipts = write_matrices(table(spark, rows()), at, PAGES, "run-1", rows=2).collect()
    assert sorted((r.channel, r.block) for r in receipts) == [(c, b) for c in ("bm25", "dense") for b in range(5)]
    assert sum(r.queries for r in receipts) == 18
    return tmp_path / "m"


def test_round_trip(spark, folder):
    for path in (str(folder), f"file://{folder}"):
        assert sorted(map(tuple, read_matrices(spark, path, identity="run-1").collect())) == rows()
    with pytest.raises(FileExistsError):
        write_matrices(table(spark, rows()), str(folder), PAGES)


def test_other_channels_are_not_opened(spark, folder):
    for f in folder.glob("channel=dense/*.npy"):
        f.write_bytes(b"unreadable")
    want = [r for r in rows() if r[2] == "bm25"]
    assert sorted(map(tuple, read_matrices(spark, str(folder), ["bm25"]).collect())) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_matrices(spark, str(folder)).where("channel = 'bm25' AND page_id <> 'none'")
        assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("what,match", [("bytes", "differs from its receipt"), ("identity", "another run"), ("pages", "shape, type or values"), ("shape", "shape, type or values")])
def test_changes_raise(spark, folder, what, match):
    array, receipt = folder / "channel=dense/block-00000001.npy", folder / "channel=dense/block-00000001.json"
    if what == "bytes":
        data = bytearray(array.read_bytes())
        data[-1] ^= 1
        array.write_bytes(bytes(data))
    elif what == "pages":
        (folder / "pages.json").write_text(json.dumps(PAGES[:2]))
    else:
        held = json.loads(receipt.read_text())
        receipt.write_text(json.dumps(held | ({"identity": "run-2"} if what == "identity" else {"shape": [1, 1]})))
    with pytest.raises(Exception, match=match):
        read_matrices(spark, str(folder), identity="run-1").collect()


@pytest.mark.parametrize("change", ["lacks", "twice", "unknown", "nan", "null"])
def test_incomplete_matrices_are_refused(spark, tmp_path, change):
    data = rows()
    q, p, c, s = data[4]
    data = {"lacks": data[:4] + data[5:], "twice": data + [data[4]], "unknown": data[:4] + [(q, "p9", c, s)] + data[5:], "nan": data[:4] + [(q, p, c, float("nan"))] + data[5:], "null": data[:4] + [(q, p, c, None)] + data[5:]}[change]
    with pytest.raises(Exception, match="scores for|a score is missing"):
        write_matrices(table(spark, data), f"{tmp_path}/m", PAGES)
