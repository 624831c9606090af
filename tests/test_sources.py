"""Readers, writers and streams."""

import csv
import io
import json
import tarfile
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.contracts import ContractError
from lodestone.sources import readers, writers
from lodestone.streaming import scores

ROWS = [("q1", "a", 1.0, 2.0, 3.0), ("q1", "b", 0.5, 1.0, 0.0), ("q2", "a", 0.1, 0.2, 0.3)]
SCHEMA = "query_id string, page_id string, bm25_score double, dense_score double, visual_score double"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.write.parquet(f"{tmp_path}/a.parquet")
    df.write.csv(f"{tmp_path}/a.csv", header=True)
    df.write.json(f"{tmp_path}/a.jsonl")
    for kind in ("parquet", "csv", "jsonl"):
        assert sorted(map(tuple, readers.read_contract(spark, f"{tmp_path}/a.{kind}", "score_rows").collect())) == sorted(ROWS)
    assert readers.read_exact(spark, f"{tmp_path}/a.parquet", "score_rows").count() == 3
    with pytest.raises(ContractError):
        readers.read_table(spark, "x.xls")
    with pytest.raises(ContractError):
        readers.read_contract(spark, f"{tmp_path}/a.parquet", "raw_scores")


def test_splits_and_annotations(spark, tmp_path):
    for role, ids in {"train": "a\nb\n", "validation": " c\n", "test": "d\n\n"}.items():
        (tmp_path / f"{role}.txt").write_text(ids)
    assert {tuple(r) for r in readers.read_splits(spark, str(tmp_path)).collect()} == {("a", "train"), ("b", "train"), ("c", "validation"), ("d", "test")}
    doc = {"examples": [{"uid": "u1", "query": "what", "meta_info": {"file_name": "x.y.pdf", "reference_page": [3, 1, 3], "source_type": "table"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    a = readers.annotations(spark, f"{tmp_path}/a.json")
    assert (a.first().document_id, a.first().source) == ("x.y", "source_type=table|query_type=unknown")
    assert sorted(r.page_id for r in readers.annotation_qrels(a).collect()) == ["x.y_page_0001", "x.y_page_0003"]
    pages = spark.createDataFrame([("x.y", 1, "x.y_page_0001")], "document_id string, page_number int, page_id string")
    assert sorted(r.known for r in readers.annotation_qrels_checked(a, pages).collect()) == [False, True]


def test_ocr_words(spark, tmp_path):
    head = "level\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "w.tsv").write_text("\n".join([head, "4\t1\t1\t1\t0\t0\t9\t9\t-1\t", '5\t1\t1\t2\t1\t2\t3\t4\t91.5\t"quote', "5\t1\t1\t2\t1\t2\t3\t4\t80\t  "]))
    r = readers.tsv_words(spark, f"{tmp_path}/w.tsv").collect()
    assert [(x.text, x.confidence, x.box, x.line) for x in r] == [('"quote', 91.5, [1, 2, 4, 6], [1, 1, 2])]


def test_archives_and_inventory(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.pdf", b"one")
        z.writestr("../y.pdf", b"two")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name in ("d/p.png", "d/p.png"):
            i = tarfile.TarInfo(name)
            i.size = 3
            t.addfile(i, io.BytesIO(b"abc"))
    got = sorted((r.member, r.size_bytes, r.problem) for r in readers.archive_members(spark, str(tmp_path)).na.fill("").collect())
    assert got == [("../y.pdf", 3, "unsafe_name"), ("d/p.png", 3, ""), ("d/p.png", 3, "repeated"), ("x.pdf", 3, "")]
    assert {r.category for r in readers.file_inventory(spark, str(tmp_path)).collect()} == {"other"}


def test_publication(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    writers.publish({"rows": df, "ids": df.select("query_id").distinct()}, f"{tmp_path}/p")
    assert writers.verify(spark, f"{tmp_path}/p", {"rows": df}) == {"rows": (0, 0)}
    assert writers.verify(spark, f"{tmp_path}/p", {"rows": df.where("query_id = 'q1'").union(df.where("query_id = 'q1'"))}) == {"rows": (1, 2)}
    with pytest.raises(Exception, match="exist"):
        writers.publish({"rows": df}, f"{tmp_path}/p")
    long = df.select("query_id", "page_id", F.lit("m").alias("method"), F.col("bm25_score").alias("score"))
    writers.write_wide(long, f"{tmp_path}/w.csv", ["m"])
    assert {tuple(r) for r in readers.wide_predictions(spark, f"{tmp_path}/w.csv").collect()} == {(q, p, "m", s) for q, p, s, *_ in ROWS}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = scores.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
    want = {tuple(r) for r in scores.windowed_counts(events).select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("counts").select("start", "event_type", "n").collect()} == want


def test_score_stream(spark, tmp_path):
    """After every batch, the metrics of its queries are those of all rows so far;
    a batch reads its own file only."""
    rng = np.random.default_rng(6)
    kinds = "query_id string, page_id string, score double, relevance double"
    parts = [[(f"q{rng.integers(5)}", f"p{b}{i:02d}", float(rng.integers(0, 6)), float(rng.integers(0, 4) * (rng.random() < 0.3))) for i in range(30)] for b in range(4)]
    for part in parts:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files come in the order of their times
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = scores.evaluate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [30] * 4
    for b in range(4):
        known = [r for part in parts[: b + 1] for r in part]
        want = {r.query_id: r for r in metrics.evaluate(spark.createDataFrame(known, kinds), "score").collect()}
        got = spark.read.parquet(f"{tmp_path}/out/part={b}").collect()
        assert {r.query_id for r in got} == {r[0] for r in parts[b]}
        for r in got:
            w = want[r.query_id]
            assert all(getattr(r, c) == pytest.approx(getattr(w, c), abs=1e-12) for c in ("ndcg10", "recall1", "recall3", "mrr10"))
    # a later run goes on from the state
    spark.createDataFrame([("q0", "new", 99.0, 3.0)], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    scores.evaluate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out/part=4").collect()
    assert [(r.query_id, r.mrr10) for r in last] == [("q0", 1.0)]


def test_canonical_lists(spark, tmp_path):
    rows = [(f"d{i % 7}", f"d{i % 7}_page_{i:04d}", i, None if i % 5 == 0 else f'a "quoted", path\n{i}', i % 2 == 0) for i in range(200)]
    kinds = "document_id string, page_id string, page_number int, source_path string, leak boolean"
    df = spark.createDataFrame(rows, kinds).repartition(6)
    writers.write_canonical(df, f"{tmp_path}/m", "manifest")
    lines = []
    for f in sorted((tmp_path / "m").glob("part-*.csv")):
        with f.open(newline="") as stream:
            head, *body = list(csv.reader(stream))
        assert head == ["document_id", "page_id", "page_number", "source_path", "leak"]
        lines += body
    want = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    assert lines == [[r[0], r[1], str(r[2]), r[3] or "", str(r[4]).lower()] for r in want]
    plain = df.drop("source_path")
    writers.write_canonical(plain, f"{tmp_path}/p", "manifest")
    ok = writers.canonical_faults(spark, f"{tmp_path}/p", "manifest", "document_id string, page_id string, page_number int, leak boolean").collect()
    assert sum(r.rows for r in ok) == 200 and not any(r.descents or r.overlaps for r in ok)
    plain.orderBy(F.desc("page_number")).coalesce(1).write.csv(f"{tmp_path}/x", header=True)
    odd = writers.canonical_faults(spark, f"{tmp_path}/x", "manifest", "document_id string, page_id string, page_number int, leak boolean").first()
    assert odd.descents > 100
    with pytest.raises(Exception, match="already exists"):
        writers.write_canonical(df, f"{tmp_path}/m", "manifest")


def test_annotation_faults(spark, tmp_path):
    doc = "a" * 40
    one = lambda uid, query="q", file=f"{doc}.pdf", pages=(1, 2): {"uid": uid, "query": query, "meta_info": {"file_name": file, "reference_page": list(pages), "source_type": "t", "query_type": "s"}}
    good = [one(f"{doc}_1"), one(f"{doc}_2")]
    (tmp_path / "good.json").write_text(json.dumps({"examples": good}))
    assert readers.checked_annotations(spark, f"{tmp_path}/good.json").count() == 2
    bad = [one("short_1"), one(f"{doc}_3", file="other.pdf"), one(f"{doc}_4", query="  "), one(f"{doc}_5", pages=()), one(f"{doc}_6", pages=(0,)), one(f"{doc}_7", pages=(2, 2)), one(f"{doc}_8"), one(f"{doc}_8"), one(f"{doc}_"), one(doc)]
    (tmp_path / "bad.json").write_text(json.dumps({"examples": good + bad}))
    found = {}
    for r in readers.annotation_faults(readers.annotations(spark, f"{tmp_path}/bad.json")).collect():
        found.setdefault(r.fault, []).append(r.query_id.removeprefix(doc))
    assert found == {"uid": found["uid"], "file_name": ["_3"], "query": ["_4"], "no_pages": ["_5"], "page_number": ["_6"], "repeated_page": ["_7"], "repeated_uid": ["_8", "_8"]}
    assert sorted(found["uid"]) == ["", "_", "short_1"]
    with pytest.raises(ContractError, match="'repeated_uid': 2"):
        readers.checked_annotations(spark, f"{tmp_path}/bad.json")
