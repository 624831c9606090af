import pytest
from pyspark.sql import functions as F

from lodestone.operators import replay
from lodestone.plans import queries_replay


@pytest.mark.parametrize("states,bad", [
    (["RENDERED", "NATIVE", "OCR_OK", "RESOLVED"], None), (["RENDERED", "NATIVE", "NO_TEXT_DETECTED", "RESOLVED"], None), (["RENDER_ERROR"], None), ([], None),
    (["NATIVE"], "NATIVE"), (["RENDERED", "OCR_OK", "RESOLVED"], "OCR_OK"), (["RENDERED", "NATIVE", "OCR_TIMEOUT", "RESOLVED"], "RESOLVED"), (["RENDERED", None], "null"), (["RENDERED", "NATIVE", "NO_TEXT_DETECTED", "OCR_PARSE_ERROR"], "OCR_PARSE_ERROR"),
])
def test_states(spark, states, bad):
    df = spark.createDataFrame([(states,)], "states array<string>")
    assert df.select(replay.state_fault("states").alias("s")).first().s == bad


def test_schedule(spark):
    pages = [(f"d{d}_page_{n:04d}", f"d{d}", n, f"s{d}") for d in range(5) for n in range(1, 4)]
    kinds = "page_id string, document_id string, page_number int, source_sha256 string"
    df = spark.createDataFrame(pages, kinds)
    a, b = replay.schedule(df.repartition(3), "x"), replay.schedule(df.repartition(2), "x")
    assert sorted(r.position for r in a.collect()) == list(range(1, 16))
    assert replay.schedule_digest(a) == replay.schedule_digest(b) != replay.schedule_digest(replay.schedule(df, "y"))
    assert replay.schedule_faults(a).collect() == []
    odd = [("d0_page_1", "d0", 1, "s0"), *pages[1:3], *pages[4:9], (*pages[9][:3], "other"), *pages[10:]]
    assert {r.document_id: r.fault for r in replay.schedule_faults(spark.createDataFrame(odd, kinds)).collect()} == {"d0": "page_id", "d1": "page_sequence", "d3": "source"}


def records(spark):
    good = []
    for d in range(3):
        for n in range(1, 4):
            good.append((f"d{d}_page_{n:04d}", f"d{d}", n, f"s{d}", ["RENDERED", "NATIVE", "OCR_OK", "RESOLVED"], False, "ok", f"text {d} {n}"))
    df = spark.createDataFrame(good, "page_id string, document_id string, page_number int, source_sha256 string, states array<string>, technical_failure boolean, reason string, native string")
    df = df.withColumn("text", F.upper("native")).withColumn("native_sha256", F.sha2("native", 256)).withColumn("text_sha256", F.sha2("text", 256)).withColumn("d", replay.record_digest())
    all_ = df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "d"))).alias("all"))
    upto = F.filter("all", lambda x: x["page_number"] <= F.col("page_number"))
    return df.join(all_, "document_id").withColumn("chain", F.aggregate(upto, F.col("document_id"), lambda a, x: F.sha2(F.concat(a, x["d"]), 256))).drop("all", "d")


CHANGES = {
    "identity": {"source_sha256": "'z'"}, "states": {"states": "array('RENDERED', 'RESOLVED')"}, "failure": {"technical_failure": "true"}, "native_hash": {"native": "'else'"},
    "text_hash": {"text": "'else'"}, "resolution": {"text": "'else'", "text_sha256": "sha2('else', 256)"}, "chain": {"chain": "'z'"},
}


@pytest.mark.parametrize("fault", [None, *CHANGES, "missing", "orphan", "repeated"])
def test_each_fault(spark, fault):
    df = records(spark)
    plan = replay.schedule(df.select("page_id", "document_id", "page_number", "source_sha256"), "x")
    at = F.col("page_id") == "d1_page_0002"
    if fault in CHANGES:
        df = df.withColumns({c: F.when(at, F.expr(v)).otherwise(F.col(c)) for c, v in CHANGES[fault].items()})
    elif fault == "missing":
        df = df.where(~at)
    elif fault == "orphan":
        plan = plan.where(~at)
    elif fault == "repeated":
        df = df.unionByName(df.where(at))
    out = replay.replay(plan, df, queries_replay.resolved())
    got = {(r.page_id, r.fault) for r in out.collect() if r.fault}
    # a changed or missing link also breaks the next record's
    after = {("d1_page_0003", "chain")} if fault in ("chain", "missing") else set()
    assert got == ({("d1_page_0002", fault)} if fault else set()) | after
    firsts = {r.fault: (r.records, r.first_page) for r in replay.first_faults(out).collect()}
    assert fault is None or firsts[fault][0] == (2 if fault in ("chain", "repeated") else 1)
