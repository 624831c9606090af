"""What an epoch costs: records are packed once, orders made in one pass, a
batch's records computed together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import training
from lodestone.operators.training import Settings
from test_training import NAMES, rows_of, table


@pytest.mark.parametrize("level,hidden", [("page", 0), ("query", 0), ("page", 4), ("query", 4)])
@pytest.mark.parametrize("scale", [1, 1000])  # exponentials of the latter are not finite
def test_records_together_are_records_apart(level, hidden, scale):
    s, rng, batch = Settings(level=level, hidden=hidden, temperature=0.7), np.random.default_rng(5), []
    for n in (1, 2, 9, 30, 30):
        batch.append((rng.random((len(NAMES), n)) * scale, rng.random(n) < 0.4))
    p = training.start(s).parameters
    apart = [training.gradient(p, s, v.T, v[:3].T, h) for v, h in batch]
    apart = [np.concatenate([[g[0]], g[1]]) for g in apart if g is not None]
    count, sums = training.batch_sums(p, s, batch)
    assert count == len(apart) and np.abs(sums * training.UNIT - np.sum(apart, 0)).max() < 1e-11 * scale
    assert training.batch_sums(p, s, [(v, np.ones_like(h)) for v, h in batch]) == (0, None)


def test_epochs_share_a_pass_and_ranges_are_single_tasks(spark, monkeypatch):
    rows, check = table(spark, rows_of(40, 11)), table(spark, rows_of(6, 12))
    passes, tasks = [], []
    numbers, steps = training.hash_numbers, training._steps
    monkeypatch.setattr(training, "hash_numbers", lambda *a, **k: passes.append(1) or numbers(*a, **k))
    monkeypatch.setattr(training, "_steps", lambda own, *a: tasks.append(own.rdd.getNumPartitions()) or steps(own, *a))
    monkeypatch.setattr(training, "RANGE", 8)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    s = Settings(epochs=3, batch=4)
    whole = training.train(rows, check, s)
    assert len(passes) == 1 and tasks == [1] * 15
    monkeypatch.setattr(training, "ORDERS", 2)
    assert training.train(rows, check, s).dumps(s) == whole.dumps(s) and len(passes) == 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


def test_batches_of_each_epoch(spark):
    rows, s = spark.range(50).select(F.col("id").cast("string").alias("query_id")), Settings(batch=8)
    got = dict(map(tuple, training.batched(rows, [3, 4], s).collect()))
    for i, epoch in enumerate((3, 4)):
        order = [r.query_id for r in rows.orderBy(training.order_key(F.lit(epoch), s.seed)).collect()]
        assert [got[q][i] for q in order] == [n // 8 for n in range(50)]


def test_values_lie_once_in_a_record(spark):
    row = training.records(table(spark, rows_of(1, 2, 200)), Settings()).first()
    assert len(row.block) < row.pages * (8 * len(NAMES) + 1) + 200
