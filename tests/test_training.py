import hashlib
import random

import numpy as np
import pytest

from lodestone.operators import gate, training
from lodestone.operators.training import Settings, State

NAMES = tuple(gate.FEATURES)


def rows_of(n_queries, seed, pages=7):
    rng, out = random.Random(seed), []
    for q in range(n_queries):
        for p in range(rng.randint(1, pages)):
            x = [rng.random() for _ in range(3)]
            f = x + [rng.random() for _ in range(len(NAMES) - 3)]
            out.append((f"q{q}", f"p{p:02d}", float(rng.random() < 0.2 + 0.4 * x[0]), *f))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "query_id string, page_id string, relevance double, " + ", ".join(f"{n} double" for n in NAMES)).repartition(5)


def plain_scores(p, s, f, x):
    layers = training.unpack(p, s)
    out = []
    for i in range(len(f)):
        v = f[i] if s.level == "page" else np.mean(f, 0)
        if s.hidden:
            v = np.tanh(layers[0] @ v + layers[1])
        e = np.exp((layers[-2] @ v + layers[-1]) / s.temperature)
        out.append(float(e / e.sum() @ x[i]))
    return np.array(out)


def plain_loss(p, s, f, x, y):
    z = plain_scores(p, s, f, x)
    return np.mean([np.log1p(np.exp(b - a)) for a in z[y] for b in z[~y]])


@pytest.mark.parametrize("level,hidden", [("page", 0), ("query", 0), ("page", 4), ("query", 4)])
def test_gradient_by_differences(level, hidden):
    s = Settings(level=level, hidden=hidden, temperature=0.7)
    rng = np.random.default_rng(1)
    p = training.start(s).parameters
    f, x, y = rng.random((6, len(NAMES))), rng.random((6, 3)), np.array([1, 0, 0, 1, 0, 0], bool)
    loss, slope = training.gradient(p, s, f, x, y)
    assert loss == pytest.approx(plain_loss(p, s, f, x, y), abs=1e-12)
    for i in range(len(p)):
        d = np.zeros(len(p))
        d[i] = 1e-6
        assert slope[i] == pytest.approx((plain_loss(p + d, s, f, x, y) - plain_loss(p - d, s, f, x, y)) / 2e-6, abs=1e-8)
    assert training.gradient(p, s, f, x, np.ones(6, bool)) is None


def plain_train(rows, held, s):
    """Whole training in one process: hash order, Adam by its formulas."""

    def packed(rows):
        out = {}
        for r in sorted(rows):
            out.setdefault(r[0], []).append(r)
        return {q: (np.array([r[3:] for r in v]), np.array([r[3:6] for r in v]), np.array([r[2] > 0 for r in v])) for q, v in out.items()}

    data, check = packed(rows), packed(held)
    p = training.start(s).parameters
    m, v, t, best = np.zeros_like(p), np.zeros_like(p), 0, None
    for epoch in range(1, s.epochs + 1):
        order = sorted(data, key=lambda q: (hashlib.sha256(f"{s.seed}:{epoch}:{q}".encode()).hexdigest(), q))
        for at in range(0, len(order), s.batch):
            found = [g for q in order[at : at + s.batch] if (g := training.gradient(p, s, *data[q]))]
            if not found:
                continue
            g = np.mean([x[1] for x in found], 0)
            g = g * min(1, s.clip / (np.linalg.norm(g) + 1e-6)) + s.decay * p
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        value = np.mean([training.ndcg(plain_scores(p, s, f, x), y, int(y.sum())) for f, x, y in check.values()])
        if best is None or value > best[1] + 1e-11:
            best = (epoch, value)
    return p, best


def same(a: State, b: State) -> bool:
    return a.dumps(Settings()) == b.dumps(Settings())


def test_training_equals_one_process_and_resumes(spark, tmp_path):
    rows, held = rows_of(37, 3), rows_of(12, 4)
    s = Settings(epochs=3, batch=8, rate=0.05, decay=0.01, clip=0.05, hidden=3)
    train, check = table(spark, rows), table(spark, held)
    whole = training.train(train, check, s)
    p, best = plain_train(rows, held, s)
    assert np.abs(whole.parameters - p).max() < 1e-9
    assert (whole.best["epoch"], whole.best["ndcg10"]) == (best[0], pytest.approx(best[1], abs=1e-9))
    assert whole.history[-1]["loss"] < whole.history[0]["loss"]
    # interrupted after one epoch, then continued from what was written, on other partitions
    d = str(tmp_path / "states")
    assert training.train(train, check, s, directory=d, stop_after=1).epoch == 1
    again = training.train(train.repartition(2), check.coalesce(1), s, directory=d)
    assert same(again, whole) and same(training.train(train, check, s, directory=d), whole)
    with pytest.raises(ValueError, match="other settings"):
        training.train(train, check, Settings(epochs=4, batch=8), directory=d)


def test_refuses_what_cannot_be_learnt(spark):
    rows = [(q, p, 1.0, *r) for q, p, _, *r in rows_of(4, 1)]
    with pytest.raises(ValueError, match="nothing to learn"):
        training.train(table(spark, rows), table(spark, rows), Settings(epochs=1))
    with pytest.raises(ValueError, match="nothing to learn"):
        training.train(table(spark, rows_of(4, 1)), table(spark, []), Settings(epochs=1))
    broken = [(*r[:3], float("nan"), *r[4:]) for r in rows_of(9, 1)]
    with pytest.raises(Exception, match="not finite"):
        training.train(table(spark, broken), table(spark, rows_of(4, 1)), Settings(epochs=1))


def test_relevant_pages_outside_the_pool_count(spark):
    rows = table(spark, rows_of(6, 8))
    s = Settings()
    less = training.mean_ndcg(training.records(rows.selectExpr("*", "9 AS relevant_total"), s), training.start(s).parameters, s)
    assert 0 < less < training.mean_ndcg(training.records(rows, s), training.start(s).parameters, s)


def test_query_equals_one_process(spark, sf, monkeypatch):
    from lodestone.plans import queries_runs
    from lodestone.plans.catalogue import queries

    s = Settings(epochs=2)
    monkeypatch.setattr(queries_runs, "SETTINGS", s)
    rows = {role: [tuple(r) for r in queries_runs.split_features(spark, sf).where(f"role = '{role}'").select("query_id", "page_id", "relevance", *NAMES).collect()] for role in ("train", "validation")}
    got = queries()["q7_o6_stochastic_gate"](spark, sf).orderBy("parameter").collect()
    s = Settings(epochs=got[0].epoch)  # the parameters are those of the best epoch
    p, _ = plain_train(rows["train"], rows["validation"], s)
    assert np.abs(np.array([r.value for r in got]) - p).max() < 1e-6  # the query rounds to six digits


def test_matched_settings():
    training.matched(Settings(level="query", hidden=3), Settings(level="page", hidden=3))
    for other in (Settings(level="page"), Settings(level="query", seed=1), Settings(level="query", hidden=2), Settings(level="query", epochs=20, rate=1)):
        with pytest.raises(ValueError, match="level alone"):
            training.matched(Settings(level="page"), other)


def test_ranges_are_jobs_and_batches_are_not(spark, monkeypatch):
    rows, check = table(spark, rows_of(40, 11)), table(spark, rows_of(6, 12))
    s, seen = Settings(epochs=2, batch=4), []
    inner = training._steps
    monkeypatch.setattr(training, "_steps", lambda *a: seen.append(1) or inner(*a))
    whole = training.train(rows, check, s)
    assert len(seen) == 2 and whole.steps > 10  # a job an epoch
    monkeypatch.setattr(training, "RANGE", 8)
    cut = training.train(rows.repartition(3), check, s)
    assert len(seen) == 2 + 2 * 5 and same(cut, whole)
