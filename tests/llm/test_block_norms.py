import hashlib
import math
import random

import numpy as np

from lodestone.llm import block_norms

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q int, norms string, centroid int"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v), []).append(v)
        for c, vs in held.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, near(v), far(v, cents[near(v)])) for i, v in kept]
    each = {}
    for _, c, d in out:
        each[c] = each.get(c, 0) + d
    return sorted(((i, c, d, each[c], sum(each.values()), cents[c]) for i, c, d in out), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x", 2, "y", 3) for i, e in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, block_norms.cluster_vectors(df, **kw).collect()), key=repr)


def test_awkward_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.001, 0.0, 0.25, 3.0]) + (i % 4) for _ in range(8)]) for i in range(60)]
    rows += [rows[3]] * 4 + [(None, rows[5][1]), (None, [0.5] * 8)]
    rows += [(70, None), (71, []), (72, [1.0] * 7), (73, [1.0] * 7 + [None]), (74, [float("nan")] * 8), (75, [float("inf")] + [0.0] * 7), (76, [float("-inf")] * 8)]
    for k, rounds in ((8, 10), (3, 0), (1, 2)):
        assert got(spark, rows, clusters=k, rounds=rounds, dimension=8, segments=4) == brute(rows, k, rounds, 8)


def test_few_equal_and_no_vectors(spark):
    same = [(7, [1.0] * 8)] * 5
    assert got(spark, same, dimension=8, segments=2) == brute(same, 8, 10, 8)
    assert got(spark, [(1, None)], dimension=8) == []
    assert got(spark, [], dimension=8) == []


def test_screening_leaves_out_and_loses_nothing():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-4000, 4000, (8, 64))
    q = np.concatenate([centroids[rng.integers(0, 8, 500)] + rng.integers(-300, 300, (500, 64)), rng.integers(-5, 5, (300, 64)), (centroids[:1] + centroids[1:2]) // 2])
    cluster, distance, exact = block_norms.nearest(q, block_norms._norms(q, 8), centroids)
    all_ = np.square(q[:, None] - centroids[None]).sum(2)
    assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert len(q) <= exact < 0.7 * all_.size
