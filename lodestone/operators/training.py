"""Training of the gate by stochastic gradient steps.

A query's candidates are one record: its features, normalized scores and labels
in page order, packed into bytes once. An epoch orders the queries by a seeded
hash and cuts them into batches of equal size; a batch's loss and gradient are
sums over its records, which are computed side by side. The sums are whole
numbers of 2**-44, so they do not depend on the order of records, and a run gives
the same bits every time, interrupted or not. A step starts from the one before
it, so a task goes through the batches of a range of some thousand records and
hands the parameters and the optimiser's moments to the next range by the driver:
a job of one task a range, not one a batch. The orders of many epochs are made in
one pass; an epoch moves each record once.

After every epoch the validation queries are ranked and the epoch with the best
mean nDCG@10 is remembered, the earlier one among equals. A state is a line of
JSON, written once an epoch and bound to a hash of the settings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import changes
from .gate import FEATURES, SHORT
from .ranking import hash_numbers

XS = [f"{c}_minmax" for c in SHORT]
#: Sums are whole numbers of this.
UNIT = 2.0**-44
TOP = 10
#: Records that a task steps through, and those that it is handed at a time, so
#: that it computes while the next are read.
RANGE, HANDED = 8192, 512
#: Epochs whose orders are made in one pass.
ORDERS = 20
_BETA1, _BETA2, _EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    """level: the weights of a page come from its own features, or from their
    means over the query; hidden: units of a tanh layer, 0 for none."""

    level: str = "page"
    hidden: int = 0
    epochs: int = 20
    batch: int = 16
    rate: float = 0.01
    decay: float = 0.0
    clip: float = 5.0
    temperature: float = 1.0
    seed: int = 2026
    features: tuple[str, ...] = tuple(FEATURES)

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass
class State:
    """Everything that the next epoch needs."""

    parameters: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    best: dict | None = None
    history: list[dict] = field(default_factory=list)

    def dumps(self, settings: Settings) -> str:
        arrays = {k: getattr(self, k).tolist() for k in ("parameters", "first", "second")}
        return json.dumps(arrays | {"steps": self.steps, "epoch": self.epoch, "best": self.best, "history": self.history, "settings": settings.identity()})

    @staticmethod
    def loads(text: str, settings: Settings) -> State:
        held = json.loads(text)
        if held.pop("settings") != settings.identity():
            raise ValueError("this state belongs to other settings")
        return State(**held | {k: np.array(held[k]) for k in ("parameters", "first", "second")})


def shapes(s: Settings) -> list[tuple[int, ...]]:
    n = len(s.features)
    return ([(s.hidden, n), (s.hidden,)] if s.hidden else []) + [(3, s.hidden or n), (3,)]


def unpack(parameters: np.ndarray, s: Settings) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(x)) for x in shapes(s)])
    return [p.reshape(x) for p, x in zip(np.split(parameters, ends[:-1]), shapes(s))]


def start(s: Settings) -> State:
    """Parameters uniform below the inverse root of each layer's width, equal for
    both levels."""
    rng, parts = np.random.default_rng(s.seed), []
    for i, shape in enumerate(shapes(s)):
        width = shapes(s)[i - i % 2][1]
        parts.append(rng.uniform(-1, 1, int(np.prod(shape))) / np.sqrt(width))
    p = np.concatenate(parts)
    return State(p, np.zeros_like(p), np.zeros_like(p))


def matched(left: Settings, right: Settings) -> None:
    """Two trainings may be compared if their settings differ in the level alone;
    then they start from the same parameters and meet the queries in the same
    order. Raises ValueError with what else differs."""
    apart = changes(asdict(left), asdict(right))
    if set(apart) != {"level"}:
        raise ValueError(f"matched settings differ in the level alone, these in {apart}")
    if not np.array_equal(start(left).parameters, start(right).parameters):
        raise ValueError("matched trainings start from the same parameters")


# ---------------------------------------------------------------- one record
def forward(parameters: np.ndarray, s: Settings, f: np.ndarray, x: np.ndarray):
    """Scores of a record's pages, and what the gradient needs."""
    layers = unpack(parameters, s)
    given = f if s.level == "page" else f.mean(0, keepdims=True)
    units = np.tanh(given @ layers[0].T + layers[1]) if s.hidden else given
    logits = (units @ layers[-2].T + layers[-1]) / s.temperature
    gate = np.exp(logits - logits.max(1, keepdims=True))
    gate /= gate.sum(1, keepdims=True)
    return (gate * x).sum(1), (given, units, gate, layers)


def gradient(parameters: np.ndarray, s: Settings, f: np.ndarray, x: np.ndarray, positive: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Loss and gradient of one query: the mean logistic loss of its positive over
    its negative pages. None where it lacks either."""
    if positive.all() or not positive.any():
        return None
    score, (given, units, gate, layers) = forward(parameters, s, f, x)
    apart = score[~positive][None, :] - score[positive][:, None]
    pull = 1 / (1 + np.exp(-apart)) / apart.size
    slope = np.empty(len(score))
    slope[positive], slope[~positive] = -pull.sum(1), pull.sum(0)
    back = slope[:, None] * gate * (x - score[:, None]) / s.temperature
    if s.level != "page":
        back = back.sum(0, keepdims=True)
    parts = [back.T @ units, back.sum(0)]
    if s.hidden:
        inner = back @ layers[-2] * (1 - units**2)
        parts = [inner.T @ given, inner.sum(0), *parts]
    return float(np.logaddexp(0, apart).mean()), np.concatenate([p.reshape(-1) for p in parts])


def ndcg(score: np.ndarray, positive: np.ndarray, total: int) -> float:
    """Binary nDCG@10 against all positives; pages come in order of their ids."""
    order = np.argsort(-score, kind="stable")[:TOP]
    weight = 1 / np.log2(np.arange(2, TOP + 2))
    ideal = weight[: min(TOP, total)].sum()
    return float((positive[order] * weight[: len(order)]).sum() / ideal) if ideal else 0.0


# ---------------------------------------------------------------- side by side
def _slopes(score: np.ndarray, hit: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean logistic losses of records' positive over negative pages, whose scores
    lie one after another, and their gradient by the scores. A record's pairs are
    products of exponentials of its pages, filled up with zeros to the longest."""
    records = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    slope, places, sides = np.empty(len(score)), [], []
    for own, sign in ((hit, -1), (~hit, 1)):
        pages = np.flatnonzero(own)
        record = records[pages]
        count = np.bincount(record, minlength=len(edges) - 1)
        place = record, np.arange(len(pages)) - (np.cumsum(count) - count)[record]
        side = np.zeros((len(count), count.max()))
        side[place] = np.exp(sign * score[pages])
        places.append((pages, place, count))
        sides.append(side)
    ratio = sides[0][:, :, None] * sides[1][:, None, :]
    more = 1 + ratio
    pairs = places[0][2] * places[1][2]
    loss = np.log(more.prod(1)).sum(1) / pairs
    ratio /= more
    for (pages, place, _), axis, sign in zip(places, (2, 1), (-1, 1)):
        slope[pages] = sign * (ratio.sum(axis) / pairs[:, None])[place]
    return loss, slope


def batch_sums(parameters: np.ndarray, s: Settings, batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray | None]:
    """How many of the records (values, a column a page, and positives) can be
    learnt from, and the sum of their losses and gradients in whole numbers: what
    ``gradient`` gives for each, for all of them together."""
    batch = [r for r in batch if r[1].any() and not r[1].all()]
    if not batch:
        return 0, None
    own, xs = _places(s)
    values, hit = np.concatenate([v for v, _ in batch], 1), np.concatenate([h for _, h in batch])
    sizes = np.array([len(h) for _, h in batch])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    f, x, layers, page = values[own], values[xs], unpack(parameters, s), s.level == "page"
    given = f if page else np.add.reduceat(f, edges[:-1], axis=1) / sizes
    units = np.tanh(layers[0] @ given + layers[1][:, None]) if s.hidden else given
    logits = (layers[-2] @ units + layers[-1][:, None]) / s.temperature
    gate = np.exp(logits - logits.max(0))
    gate /= gate.sum(0)
    gate = gate if page else np.repeat(gate, sizes, axis=1)
    score = (gate * x).sum(0)
    if not np.ptp(score) * hit.sum() < 600:  # products of exponentials would not be finite
        found = [gradient(parameters, s, v[own].T, v[xs].T, h) for v, h in batch]
        return len(batch), _exact(np.array([[loss, *slope] for loss, slope in found])).sum(0)
    loss, slope = _slopes(score - score.mean(), hit, edges)
    back = slope * gate * (x - score) / s.temperature
    if not page:
        back, edges = np.add.reduceat(back, edges[:-1], axis=1), np.arange(len(batch) + 1)
    pairs = [(back, units)]
    if s.hidden:
        pairs.insert(0, (layers[-2].T @ back * (1 - units**2), given))
    parts = [loss[:, None]]
    for left, right in pairs:  # weights and biases of a layer, a record at a time
        right = np.concatenate([right, np.ones((1, right.shape[1]))])
        both = np.empty((len(batch), len(left), len(right)))
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            both[i] = np.einsum("ip,jp->ij", left[:, a:b], right[:, a:b])
        parts += [both[:, :, :-1].reshape(len(batch), -1), both[:, :, -1]]
    return len(batch), _exact(np.concatenate(parts, 1)).sum(0)


# ---------------------------------------------------------------- records
def _columns(s: Settings) -> list[str]:
    return list(dict.fromkeys([*s.features, *XS]))


def records(feats: DataFrame, s: Settings, keep: list[str] | None = None) -> DataFrame:
    """(query_id, keep, total, positives, pages, block) from rows of features,
    minmax scores and relevance: a row a query. ``block`` holds its pages in order,
    every value once: column after column of doubles, then a byte a page, 1 for a
    positive, all compressed, as some features are the same on all pages of a query
    and others have few values. A query's pool is bounded by its depth. ``relevant_total`` is read
    where there is one; ``keep`` are columns that are the same on all its rows."""
    keys = ["query_id", *(keep or [])]
    row = F.struct("page_id", (F.col("relevance") > 0).alias("hit"), F.array(*[F.col(c).cast("double") for c in _columns(s)]).alias("v"))
    total = F.max("relevant_total") if "relevant_total" in feats.columns else F.count_if(F.col("relevance") > 0)
    d = feats.groupBy(*keys).agg(total.cast("long").alias("total"), F.array_sort(F.collect_list(row)).alias("p"))
    kinds = dict(d.dtypes)
    return d.mapInArrow(_packed, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total long, positives int, pages int, block binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = b.column(b.schema.get_field_index("p"))
        edges, flat = p.offsets.to_numpy() - p.offsets[0].as_py(), p.flatten()
        values = pa.compute.list_flatten(flat.field("v")).to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        hit = flat.field("hit").to_numpy(zero_copy_only=False).astype(bool)
        blocks = [pa.compress(values[a:z].T.tobytes() + hit[a:z].tobytes(), "lz4", asbytes=True) for a, z in zip(edges, edges[1:])]
        positives = [int(hit[a:z].sum()) for a, z in zip(edges, edges[1:])]
        others = [n for n in b.schema.names if n != "p"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(n)) for n in others], pa.array(positives, pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(blocks, pa.binary())],
            names=[*others, "positives", "pages", "block"],
        )


def _places(s: Settings) -> tuple[slice | list[int], slice | list[int]]:
    """Where features and normalized scores lie among a record's values."""
    names, out = _columns(s), []
    for own in (s.features, XS):
        at = [names.index(c) for c in own]
        out.append(slice(at[0], at[-1] + 1) if at == list(range(at[0], at[-1] + 1)) else at)
    return out[0], out[1]


def _blocks(b: pa.RecordBatch, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values of records, a column a page, and their positives."""
    rows = len(_columns(s))
    for n, block in zip(b.column(b.schema.get_field_index("pages")).to_pylist(), b.column(b.schema.get_field_index("block"))):
        buffer = pa.decompress(block.as_buffer(), n * (8 * rows + 1), "lz4")
        yield np.frombuffer(buffer, float, n * rows).reshape(rows, n), np.frombuffer(buffer, bool, n, 8 * n * rows)


def _each(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    own, xs = _places(s)
    for b in batches:
        for n, (values, hit) in zip(b.column(b.schema.get_field_index("total")).to_pylist(), _blocks(b, s)):
            yield n, values[own].T, values[xs].T, hit


def _whole(x) -> np.ndarray:
    return np.rint(np.asarray(x) / UNIT)


def _sum_of(rows: DataFrame, run, n: int) -> tuple[int, np.ndarray]:
    """Number of records and their sums; ``run`` gives a row a task."""
    parts = rows.mapInArrow(run, "n long, v array<long>")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(F.col("v")[i].cast("decimal(38,0)")).alias(f"v{i}") for i in range(n)]).first()
    return total["n"], np.array([float(total[f"v{i}"] or 0) * UNIT for i in range(n)])


def _exact(v: np.ndarray) -> np.ndarray:
    if not np.isfinite(v).all() or np.abs(v).max() >= 1 << 17:
        raise ValueError("a loss or gradient is not finite")
    return _whole(v).astype(np.int64)


def _task(values: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    count, sums = 0, None
    for v in values:
        count, sums = count + 1, _exact(v) + (0 if sums is None else sums)
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "v"])


def batch_gradient(rows: DataFrame, parameters: np.ndarray, s: Settings) -> tuple[int, float, np.ndarray]:
    """Learnable records of ``rows``, their mean loss and mean gradient."""

    def run(batches):
        found = (gradient(parameters, s, f, x, hit) for _, f, x, hit in _each(batches, s))
        yield from _task(np.concatenate([[g[0]], g[1]]) for g in found if g is not None)

    n, sums = _sum_of(rows, run, 1 + len(parameters))
    return n, float(sums[0] / max(n, 1)), sums[1:] / max(n, 1)


def mean_ndcg(rows: DataFrame, parameters: np.ndarray, s: Settings) -> float:
    def run(batches):
        yield from _task(np.array([ndcg(forward(parameters, s, f, x)[0], hit, total)]) for total, f, x, hit in _each(batches, s))

    n, sums = _sum_of(rows, run, 1)
    return float(sums[0] / n) if n else 0.0


# ---------------------------------------------------------------- steps
def step(state: State, slope: np.ndarray, s: Settings) -> None:
    """One step of Adam on a gradient whose norm is clipped."""
    slope = slope * min(1.0, s.clip / (float(np.sqrt((slope**2).sum())) + 1e-6)) + s.decay * state.parameters
    state.steps += 1
    state.first = _BETA1 * state.first + (1 - _BETA1) * slope
    state.second = _BETA2 * state.second + (1 - _BETA2) * slope**2
    first, second = state.first / (1 - _BETA1**state.steps), state.second / (1 - _BETA2**state.steps)
    state.parameters = state.parameters - s.rate * first / (np.sqrt(second) + _EPSILON)


def order_key(epoch: Column, seed: int) -> Column:
    """Queries come in ascending order of this in an epoch."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("query_id").cast("string")), 256)


def batched(rows: DataFrame, epochs: list[int], s: Settings) -> DataFrame:
    """(query_id, batches): a query's batch in each of ``epochs``. Only ids are
    numbered, for all epochs in one pass."""
    ids = rows.select("query_id", F.explode(F.array(*[F.lit(e) for e in epochs])).alias("epoch"))
    ids = hash_numbers(ids, order_key(F.col("epoch"), s.seed), ["query_id"], "number", keys=["epoch"])
    batch = F.struct("epoch", F.floor((F.col("number") - 1) / s.batch).cast("long").alias("batch"))
    return ids.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(batch)), lambda x: x["batch"]).alias("batches"))


def train(
    training: DataFrame, validation: DataFrame, s: Settings = Settings(), *, directory: str | None = None, stop_after: int | None = None
) -> State:
    """The state after the last epoch, from rows of features, minmax scores and
    relevance of training and validation queries; ``best`` holds the parameters
    of the epoch to use.

    ``directory`` gets a state an epoch; a later call there goes on after the
    last one. Batches without a query that has a positive and a negative page
    make no step. Raises ValueError where nothing can be learnt, a value is not
    finite or the directory belongs to other settings.
    """
    rows, held = records(training, s).persist(), records(validation, s).persist()
    try:
        return fit(rows, held, s, directory=directory, stop_after=stop_after)
    finally:
        rows.unpersist()
        held.unpersist()


def fit(rows: DataFrame, held: DataFrame, s: Settings = Settings(), *, directory: str | None = None, stop_after: int | None = None) -> State:
    """``train`` on the ``records`` of training and validation queries, which are
    read several times."""
    spark = rows.sparkSession
    total, hits = rows.agg(F.count(F.lit(1)), F.count_if(F.expr("positives > 0 AND positives < pages"))).first()
    if not hits or not held.count():
        raise ValueError("nothing to learn from, or no validation queries")
    state = _last(spark, directory, s) if directory else None
    state = state or start(s)
    end = s.epochs if stop_after is None or stop_after < state.epoch else min(s.epochs, stop_after)
    while state.epoch < end:
        epochs = list(range(state.epoch + 1, min(end, state.epoch + ORDERS) + 1))
        dealt = rows.select("query_id", "pages", "block").join(batched(rows, epochs, s), "query_id").persist(StorageLevel.DISK_ONLY)
        try:
            for i in range(len(epochs)):
                state = _epoch(state, dealt.select(F.col("batches")[i].alias("batch"), "pages", "block"), held, total, s)
                if directory:
                    spark.createDataFrame([(state.dumps(s),)], "value string").coalesce(1).write.text(f"{directory}/epoch={state.epoch}")
        finally:
            dealt.unpersist()
    return state


def _steps(own: DataFrame, state: State, s: Settings) -> list[float]:
    """The losses of the steps over a range of batches, which lie in one partition
    in their order; ``state`` moves on. A task makes one step after another, as
    each starts from the one before, and holds one batch."""

    def run(batches):
        moved, losses, at, held = replace(state), [], None, []

        def leave():
            count, sums = batch_sums(moved.parameters, s, held)
            if count:
                mean = sums.astype(float) * UNIT / count
                step(moved, mean[1:], s)
                losses.append(float(mean[0]))

        for b in batches:
            for number, record in zip(b.column(b.schema.get_field_index("batch")).to_pylist(), _blocks(b, s)):
                if number != at:
                    leave()
                    at, held = number, []
                held.append(record)
        leave()
        if losses:
            arrays = [pa.array([v], pa.list_(pa.float64())) for v in (moved.parameters.tolist(), moved.first.tolist(), moved.second.tolist(), losses)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([moved.steps])], names=["parameters", "first", "second", "losses", "steps"])

    conf, name = own.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(HANDED))
    try:
        row = own.mapInArrow(run, "parameters array<double>, first array<double>, second array<double>, losses array<double>, steps long").collect()
    finally:
        conf.set(name, usual)
    if not row:
        return []
    (row,) = row  # the state of one task
    for name in ("parameters", "first", "second"):
        setattr(state, name, np.array(row[name]))
    state.steps = row["steps"]
    return row["losses"]


def _epoch(state: State, rows: DataFrame, held: DataFrame, total: int, s: Settings) -> State:
    state = State(**vars(state) | {"epoch": state.epoch + 1, "history": list(state.history)})
    batches, each = -(-total // s.batch), max(1, RANGE // s.batch)
    ranges = -(-batches // each)
    own = rows.withColumn("range", F.floor(F.col("batch") / each).cast("int"))
    # the records of a batch are summed in whole numbers, but computed side by side: their order is fixed too
    own = own.repartitionById(min(ranges, 4 * rows.sparkSession.sparkContext.defaultParallelism), "range").sortWithinPartitions("batch", "block").persist()
    losses = []
    try:
        for r in range(ranges):
            losses += _steps(own.where(F.col("range") == r).coalesce(1), state, s)
    finally:
        own.unpersist()
    if not np.isfinite(state.parameters).all():
        raise ValueError("a parameter is not finite")
    value = mean_ndcg(held, state.parameters, s)
    if state.best is None or value > state.best["ndcg10"]:
        state.best = {"epoch": state.epoch, "ndcg10": value, "parameters": state.parameters.tolist()}
    state.history.append({"epoch": state.epoch, "loss": sum(losses) / len(losses) if losses else None, "steps": len(losses), "ndcg10": value})
    return state


def descend(feats: DataFrame, epochs: int = 5, rate: float = 0.5, s: Settings = Settings()) -> tuple[np.ndarray, list[float]]:
    """Parameters and the losses before each step of plain descent on all queries
    at once, from zeros; an epoch is one aggregate."""
    p, losses = np.zeros(len(start(s).parameters)), []
    rows = records(feats, s).persist()
    try:
        for _ in range(epochs):
            n, loss, slope = batch_gradient(rows, p, s)
            if not n:
                break
            losses.append(loss)
            p = p - rate * slope * min(1.0, s.clip / max(float(np.sqrt((slope**2).sum())), 1e-12))
    finally:
        rows.unpersist()
    return p, losses


def _last(spark, directory: str, s: Settings) -> State | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.text(f"{directory}/epoch=*").select("value", F.get_json_object("value", "$.epoch").cast("int").alias("epoch"))
    row = last.orderBy(F.desc("epoch")).first()
    return State.loads(row["value"], s) if row else None
