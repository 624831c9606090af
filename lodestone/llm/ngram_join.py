"""N-gram Jaccard self-join by multiple-global-order filtering.

Two documents link when the Jaccard similarity of their word-shingle sets
reaches a threshold. A global order of tokens (shingle hashes) and a threshold
give every set a short prefix such that linked sets share a prefix token; this
holds for *every* order, so candidates must share a prefix token under each of
several orders, and only pairs that pass all of them are verified.
(Tables that a frequent token is joined with are written first: both sides of
such a join are then plain shuffles, which adaptive execution splits by skew.)

Orders
  A  tokens of a fixed slice of the hash space come first, rarest first by their
     document count, then all others (rarest first among the sets that need
     them). It brings candidates together, and is a pair filter like the others.
  B  all tokens by their count inside a cluster of candidates, so that sets
     with enough tokens of their own leave and clusters fall apart; then a pair
     filter too.
  C, D  two seeded random orders, used as pair filters.

Plan
  1. One scan turns every text into its set size, a 64-bit identity of the set
     and the tokens of the counted slice. Equal sets send their tokens once a
     task and are one set from here on.
  2. The slice's tokens are counted. A set whose A-prefix holds only tokens
     that no other set has cannot link and leaves; on ordinary text nearly all
     sets leave at this point.
  3. The rest fetch their texts and keep the whole sets. Tokens shared in
     A-prefixes connect sets to the smallest set of the token (a star, never
     all pairs), and connected components of these stars bound the search.
  4. Each component is verified in blocks of bounded size: pairs that share a
     prefix token under every order and fit in size are compared exactly. A
     large component is split into pairs of blocks, so no task holds it all,
     and only union-find edges leave a task.
  5. Components of the verified links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, drop, fresh, lists, mix, shingles, slices, table
from .components import components

#: Sets and tokens of a block; larger components are cut into pairs of blocks.
BLOCK = 512
BLOCK_TOKENS = 500_000
_SEEDS = (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))


def counted_below(k: int, percent: int) -> int:
    """Tokens below this hash are counted for every document: somewhat more than
    the share that a prefix takes of a set, as only tokens that no other set has
    let a set leave (longer shingles are more often such)."""
    return 2**62 * (100 - percent) * (8 if k < 5 else 6) // 100


def prefix_length(n, percent: int):
    """Tokens of a set of size n of which one at least is in any linked set."""
    return n - (percent * n + 99) // 100 + 1


def _identity(tokens: np.ndarray) -> int:
    """64-bit identity of a sorted distinct token set."""
    if not len(tokens):
        return 0
    a = np.bitwise_xor.reduce(mix(tokens ^ _SEEDS[0]))
    b = np.sum(mix(tokens ^ _SEEDS[1]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(np.array([a * U64(3) + b + U64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    words = Words(batch.column(batch.schema.get_field_index("text")))
    h, bounds = words.hashes(), words.bounds
    for i in range(batch.num_rows):
        yield np.unique(shingles(h[bounds[i] : bounds[i + 1]], k))


def _scan(k: int, percent: int):
    limit = U64(counted_below(k, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set's tokens leave a task once
        for batch in slices(batches):
            sizes, ids, m, own = [], [], [], []
            for tokens in _sets(batch, k):
                sig = _identity(tokens)
                counted = tokens[: np.searchsorted(tokens, limit)]
                sizes.append(len(tokens))
                ids.append(sig)
                m.append(len(counted))
                own.append(counted[:0] if sig in seen else counted)
                seen.add(sig)
            flat = lists(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(m, pa.int64()), flat],
                names=["doc_id", "n", "sig", "m", "tok"],
            )

    return run


def _whole_sets(k: int):
    """Texts to whole sets; where the batch says which set a text should have
    (``want``), only texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("want")
            want = batch.column(at).to_numpy(zero_copy_only=False) if at >= 0 else None
            ids, own = [], []
            for i, tokens in enumerate(_sets(batch, k)):
                sig = _identity(tokens)
                if len(tokens) and (want is None or want[i] == sig):
                    ids.append(sig)
                    own.append(tokens)
            if own:
                flat = lists(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat], names=["sig", "tokens"])

    return run


def _incidence(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """0/1 matrices (set x token) over the tokens that two sets or more have,
    some thousand tokens at a time."""
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[token] > 1
    number = np.cumsum(count > 1) - 1
    token, owner = number[token[keep]], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    total, step = int((count > 1).sum()), 4096
    for at in range(0, total, step):
        a, b = np.searchsorted(token, [at, at + step])
        m = np.zeros((len(rows), min(step, total - at)), np.float32)
        m[owner[a:b], token[a:b] - at] = 1
        yield m


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), len(rows)), np.float32)
    for m in _incidence(rows):
        out += m @ m.T
    return out


def _verify(percent: int):
    def group(sig, block, copies, lead, prefix, tokens, two: bool) -> pa.RecordBatch | None:
        sig, first = np.unique(sig, return_index=True)
        block, copies = block[first], copies[first]
        sets = [np.sort(tokens[i].view(np.uint64)) for i in first]
        n = np.array([len(s) for s in sets])
        candidate = _overlaps([lead[i] for i in first]) > 0
        candidate &= _overlaps([prefix[i] for i in first]) > 0
        for seed in _SEEDS:
            own = []
            for s in sets:
                p = prefix_length(len(s), percent)
                order = mix(s ^ seed)
                own.append(s if p >= len(s) else s[np.argpartition(order, p - 1)[:p]])
            candidate &= _overlaps(own) > 0
        candidate &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
        candidate &= np.triu(np.ones_like(candidate), 1)
        if two:
            candidate &= block[:, None] != block
        left, right = np.nonzero(candidate)
        if not len(left):
            return None
        if len(left) > 4 * len(sig):
            common = _overlaps(sets)[left, right].astype(np.int64)
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
        good = 100 * common >= percent * (n[left] + n[right] - common)
        left, right = left[good], right[good]
        links = np.zeros(len(sig), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        root = np.arange(len(sig))
        while True:
            low = root.copy()
            np.minimum.at(low, left, root[right])
            np.minimum.at(low, right, root[left])
            low = low[low]
            if (low == root).all():
                break
            root = low
        out = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(sig[root[out]]), pa.array(links[out])], names=["sig", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def done():
            cols = list(zip(*held))
            return group(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), *cols[3:], key[1] != key[2])

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            keys = np.stack([get(c).to_numpy(zero_copy_only=False) for c in ("cluster", "lo", "hi")], 1)
            sig, block, copies = (get(c).to_numpy(zero_copy_only=False) for c in ("sig", "block", "copies"))
            parts = []
            for c in ("lead", "prefix", "tokens"):
                col = get(c)
                off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
                parts.append([flat[off[i] : off[i + 1]] for i in range(len(off) - 1)])
            for i in range(batch.num_rows):
                k = tuple(keys[i])
                if k != key:
                    if len(held) > 1 and (out := done()) is not None:
                        yield out
                    held, key = [], k
                held.append((sig[i], block[i], copies[i], *(p[i].copy() for p in parts)))
        if len(held) > 1 and (out := done()) is not None:
            yield out

    return run


def _clusters(sets: DataFrame) -> DataFrame:
    """(sig, cluster) of sets that share a prefix token, directly or through
    others, inside the cluster they come with. Sets that share none leave."""
    holders = sets.select("cluster", "sig", F.explode("prefix").alias("t"))
    pivots = holders.groupBy("cluster", "t").agg(F.min("sig").alias("pivot"), F.count(F.lit(1)).alias("df")).where("df > 1")
    pivots = table(pivots, "pivots")
    stars = holders.join(pivots, ["cluster", "t"]).select(F.col("sig").alias("a"), F.col("pivot").alias("b"))
    pairs = components(stars)
    near = pairs.select(F.col("a").alias("sig"), F.col("b").alias("cluster"))
    out = table(near.union(near.select("cluster", "cluster").distinct()), "clusters")
    drop(pairs, pivots)
    return out


def _reordered(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes under the order by counts inside each cluster, over all tokens;
    sets with enough tokens of their own leave."""
    tokens = sets.select("cluster", "sig", F.explode("tokens").alias("t"))
    counts = table(tokens.groupBy("cluster", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = tokens.join(counts, ["cluster", "t"]).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("shared"))
    d = sets.withColumnRenamed("prefix", "lead").join(shared, "sig").withColumn("n", F.size("tokens"))
    spare = f"cast(n - ({percent} * n + 99) div 100 + 1 - (n - size(shared)) as int)"
    d = d.withColumn("spare", F.expr(spare)).where("spare > 0")
    d = d.withColumn("prefix", F.expr("transform(slice(shared, 1, spare), x -> x.t)"))
    out = table(d.select("cluster", "sig", "copies", "tokens", "lead", "prefix", "n"), "reordered")
    drop(counts)
    return out


def with_identity(docs: DataFrame, k: int, name: str) -> DataFrame:
    """``docs`` and the identity of each row's shingle set as ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sig = pa.array([_identity(tokens) for tokens in _sets(batch, k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sig], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    ``percent`` is the least similarity in hundredths. component_id is the
    smallest doc_id reachable over links, n_links the number of other rows that
    a row links with, equal texts included.

    Defined cases: null and empty texts and texts without words have an empty
    set, stay alone and count no links; a text with fewer than k words is one
    shingle; repeated rows are kept, each with its own output row; a null doc_id
    takes part and never names a class unless the whole class has none; other
    columns are ignored; an empty table gives an empty result.
    """
    return identified_classes(docs, k, percent, block).drop("sig")


def identified_classes(docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``jaccard_classes`` with the identity of each row's set as ``sig`` (null:
    an empty set)."""
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = table(scanned.mapInArrow(_scan(k, percent), "doc_id long, n long, sig long, m long, tok array<long>"), "sets")
    full = own.where("n > 0")

    # 2: which tokens of the counted slice do other sets have?
    tokens = full.select("sig", F.explode("tok").alias("t"))
    counts = table(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = tokens.join(counts, "t").groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("df", "t"))).alias("shared"))
    state = (
        full.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("m").alias("m"))
        .join(shared, "sig", "left")
        .withColumn("p", F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)"))
        .withColumn("unique", F.col("m").cast("int") - F.coalesce(F.size("shared"), F.lit(0)))
        .withColumn("lead", F.expr("transform(slice(coalesce(shared, array()), 1, greatest(0, p - unique)), x -> x.t)"))
        .drop("shared")
    )
    state = table(state, "state")
    drop(counts)
    alive = state.where("unique < p")

    # 3: whole sets of those left, fetched by the row that stands for each
    wanted = alive.where("doc is not null").select(F.col("doc").alias("doc_id"), F.col("sig").alias("want"))
    schema = "sig long, tokens array<long>"
    whole = scanned.join(wanted, "doc_id").select("want", "text").mapInArrow(_whole_sets(k), schema)
    nameless = scanned.where("doc_id is null").select("text").mapInArrow(_whole_sets(k), schema)
    whole = whole.union(nameless.join(alive.where("doc is null").select("sig"), "sig", "left_semi"))
    fetched = table(whole.dropDuplicates(["sig"]), "whole")
    whole = fetched.join(alive, "sig")
    rest = whole.where("m < p").select("sig", F.explode("tokens").alias("t")).where(~F.col("t").between(0, min(counted_below(k, percent), 2**63) - 1))
    rest_counts = table(rest.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "counts")
    tail = rest.join(rest_counts, "t").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("others"))
    whole = whole.join(tail, "sig", "left").withColumn("tail", F.expr("transform(slice(coalesce(others, array()), 1, greatest(0, p - cast(m as int))), x -> x.t)"))
    whole = table(whole.select("sig", "copies", "tokens", F.concat("lead", "tail").alias("prefix")), "prefixes")
    rows = table(own.select("doc_id", "n", "sig"), "rows")
    drop(fetched, own, rest_counts)

    near = _clusters(whole.select(F.lit(0).cast("long").alias("cluster"), "sig", "prefix"))

    # order B: each cluster is ordered anew, by all its tokens
    ordered = _reordered(whole.join(near, "sig"), percent)
    drop(whole, near)
    finer = _clusters(ordered.select("cluster", "sig", "prefix"))
    sized = finer.join(ordered.select("sig", "n"), "sig").groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    )
    sized = table(sized, "sizes")
    placed = ordered.drop("cluster", "n").join(finer.join(sized, "cluster"), "sig")

    # 4: exact verification inside bounded blocks
    members = placed.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "sig", "block", "copies", "lead", "prefix", "tokens")
    members = members.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    found = table(members.mapInArrow(_verify(percent), "sig long, root long, links long"), "found")
    drop(ordered, finer, sized)

    # 5: classes
    pairs = components(found, "sig", "root")
    classes = pairs.select(F.col("a").alias("sig"), F.col("b").alias("root"))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    named = (
        state.select("sig", "doc", "copies")
        .join(classes, "sig", "left").join(links, "sig", "left")
        .select("sig", "doc", F.coalesce("root", "sig").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    smallest = table(named.groupBy("root").agg(F.min("doc").alias("component_id")), "smallest")
    result = table(named.join(smallest, named["root"] == smallest["root"]).select("sig", "component_id", "n_links"), "classes")
    drop(state, found, pairs, smallest)
    joined = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(result, "sig", "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "sig",
    )


def first_of_classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their class of linked
    rows; all columns pass through.

    Rows are told apart by id and shingle set: rows of a class with its smallest
    id all stay, and so do all rows of a class without ids. An id whose rows all
    go is a join by id; shingle sets are computed once more only for rows without
    an id and for ids of which some rows stay and others go.
    """
    classes = identified_classes(docs, k, percent).select("doc_id", "sig", (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("lost"))
    classes = table(classes, "classes")  # its last join may then split a frequent set
    lost = table(classes.groupBy("doc_id", "sig").agg(F.first("lost").alias("lost")), "lost")
    drop(classes)
    ids = lost.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("lost").alias("whole"), F.max("lost").alias("any"))
    id_, sig, own = fresh(docs, "gone", "set", "own")
    ids = table(ids.where("any").select(F.col("doc_id").alias(id_), "whole"), "gone")
    key = F.col("doc_id").cast("long")
    out = docs.where("doc_id IS NOT NULL").join(ids.select(id_), key == F.col(id_), "left_anti")
    split, nameless = ids.where("NOT whole").select(id_), docs.where("doc_id IS NULL")
    parts = ([] if nameless.isEmpty() else [nameless]) + ([] if split.isEmpty() else [docs.join(split, key == F.col(id_), "left_semi")])
    gone = lost.where("lost AND sig IS NOT NULL").select(F.col("doc_id").alias(id_), F.col("sig").alias(sig))
    for part in parts:
        rows = with_identity(part, k, own)
        same = key.eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sig))
        out = out.unionByName(rows.join(gone, same, "left_anti").drop(own))
    return out
