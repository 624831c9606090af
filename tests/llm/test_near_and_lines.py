import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import LINE, SCHEMA, rows, table, words

from lodestone.llm import common, components, line_runs, ngram_join


def brute_classes(data, k, percent):
    sets = []
    for r in data:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        out += [(data[i][0], len(sets[i]), min(ids) if ids else None, links[i]) for i in members]
    return sorted(out, key=repr)


def got_classes(df, **kw):
    return sorted(map(tuple, ngram_join.jaccard_classes(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("k,percent,block", [(3, 90, 512), (5, 80, 4)])
def test_awkward_rows(spark, k, percent, block):
    assert got_classes(table(spark), k=k, percent=percent, block=block) == brute_classes(rows(), k, percent)


def test_dense_cluster_in_small_blocks(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    data = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"n{rng.randrange(10_000)}"
        data.append((i * 7 % 71, " ".join(w), None, None, None, None, None, None))
    data += [(100 + i, " ".join(rng.choice(base) for _ in range(rng.randint(1, 12))), None, None, None, None, None, None) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got_classes(df, k=3, percent=90, block=5) == brute_classes(data, 3, 90)


def test_empty_table(spark):
    assert got_classes(table(spark, [])) == []


def test_prefixes_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(200, n, replace=False).tolist())
        b = set(a)
        for x in list(a)[: int(rng.integers(0, 4))]:
            b.discard(x)
        if not b or 100 * len(a & b) < 90 * len(a | b):
            continue
        order = rng.permutation(200)
        pa_, pb = (set(sorted(s, key=lambda t: order[t])[: ngram_join.prefix_length(len(s), 90)]) for s in (a, b))
        assert pa_ & pb


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (200, 201), (None, 3)], "a long, b long")
    got = {r.a: r.b for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {201: 200}


def test_words_and_hashes():
    texts = ["The  the\tTHE", None, "", "é É x", "a" * 1000, "\x0b\x0c\r\n", "b\x85c d"]
    w = common.Words(pa.array(texts))
    h = w.hashes()
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == len({x for g in got for x in g})


def brute_lines(data, least, chars):
    upper = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(upper)
    held = defaultdict(set)
    for i, r in enumerate(data):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= chars:
                held[k].add((-1, i) if r[0] is None else (r[0], 0))  # a document is an id, or a row without one
    keeper = {k: max(v)[0] for k, v in held.items() if len(v) >= least}
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) in keeper and (-1 if r[0] is None else r[0]) < keeper[key(x)])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (6, 2)])
def test_line_runs(spark, batches, fanout):
    out = line_runs.dedup_lines(table(spark), batches=batches, fanout=fanout)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_lines(rows(), 5, 40)
    assert set(SCHEMA.replace(",", "").split()[::2]) < set(out.columns)


def test_line_runs_without_rows(spark):
    assert line_runs.dedup_lines(table(spark, [])).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    line = "this line is long enough to count as a repeated line"
    row = lambda i, t: (i, t, None, None, None, None, None, None)
    data = [row(1, line)] * 5 + [row(2, line)]
    for extra in ([], [row(3, line), row(4, "x\n" + line + "\ny"), row(5, line + "\n" + line)], [row(None, line)] * 3, [row(None, "a\n" + line)] * 7):
        got = line_runs.dedup_lines(table(spark, data + extra))
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()), key=repr)
        assert got == brute_lines(data + extra, 5, 40)


def test_many_dropped_lines_of_one_text(spark):
    lines = [f"line number {i:06} of a very long text, long enough" for i in range(30_000)]
    text = "\n".join(x for i, line in enumerate(lines) for x in ([line, "short"] if i % 3 else [line, line.upper()]))
    data = [(i, "\n".join(lines), None, None, None, None, None, None) for i in range(2, 7)] + [(1, text, None, None, None, None, None, None)]
    got = {r.doc_id: r for r in line_runs.dedup_lines(table(spark, data)).collect()}
    assert got[1].text == "\n".join(["short"] * 20_000) and got[1].n_dropped == 40_000 and got[1].n_lines == 60_000
    assert got[6].text == "\n".join(lines) and got[3].text == "" and got[3].n_dropped == 30_000


def test_runs_are_read_without_shuffle_or_sort(spark):
    runs = line_runs.LineRuns(spark, fanout=9, files=3)
    for i in range(3):
        runs.add(spark.createDataFrame([(10 - i, j * i, 2) for j in range(50)], "doc_id long, h1 long, h2 long"))
    merged = runs._merged(runs.runs()[:2])
    assert sorted((r.h1, r.n, r.keeper) for r in merged.collect()) == [(0, 51, 10), *((j, 1, 9) for j in range(1, 50))]
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    a, b = (r.select("h1", "h2") for r in runs.runs()[:2])
    joined = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(10 - i, 1, 1), (10 - i, i, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.frequent(4).collect()] == [(1, 1, 10)]


def test_runs_leave_nothing_behind(spark, monkeypatch):
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("lodestone_run_")}
    key, before = "spark.sql.legacy.bucketedTableScan.outputOrdering", names()
    old = spark.conf.get(key)
    line_runs.dedup_lines(table(spark)).count()
    assert spark.conf.get(key) == old and names() == before
    monkeypatch.setattr(line_runs.LineRuns, "frequent", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_runs.dedup_lines(table(spark))
    assert spark.conf.get(key) == old and names() == before


def test_batches_read_records_once_and_double(spark, monkeypatch):
    """What a batch adds is at most all before it and itself is read once."""
    data = [(i, f"{LINE} number {i // 6} of all the lines that are here", None, None, None, None, None, None) for i in range(1600)]
    sizes = []
    add = line_runs.LineRuns.add
    monkeypatch.setattr(line_runs.LineRuns, "add", lambda self, lines: (sizes.append(lines.count()), add(self, lines))[1])
    out = line_runs.dedup_lines(table(spark, data), batches=5)
    assert sum(r.n_dropped for r in out.collect()) == sum(5 for i in range(0, 1596, 6)) and sum(sizes) == 1600
    assert len(sizes) == 5 and all(abs(x - 1600 / 2 ** min(5 - i, 4)) < 20 for i, x in enumerate(sizes))
