import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_pipeline_stages import _covered

from lodestone.llm import tiling
from lodestone.llm.common import Words


def _hashes(words):
    return Words(pa.array([" ".join(words)])).hashes()


@pytest.mark.parametrize("letters,least", [("ab", 2), ("abc", 3), ("abcdefgh", 2), ("a", 3)])
def test_tiles_against_plain_greedy_tiling(letters, least):
    rng = random.Random(7)
    for _ in range(150):
        text = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        item = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        found = tiling.tiles(_hashes(text), _hashes(item), least)
        assert sum(n for *_, n in found) == _covered(text, item, least)
        for start, at, n in found:
            assert text[start : start + n] == item[at : at + n]


def test_text_of_one_repeated_word():
    text, item = np.full(100_000, 7, np.uint64), np.full(300, 7, np.uint64)
    begin = time.time()
    assert tiling.tiles(text, item, 5) == [(0, 0, 300)]
    assert time.time() - begin < 30


def test_repeated_word_and_another():
    """The item's last word keeps it from being covered by one run."""
    for n, m in ((100_000, 1_000), (2_000, 400)):
        text, item = np.full(n, 7, np.uint64), np.concatenate([np.full(m, 7, np.uint64), [np.uint64(9)]])
        tracemalloc.start()
        begin = time.time()
        assert tiling.tiles(text, item, 5) == [(0, 0, m)]
        assert time.time() - begin < 5 and tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_blocks_of_a_repeated_word():
    text = np.array(([7] * 60 + [8]) * 300, np.uint64)
    item = np.array(([7] * 25 + [9]) * 20, np.uint64)
    begin = time.time()
    found = tiling.tiles(text, item, 5)
    assert time.time() - begin < 10 and sum(n for *_, n in found) == 500 and [n for *_, n in found] == [25] * 20


@pytest.mark.parametrize("period", [1, 2, 3])
def test_near_periodic_texts_against_plain_greedy_tiling(period):
    rng = random.Random(period)
    for _ in range(60):
        text = list("abc"[:period]) * rng.randint(1, 20)
        item = list("abc"[:period]) * rng.randint(1, 12)
        for x in (text, item):
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("abcz")
        assert sum(n for *_, n in tiling.tiles(_hashes(text), _hashes(item), 3)) == _covered(text, item, 3)


def _table(spark, kind, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "h") for i, t in enumerate(texts)], f"{kind} long, text string, h1 string")


def test_many_blocks_and_a_phrase_of_all_items(spark):
    rng = random.Random(2)
    items = ["what is the best answer to " + " ".join(f"w{rng.randrange(400)}" for _ in range(20)) for _ in range(60)]
    texts = ["what is the best answer to nothing", None, "", *(f"start {x.upper()} end" for x in items[::9]), *(" ".join(x.split()[15:] + ["moved"] + x.split()[:15]) for x in items[::11])]
    docs, bench = _table(spark, "doc_id", texts), _table(spark, "item_id", items)
    split = lambda t: (t or "").lower().split()
    pairs = sorted((repr(i if i % 7 else None), repr(j if j % 7 else None)) for i, t in enumerate(texts) for j, x in enumerate(items) if 2 * _covered(split(t), split(x)) >= len(split(x)))
    assert len(pairs) >= len(texts) - 3
    for size in (1 << 20, 700):
        got = sorted((repr(r.doc_id), repr(r.item_id)) for r in tiling.contaminations(docs, bench, block_bytes=size).collect())
        assert got == pairs
        left = tiling.decontaminate(docs, bench, block_bytes=size)
        assert left.columns == docs.columns and sorted(map(repr, (r.text for r in left.collect()))) == sorted(map(repr, texts[:3]))


def test_blocks_are_counted_in_bytes(spark):
    bench = spark.createDataFrame([(i, "é" * 10) for i in range(4)], "item_id long, text string")
    assert [only for _, only in tiling._blocks(bench, 5, 81)] == [True] and len(list(tiling._blocks(bench, 5, 40))) == 2


def test_windows_of_different_words_differ():
    from itertools import product

    from lodestone.llm.common import shingles

    for width in (3, 4, 5, 12):
        some = list(product("ab", repeat=width))
        seen = {int(shingles(_hashes(w), width)[0]) for w in some}
        assert len(seen) == len(some)
    h = _hashes([str(i % 5) for i in range(40)])
    for width in (2, 8, 9, 20):
        assert (shingles(h, width) == np.concatenate([shingles(h[i : i + width], width) for i in range(41 - width)])).all()
