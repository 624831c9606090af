"""Connected components against union-find, on links that are stars already and
on links that are not."""

import random

import pytest

from lodestone.llm import components as llm_components
from lodestone.llm.components import components


def _smallest(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(x, find(x)) for x in root if find(x) != x}


_DRAW = random.Random(7)
CASES = {
    "none": [],
    "stars": [(5, 1), (6, 1), (9, 2), (1, 7), (3, 3), (None, 4), (5, 1)],
    "two_roots": [(5, 1), (5, 2)],
    "path": [(i, i + 1) for i in range(40)],
    "hub_in_middle": [(50, i) for i in range(100)],
    "chance": [(_DRAW.randrange(300), _DRAW.randrange(300)) for _ in range(220)],
}


@pytest.mark.parametrize("hubs", [1000, 4])
@pytest.mark.parametrize("case", CASES)
def test_components_equal_union_find(spark, monkeypatch, case, hubs):
    monkeypatch.setattr(llm_components, "HUBS", hubs)
    links = spark.createDataFrame(CASES[case], "a long, b long")
    # links that are contracted one by one leave the work to the rounds
    got = [tuple(r) for r in components(links, chunk=1 if hubs == 4 else llm_components.CHUNK).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _smallest(CASES[case])
