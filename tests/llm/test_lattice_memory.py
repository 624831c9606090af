import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.llm import lattice


def test_arrays_of_many_words_stay_small():
    """A task's arrays do not grow with the words that come to it."""
    words = [b"word%07d" % i for i in range(100_000)]
    pieces = lattice.Pieces.load()
    pieces.lookup(np.zeros(0, np.uint64))
    spans = lattice._spans(pa.array(words, pa.binary()))
    tracemalloc.start()
    lattice.word_likelihoods(*spans, pieces, np.ones(len(words)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
