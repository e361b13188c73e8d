"""The double-array trie of many phrases: whole, and built in time that does not grow with the square of their number."""

import time

import numpy as np

from factloom.llm import collocations as co


def phrases(n, words):
    """Distinct phrases of two to five symbols, some of which most phrases begin with."""
    rng = np.random.default_rng(1)
    keys, sizes = np.zeros((n, 5), np.int64), rng.choice([2, 3, 4, 5], n, p=[0.5, 0.3, 0.15, 0.05])
    for j in range(5):
        keys[:, j] = np.where(j < sizes, np.minimum(rng.zipf(1.3, n), words), 0)
    return np.unique(keys, axis=0)


def test_a_trie_of_100000_phrases():
    took = []
    for n in (20_000, 200_000):
        keys = phrases(n, n // 10)
        began = time.process_time()
        base, check, slots = co.double_array(keys)
        took.append(time.process_time() - began)
        state = np.zeros(len(keys), np.int64)
        for j in range(5):
            live = keys[:, j] > 0
            to = base[state[live]] + keys[live, j]
            assert (check[to] == state[live]).all()
            state[live] = to
        assert (state == slots).all() and len(np.unique(slots)) == len(keys)
        assert len(check) < 5 * len(keys)
    # about nine times as many phrases
    assert took[1] < 30 * took[0]
