"""Links of the near-duplicate stage that a comparison of SimHash fingerprints loses, and sets of several cells, against brute force."""

import random

import numpy as np

from factloom.llm import near, simhash
from tests.llm.helpers import WORDS, sentence
from tests.llm.test_near_duplicates import brute_groups, changed, found


def _signs(words):
    """+1 and -1 for each bit of the wide hash of a shingle."""
    h = simhash.shingle_hashes(" ".join(words).encode(), 5)
    bits = [np.unpackbits(simhash._mixed(h, k).astype("<u8").view(np.uint8), bitorder="little") for k in range(8)]
    return 2 * np.concatenate(bits).astype(np.int64) - 1


def unlike_pair(rng, size=300, tail=33):
    """Two texts of Jaccard similarity over 0.8 whose last words are chosen so that their SimHash fingerprints differ as much as can be."""
    common = sentence(rng, size - tail + 4).split()
    total = sum(_signs(common[i : i + 5]) for i in range(len(common) - 4))
    out = []
    for sign in (1, -1):
        words, own = list(common), total.copy()
        for left in range(tail, 0, -1):
            some = [rng.choice(WORDS) + str(rng.randint(0, 9999)) for _ in range(150)]
            signs = np.stack([_signs([*words[-4:], w]) for w in some])
            # bits that are about to turn count most
            best = int(np.argmax((sign * signs) @ np.exp(-((sign * own - 0.5) ** 2) / (2 * left + 2))))
            words.append(some[best])
            own += signs[best]
        out.append(" ".join(words))
    return out


def test_links_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(21)
    rows = []
    for i in range(3):
        a, b = unlike_pair(rng)
        rows += [(2 * i, a), (2 * i + 1, b)]
        x, y = (np.array(simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), 5)), 8), np.int64) for t in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) > 120
    rows += [(100 + i, sentence(rng, 100)) for i in range(50)]
    want, pairs = brute_groups(rows)
    assert [j >= 0.8 for *_, j in pairs] == [True] * 3
    assert found(spark, rows) == want


def test_sets_of_several_cells(spark, monkeypatch):
    """Cells of few shingles, pairs around 0.8 whose sizes lie on both sides of a number of cells, in groups that share a passage."""
    rng = random.Random(22)
    monkeypatch.setattr(near, "CELL", 32)
    passage, rows = sentence(rng, 60), []
    for i in range(120):
        n = rng.choice([30, 36, 64, 68, 128, 132, 256, 260, 300]) + rng.randint(-6, 6)
        text = passage + " " + sentence(rng, n)
        parts = changed(rng, text, rng.uniform(0.02, 0.16)).split()
        rows += [(3 * i, text), (3 * i + 1, " ".join(parts[: len(parts) - rng.randint(0, n // 12)])), (3 * i + 2, text + " " + sentence(rng, rng.randint(1, len(parts) // 4)))]
    want, pairs = brute_groups(rows)
    assert sum(0.8 <= j < 0.84 for *_, j in pairs) > 20 and sum(0.76 < j < 0.8 for *_, j in pairs) > 20
    assert found(spark, rows) == want


def test_parity_bits_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(23)
    for n in (1, 5, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 7 :], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)]))
        bits = [np.frombuffer(near.parity(x, near.WIDTH), np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
