"""Token counts, whitening and collocations against the library, numpy and plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import collocations as co
from factloom.llm import queries as q
from factloom.llm import token_counts as tc
from factloom.llm import whitening as wh
from tests.llm.helpers import SF, edge_docs, edge_rows, empty_docs, rows_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    path = q.vocabulary("byte_bpe_50k.json")
    return tc.Counter(path, *tc.kinds(path))


def prefix_counts(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


# 11
def test_every_prefix_has_the_library_count(library, counter):
    rng = random.Random(1)
    parts = ["a", "l", "'", "'ll", "'s", " ", "  ", "\n", "\t", "1", "23", "!", "the", " and", "é", "日本", "🙂", " ", " ", "<|endoftext|>", "<|endof", "ve", "'r", "L", "\x00", "٣", "é"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        for t, got in zip(texts, counter.counts([t.encode() for t in texts]), strict=True):
            assert got.tolist() == prefix_counts(library, t)


def test_kinds_of_characters_are_the_library_s(library, counter):
    split = library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x1F000, 3)]:
        like = next((k for k, s in ((tc.LETTER, "a"), (tc.NUMBER, "1"), (tc.OTHER, "!")) if len(split(s + chr(c))) == 1), tc.SPACE)
        assert counter.kind[c] == like or 0xD800 <= c < 0xE000


def test_a_long_text_is_counted_in_windows(library, counter):
    text = edge_rows()[8][1] * 3
    parts = list(tc.windows(text.encode(), 5000))
    assert len(parts) > 10 and b"".join(parts) == text.encode()
    assert sum(int(counter.counts([p])[0][-1]) for p in parts) == len(library.encode(text, add_special_tokens=False).ids)
    assert list(tc.windows(b"x" * 9000, 100)) == [b"x" * 9000]


def test_stored_counts_answer_budgets(spark, library):
    counts = tc.prefix_counts(edge_docs(spark), q.vocabulary("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in counts.collect() if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()), len(t or ""), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in edge_rows(False)
    )
    asked = counts.select("doc_id", F.explode(F.array(*map(F.lit, [0, 1, 17, 300, 9000, 1 << 40]))).alias("k"), "n_chars", "blocks")
    texts = {i: t or "" for i, t, *_ in edge_rows()}
    for r in asked.select("doc_id", "k", tc.count_at(F.col("k")).alias("n")).collect():
        text = texts[r.doc_id]
        assert r.n == (len(library.encode(text[: r.k], add_special_tokens=False).ids) if r.k <= len(text) else None)
    limits = [0, 1, 40, 3000, 1 << 40]
    for r in tc.truncated(counts, limits).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(library.encode(text[: r.n_chars], add_special_tokens=False).ids) <= r.limit
        if len(text) < 2000:
            assert r.n_chars == max((i + 1 for i, n in enumerate(prefix_counts(library, text)) if n <= r.limit), default=0)


def test_counts_of_an_empty_table_and_other_vocabularies(spark):
    assert tc.prefix_counts(empty_docs(spark), q.vocabulary("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        tc.Counter(q.vocabulary(), np.array([0]), np.array([0], np.uint8))


def test_op11_equals_the_library(spark, library):
    got = q.op11_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert sorted(map(tuple, got)) == sorted((i, len(t.encode()), want[i], want[i] > 1024) for i, t in texts.items())


# 12
def brute_whitening(rows):
    sound = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in sound)
    sound = [(i, x + [0] * (width - len(x))) for i, x in sound]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit.astype(float) - (sums / n).astype(float)) if n else fit
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return sound, n, sums, values[::-1], vectors[:, ::-1], float(np.trace(y.T @ y / n))


def check_whitening(rows, got):
    sound, n, sums, values, vectors, trace = brute_whitening(rows)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in sound for c in range(1, min(4, len(values)) + 1))
    for c in range(min(4, len(values))):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id, r.deviation))
        want = sorted((i, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), x) for i, x in sound)
        assert [(r.vec_id, r.deviation, r.n) for r in own] == [(i, d, n) for i, d, _ in want]
        assert all(r.deviation_digits == str(r.deviation) for r in own)
        assert all(abs(r.explained - values[c] / trace) <= 1e-10 for r in own)
        w = (np.array([x for *_, x in want], float) - (sums / n).astype(float)) @ vectors[:, c] / np.sqrt(values[c])
        g = np.array([r.whitened for r in own])
        assert min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-8
        assert all(r.identity_error < 1e-9 for r in own)


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(9, 9)) * np.array([5, 3, 2, 1, 1, 0.5, 0.3, 0.2, 0.1])
    rows = [(i, [float(v) for v in np.float32(x)]) for i, x in enumerate(rng.normal(size=(700, 9)) @ mix.T)]
    rows += [(i, rows[0][1]) for i in range(300)] + [(1, None), (2, [None] * 9), (3, [float("nan")] * 9), (4, [float("inf")] * 9), (None, rows[5][1]), (5, rows[6][1][:4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "n": F.lit("n"), "r": F.lit(2), "whitened": F.lit(0)})
    got = wh.whiten(df.repartition(5)).collect()
    assert {r.component for r in got if r.vec_id is None} == {1, 2, 3, 4}
    check_whitening([(-1 if i is None else i, v) for i, v in rows], [type(r)(**(r.asDict() | {"vec_id": -1})) if r.vec_id is None else r for r in got])


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    flat = wh.whiten(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = wh.whiten(spark.createDataFrame([(i, [1e30 * i, -1e30, 2.0**40 * i]) for i in range(3)], schema)).collect()
    assert len(huge) == 9 and all(r.deviation is None for r in huge if r.vec_id != 1)


@pytest.mark.parametrize("kind", range(8))
def test_directions_are_singular_vectors(kind):
    rng = np.random.default_rng(kind)
    for _ in range(15):
        n = int(rng.integers(1, 30))
        a = rng.normal(size=(n + 5, n))
        if kind == 1:
            a *= 10.0 ** rng.uniform(-6, 6, n)
        elif kind == 2:
            a[:, : n // 2] = 0
        elif kind == 3:
            a = np.eye(n) * 3
        elif kind == 4:
            a = np.outer(rng.normal(size=n + 5), rng.normal(size=n))
        elif kind == 5:
            b, _ = np.linalg.qr(rng.normal(size=(n, n)))
            a = b @ np.diag(np.where(np.arange(n) < n // 2, 2.0, 1.0)) @ b.T
        elif kind == 6:
            a = np.zeros((n, n))
        r = np.linalg.qr(a, mode="r")
        d, e, _ = wh.bidiagonal(r)
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(wh.dqds(d, e), want, rtol=1e-12, atol=1e-14 * max(want[0], 1e-300))
        values, vectors = wh.directions(r, 4)
        live = values > 1e-12 * max(want[0], 1e-300)
        v = vectors[live]
        assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12)
        assert np.allclose(a.T @ (a @ v.T), v.T * values[live] ** 2, atol=1e-10 * max(want[0] ** 2, 1e-300))


def test_small_singular_values_keep_their_digits():
    d, e = np.array([1.0, 1e-5, 1e-10, 1e-12]), np.array([1e-3, 1e-8, 1e-12])
    from fractions import Fraction

    values = wh.dqds(d, e)
    product = Fraction(1)
    for x in d:
        product *= Fraction(float(x))
    assert abs(float(np.prod(values)) / float(product) - 1) < 1e-12


def test_op12_equals_the_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, q.op12_whitening(spark, SF).collect())


# 13
def brute_phrases(rows, min_count, top=2000):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            own = f.setdefault(lang, Counter())
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    own[tuple(w[i : i + k])] += 1
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= min_count and len(p) > 1}
        gone = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * own[p[i : i + k]]}
        kept = []
        for p, a in often.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def odd_phrases():
    rng = random.Random(5)
    words = ["The", "the", "of", "a", "B", "日本", "É", "é", "<x>", "a b"]
    rows = []
    for i in range(300):
        seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?", " \x00 "]
        rows.append((i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None, "und"]), "s"))
    rows += [(1, "x y z x y z x y z", "xx", None)] * 7 + [(2, None, "en", None), (3, "", None, None), (4, " . ,\n", "yy", None), (None, "the of a", "en", None)]
    return rows


@pytest.mark.parametrize("min_count,top", [(2, 2000), (5, 7), (40, 2000)])
def test_collocations_equal_plain_counting(spark, monkeypatch, min_count, top):
    monkeypatch.setattr(co, "NODES", 50)
    rows = odd_phrases()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in ("h", "n", "word", "codes", "p", "w", "f")})
    got = rows_of(co.collocations(docs.repartition(3), min_count=min_count, top=top))
    assert got == sorted(brute_phrases([(r[2], r[1]) for r in rows], min_count, top), key=repr) and got


def test_collocations_of_edge_rows(spark):
    got = rows_of(co.collocations(edge_docs(spark), min_count=3))
    assert got == sorted(brute_phrases([(r[2], r[1]) for r in edge_rows()], 3), key=repr)
    assert co.collocations(empty_docs(spark)).count() == 0


def test_slices_lose_no_phrase():
    text = b"one two. three four, five six\nseven eight"
    assert b"".join(co._slices([text], 5)) == text and len(list(co._slices([text], 5))) == 4
    assert list(co._slices([b"no end of a piece"], 3)) == [b"no end of a piece"]
    words, codes = co.coded(b"A b. a  B\tc,,d")
    assert words.to_pylist() == [b"a", b"b", b"c", b"d"] and codes.tolist() == [1, 2, 0, 1, 2, 3, 0, 4]


def test_double_array_holds_every_row_and_no_other():
    rng = np.random.default_rng(2)
    rows = {tuple(rng.integers(1, 30, k).tolist()) for k in (2, 3, 4) for _ in range(300)}
    rows |= {r[:k] for r in rows for k in range(2, len(r))}
    keys = np.array([[*r, *[0] * (4 - len(r))] for r in sorted(rows)])
    base, check, slots = co.double_array(keys)
    assert len(set(slots.tolist())) == len(rows)
    for r, slot in zip(sorted(rows), slots, strict=True):
        s = 0
        for c in r:
            t = base[s] + c
            assert check[t] == s
            s = t
        assert s == slot
    pairs = {r for r in rows if len(r) == 2}
    for a in range(1, 30):
        for b in range(1, 30):
            assert ((a, b) in pairs) == (check[a] == 0 and bool(check[base[a] + b] == a))


def test_clashing_hashes_are_seeded_anew(spark, monkeypatch):
    calls = []
    real = co.encode

    def clashing(docs, seed, *rest):
        calls.append(seed)
        out = real(docs, seed, *rest)
        if seed:
            return out
        # the second hash of a slice becomes its first
        same = F.concat(F.substring("hashes", 1, 8), F.substring("hashes", 1, 8), F.expr("substring(hashes, 17)"))
        return out.withColumn("hashes", same)

    monkeypatch.setattr(co, "encode", clashing)
    docs = spark.createDataFrame([("x y z. " * 4, "en")], "text string, lang string")
    assert rows_of(co.collocations(docs, min_count=3)) == brute_phrases([("en", "x y z. " * 4)], 3) and calls == [0, 1]


def test_op13_equals_plain_counting(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    assert rows_of(q.op13_collocations(spark, "/root/testdata/sf0.01")) == sorted(brute_phrases(rows, 100), key=repr)


# 6: parts of other programs' files
def test_a_size_past_the_block_is_an_error_and_groups_have_key_frames():
    from factloom.llm import media

    def parse(block, *more):
        group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block) + b"".join(more))
        return media.packets(media._HEAD + media.element(media.SEGMENT, media.element(media.CLUSTER, media.uint(media.TIMESTAMP, 1) + group)))[0]

    head = lambda kind: media.size_bytes(1) + b"\x00\x00" + bytes([kind << 1])
    for broken in (b"\x01\xff\xff", b"\x01\xff\xff\xff", b"\x02\x01"):
        with pytest.raises(ValueError):
            parse(head(media.XIPH_LACING) + broken)
    plain = head(media.NO_LACING) + b"frame"
    assert [p.key for p in parse(plain)] == [True]
    assert [p.key for p in parse(plain, media.uint(media.REFERENCE_BLOCK, 5))] == [False]
