import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, media, mixing, near, quality, simhash, suffix_dedup, token_store, topk, toxicity
from factloom.llm import queries as q
from factloom.llm import textmodel as tm
from tests.llm.helpers import SCHEMA, edge_docs, edge_rows, empty_docs, rows_of

SPACE = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.vocabulary())


# 1
def test_token_files_hold_the_library_ids(spark, library):
    got = token_store.checksums(token_store.read(spark, token_store.write(edge_docs(spark), q.vocabulary(), end_id=2, file_bytes=2000, block_tokens=64))).collect()
    start, want = 0, []
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in edge_rows()]
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_files_of_an_empty_table(spark):
    path = token_store.write(empty_docs(spark), q.vocabulary(), end_id=2)
    assert token_store.read(spark, path).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 3, 4, 5, 1000, 0])
    ranks = rng.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], int(counts.sum())).astype(np.uint32)
    control, data, sizes = token_store.encode_codes(ranks, counts)
    assert np.array_equal(token_store.decode_codes(control, data, counts), ranks) and sizes.sum() == len(data)


# 2
def brute_top(vectors, queries, k):
    out = []
    for i, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n,k,block", [(300, 5, 16), (50, 20, 7), (3, 20, 4)])
def test_shard_search_is_exact(n, k, block):
    rng = np.random.default_rng(n)
    v = rng.integers(-3, 4, (n, 6))
    shard = topk.Shard(np.arange(n), v, block)
    for i in range(0, n, 7):
        ids, scores = shard.best(i, v[i], k)
        assert [(i, r + 1, int(j), int(s)) for r, (j, s) in enumerate(zip(ids, scores))] == brute_top(list(enumerate(v.astype(int).tolist())), [(i, v[i].astype(int).tolist())], k)


def test_shard_reads_few_postings():
    """Groups of like vectors: most blocks are left out and most postings of the others are not read; the result is exact."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 8, (60, 32))
    v = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(0, 1.5, (6000, 32))).astype(np.int64)
    shard = topk.Shard(np.arange(6000), v, 128)
    for i in range(0, 6000, 300):
        ids, scores = shard.best(i, v[i], 20)
        full = v @ v[i]
        order = [j for j in np.lexsort((np.arange(6000), -full)) if j != i][:20]
        assert ids.tolist() == order and scores.tolist() == full[order].tolist()
    assert shard.read < 0.2 * 20 * v.size


def test_shard_of_large_numbers():
    v = np.array([[1 << 40, 3], [1 << 40, 2], [-(1 << 40), 1], [0, 0]], np.int64)
    shard = topk.Shard(np.arange(4), v[:, :1] // (1 << 9))
    ids, scores = shard.best(0, np.array([1 << 31], np.int64), 4)
    assert ids.tolist() == [1, 3, 2] and scores.tolist() == [1 << 62, 0, -(1 << 62)]
    with pytest.raises(OverflowError):
        topk.Shard(np.arange(4), v).best(9, v[0], 2)


def test_top_k_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(12)
    v = rng.integers(-4, 5, (400, 5)).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, v array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, 6)
    rows = list(enumerate(v))
    assert rows_of(got.select("query_id", "rank", "vec_id", "score")) == sorted(brute_top(rows, rows[::20], 6), key=repr)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [3.0]), (None, [9.0, 9.0]), (8, [-0.01, -0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x"))
    v = df.select("vec_id", topk.quantized(F.col("embedding")).alias("v")).filter("v is not null")
    got = topk.top_k(v.filter("vec_id % 20 = 0"), v, 20).select("query_id", "rank", "vec_id", "score")
    pad = lambda x: [*x, 0, 0][:2]
    base = [(i, pad([int(np.floor(64 * c)) for c in e])) for i, e in rows if i in (0, 20, 1, 6, 7, 8)]
    assert rows_of(got) == sorted(brute_top(base, [b for b in base if b[0] % 20 == 0], 20), key=repr)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# 3
def brute_simhash(rows, words=3, radius=2):
    found = []
    for i, t, *_ in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in SPACE.split(t) if x]
        shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        found.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    label = list(range(len(found)))
    changed = True
    while changed:
        changed = False
        for a in range(len(found)):
            for b in range(len(found)):
                if (found[a][1] ^ found[b][1]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), c in zip(found, label):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    return sorted([(i, f"{f:016x}", least[c]) for (i, f), c in zip(found, label)], key=repr)


def test_simhash_matches_brute_force(spark):
    out = simhash.groups(simhash.fingerprints(edge_docs(spark), 3), 2)
    text = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    assert rows_of(out.select("doc_id", text, "component_id")) == brute_simhash(edge_rows())
    assert simhash.groups(simhash.fingerprints(empty_docs(spark), 3), 2).count() == 0


def test_small_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 5, 400).tolist()}
    fps = [f - ((f >> 63) << 64) for f in sorted(fps)]
    df = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "doc_id long, fp array<long>")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, 2, bucket=8).collect()}
    u, label = np.array(fps).view(np.uint64), np.arange(len(fps))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    for _ in range(len(fps)):
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if np.array_equal(new, label):
            break
        label = new
    assert got == dict(enumerate(label.tolist()))


def test_near_duplicates_finds_similar_sets(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], [" ".join(rng.choice(vocabulary, 200)) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((i, t))
        w = t.split()
        w[100] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(40)) and all(got[100 + i] == i for i in range(40))


# 4
def brute_repeats(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if i is not None and first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 1000])
def test_suffix_dedup_matches_brute_force(spark, hot):
    out = suffix_dedup.remove_repeats(edge_docs(spark).drop("n_chars"), hot=hot)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows_of(got) == brute_repeats(edge_rows())
    assert "carried" in out.columns and out.filter("carried <> 'carried'").count() == 0


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_suffix_levels_merge_and_find():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, 3).astype(np.uint8)).ljust(50, b"x") for _ in range(800)]
    index, seen = suffix_dedup.SuffixLevels(np.frombuffer(b"".join(strings), np.uint8)), {}
    for batch in range(20):
        own = range(40 * batch, 40 * batch + 40)
        want = [seen.get(strings[i], batch) < batch for i in own]
        assert index.add(50 * np.array(own), np.full(40, batch)).tolist() == want
        for i in own:
            seen.setdefault(strings[i], batch)
    assert len(index.levels) <= 6 and sum(len(level) for level, _ in index.levels) < 200


def test_suffix_family_grows_geometrically():
    """Levels stay few while batches come in, and hold places, not strings."""
    rng = np.random.default_rng(5)
    text = rng.integers(0, 256, 64_000).astype(np.uint8)
    index = suffix_dedup.SuffixLevels(text)
    for batch in range(64):
        assert not index.add(np.arange(1000 * batch, min(1000 * batch + 1000, len(text) - 49)), np.full(min(1000, len(text) - 49 - 1000 * batch), batch)).any()
        assert len(index.levels) <= 8
    repeats = index.add(np.arange(5000, 5100), np.full(100, 99))
    assert repeats.all()


@pytest.mark.parametrize("same", [0, 1])
def test_equal_hashes_of_other_bytes(spark, monkeypatch, same):
    """Runs whose hashes all collide are told apart by their bytes."""
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh64_intdigest", lambda s: 5 if same and len(s) < 200 else hash(s) & (1 << 64) - 1)
    texts = [b"a" * 10 + bytes(range(48, 108)) + b"b" * k for k in range(4)] + [bytes(range(40, 100)) * 2]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(texts), pa.array([None] * 5, pa.list_(pa.int64())), pa.array([None] * 5, pa.list_(pa.int64()))], ["a", "b", "c", "d"])
    keys = suffix_dedup.runs(texts)[-1]
    wanted = [suffix_dedup.shared.short(keys, 4).view(np.int64).tolist()] * 5
    batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wanted), pa.array([[]] * 5, pa.list_(pa.int64()))], ["a", "b", "c", "d"])
    rows = [r for b in suffix_dedup._send_runs(iter([batch]), 4) for r in b.to_pylist()]
    sent = [r["strings"] for r in rows if r["key"] is not None]
    _, first, last, *_ = suffix_dedup.runs(texts)
    joined = b"".join(texts)
    assert set(sent) == {joined[a : z + 50] for a, z in zip(first.tolist(), last.tolist())}


# 5
def test_mixing_shares_and_bounds(spark):
    docs = edge_docs(spark)
    rows = mixing.mix(docs).collect()
    size = {}
    for _, t, _, s in edge_rows():
        size[s] = size.get(s, 0) + len([x for x in SPACE.split(t or "") if x])
    total, taken = sum(size.values()), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["target"] <= 3 * r["source_size"]
    assert len(rows) == len(edge_rows())
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - targets[s]) <= 24 for s in targets)
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    votes = [53, 24, 23, 7, 7, 0]
    df = spark.createDataFrame([(0, i, v, n) for n in (1,) for i, v in enumerate(votes)], "g int, p int, votes long, seats long")
    for seats in (0, 1, 5, 11, 30):
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df.withColumn("seats", F.lit(seats).cast("long")), ["g"], ["p"], "votes", "seats").collect()}
        heap = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(votes) for s in range(seats)))[:seats]
        assert got == {i: sum(1 for _, j in heap if j == i) for i in range(len(votes))}, seats


def test_mixing_in_many_groups(spark):
    """Shards in several groups, and a hot null doc_id: shares stay near the targets."""
    rows = [(None if i % 3 == 0 else i, "word " * (i % 40), "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, shard_words=100, group_shards=16, carry=True).select("*", F.col("carried.doc_id").alias("id")).collect()
    assert len(out) == 2000 and sum(r["id"] is None for r in out) == 667 and len({r["shard"] for r in out if r["doc_id"] is None}) > 20
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.01 * own[0]["target"]


def test_sainte_lague_of_many_equal_shards(spark):
    """A million equal parties with 2.4 seats each, in seconds; the smallest keys get the rest."""
    df = spark.range(1_000_000).selectExpr("0 as g", "id as p", "1000L as votes", "2400000L as seats")
    got = mixing.sainte_lague(df, ["g"], ["p"], "votes", "seats").groupBy("quota").agg(F.count("p").alias("n"), F.max("p").alias("last")).collect()
    assert {r["quota"]: (r["n"], r["last"]) for r in got} == {3: (400_000, 399_999), 2: (600_000, 999_999)}


def test_sainte_lague_against_a_heap(spark):
    rng = np.random.default_rng(4)
    votes = [rng.integers(0, 10 ** int(e), n).tolist() for n, e in ((3, 1), (40, 2), (40, 5), (25, 7), (60, 1))]
    seats = [7, 200, 33, 1000, 95]
    df = spark.createDataFrame([(g, p, int(v), seats[g]) for g, vs in enumerate(votes) for p, v in enumerate(vs)], "g int, p int, votes long, seats long")
    got = {(r["g"], r["p"]): r["quota"] for r in mixing.sainte_lague(df, ["g"], ["p"], "votes", "seats").collect()}
    for g, vs in enumerate(votes):
        best = sorted((-v / (2 * s + 1), i, s) for i, v in enumerate(vs) if v for s in range(seats[g]))[: seats[g]]
        assert [got[g, i] for i in range(len(vs))] == [sum(j == i for _, j, _ in best) for i in range(len(vs))]


# 6
def test_media_round_trip(spark):
    got = media.read_column(media.mux_column(edge_docs(spark))).collect()
    want = []
    for i, t, *_ in edge_rows():
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert media.read_column(media.mux_column(empty_docs(spark))).count() == 0


@pytest.mark.parametrize("kind", [media.XIPH_LACING, media.EBML_LACING, media.FIXED_LACING])
def test_lacings_parse(kind):
    frames = [b"a" * n for n in ((40, 300, 255, 7) if kind != media.FIXED_LACING else (5, 5, 5))]
    block = media.size_bytes(3) + b"\x00\x10" + bytes([kind << 1]) + media.lace(frames, kind)
    cluster = media.element(media.CLUSTER, media.uint(media.TIMESTAMP, 100) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block)))
    unknown = media.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster
    data = media._HEAD + unknown
    table, _ = media.packets(data)
    assert [data[p.start : p.end] for p in table] == frames and {p.track for p in table} == {3} and [p.timestamp for p in table] == [116_000_000] * len(frames)


def test_timestamps_of_laced_frames():
    """The timestamp scale, a track's frame duration and a block's own duration."""
    frames = [b"x" * 4, b"y" * 9]
    block = lambda track: media.size_bytes(track) + b"\x00\x02" + bytes([media.XIPH_LACING << 1]) + media.lace(frames, media.XIPH_LACING)
    entry = lambda number, ns: media.element(media.TRACK_ENTRY, media.uint(media.TRACK_NUMBER, number) + (media.uint(media.DEFAULT_DURATION, ns) if ns else b""))
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block(2)) + media.uint(media.BLOCK_DURATION, 10))
    cluster = media.element(media.CLUSTER, media.uint(media.TIMESTAMP, 7) + media.element(media.SIMPLE_BLOCK, block(1)) + group + media.element(media.SIMPLE_BLOCK, block(3)))
    setup = media.element(media.INFO, media.uint(media.TIMESTAMP_SCALE, 1000)) + media.element(media.TRACKS, entry(1, 333) + entry(2, 50) + entry(3, 0))
    table, _ = media.packets(media._HEAD + media.element(media.SEGMENT, cluster + setup))
    assert [(p.track, p.timestamp) for p in table] == [(1, 9000), (1, 9333), (2, 9000), (2, 14000), (3, 9000), (3, 9000)]


def test_media_features_against_the_payload(spark):
    """Features by plain Python from the padded texts."""
    got = {(r["doc_id"], r["n_bytes"]): r["feature"] for r in media.read_column(media.mux_column(edge_docs(spark))).collect()}
    for i, t, *_ in edge_rows():
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        n = len(raw) // 576
        cues = -(-n // 128)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(raw, raw[1:]))
        assert got[i, len((t or "").encode())] == f"packets={n};cues={cues}/{cues};ms={72 * n};mean={sum(raw) // len(raw)};crossings={crossings};key={n}"


def test_broken_media_raises():
    with pytest.raises(ValueError):
        media.packets(media.mux(media.pad(b"x"))[:-5])


# 7 and 10
def labelled(spark, n=400):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(["tree", "river", "stone", "cloud", "grass", "hill", "wind"], 40).tolist()
        toxic, low = i % 7 == 0, i % 5 == 1
        if toxic:
            words[3] = str(rng.choice(["vilefool", "vileclod", "dreadoaf"]))
        text = " ".join(words)
        rows.append((i, text.upper().replace(" ", "!! ") if low else text, "en", f"s{i % 3}"))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_toxicity_on_held_out_rows(spark):
    docs, labels, n = labelled(spark)
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).collect()}
    held_out = range(0, n, 2)
    assert sum(got[i] == (i % 7 == 0) for i in held_out) >= 0.97 * len(held_out)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, chain).collect()}
    assert kept == {i for i, t in got.items() if not t}
    edge = edge_docs(spark)
    assert toxicity.score(edge, chain).count() == edge.count() and toxicity.keep_clean(edge, chain).columns == edge.columns
    assert toxicity.score(empty_docs(spark), chain).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels, n = labelled(spark)
    chain = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, chain).filter("toxic").count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (3, 1, 0), (3, 1, 0)], labels.schema)
    assert toxicity.score(docs, toxicity.train(docs, nulls)).filter("toxic").count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels, n = labelled(spark)
    out = quality.grade(docs, quality.train(docs, labels))
    got = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert sum(got[i] == (i % 5 != 1) for i in range(0, n, 2)) >= 0.97 * n / 2
    edge = edge_docs(spark)
    model = quality.train(docs, labels.limit(0))
    assert quality.grade(edge, model).count() == edge.count()
    assert quality.grade(empty_docs(spark), model).count() == 0


def test_sparse_sites_shrink_to_their_priors(spark):
    rows = [("big", "x", 0.9)] * 200 + [("bad", "x", 0.1)] * 200 + [("bad", "y", 0.9)] + [("new", "x", 0.9)]
    scores = spark.createDataFrame(rows, "host string, path string, p_text double")
    paths, strength, _, mean = quality.site_posteriors(scores)
    got = {(r["host"], r["path"]): (r["s"] + strength * r["host_mean"]) / (r["n"] + strength) for r in paths.collect()}
    assert abs(got["big", "x"] - 0.9) < 0.02 and got["bad", "y"] < 0.9 and 0.45 < mean < 0.55
    assert got["new", "x"] <= got["big", "x"]


def brute_strength(groups, mean):
    """Pseudo-counts by the method of moments of groups of values around ``mean(group)``."""
    n, k = sum(map(len, groups.values())), len(groups)
    between = sum(len(v) * (np.mean(v) - mean(g)) ** 2 for g, v in groups.items()) / n
    within = sum(np.sum((np.array(v) - np.mean(v)) ** 2) for v in groups.values()) / n
    all_ = sum(len(v) * mean(g) * (1 - mean(g)) for g, v in groups.items()) / n
    excess = between - within * k / n
    return min(1e6, max(1.0, all_ / excess)) if excess > 1e-12 else 1e6


def test_posteriors_against_brute_force(spark):
    """Hosts and paths of very different sizes, many with one document; each posterior by plain Python from all other documents."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(700):
        host = "hot" if i % 3 == 0 else f"h{int(rng.integers(0, 60) ** 1.3)}"
        rows.append((i, "good " * int(rng.integers(1, 9)), host if i % 50 else None, f"p{int(rng.integers(0, 4))}"))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.TextModel(tm.Features({}), None)
    p = {i: float(np.clip(0.1 + 0.8 * (len(t) % 7) / 7 + 0.1 * (h == "hot"), 0, 1)) for i, t, h, _ in rows}
    lookup = {t.encode(): None for _, t, *_ in rows}
    model.predict = lambda texts: np.array([0.1 + 0.8 * (len(t) % 7) / 7 for t in texts])
    p = {i: 0.1 + 0.8 * (len(t) % 7) / 7 for i, t, *_ in rows}
    assert lookup
    got = {r["doc_id"]: r for r in quality.grade(docs, model, "lang", "source").collect()}
    hosts, paths = {}, {}
    for i, _, h, q in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, q), []).append(p[i])
    mean = np.mean(list(p.values()))
    k1 = brute_strength(hosts, lambda g: mean)
    host_mean = {h: (sum(v) + k1 * mean) / (len(v) + k1) for h, v in hosts.items()}
    k2 = brute_strength(paths, lambda g: host_mean[g[0]])
    assert sum(len(v) == 1 for v in paths.values()) > 20
    for i, _, h, q in rows:
        at_host = (sum(hosts[h]) - p[i] + k1 * mean) / (len(hosts[h]) - 1 + k1)
        at_path = (sum(paths[h, q]) - p[i] + k2 * at_host) / (len(paths[h, q]) - 1 + k2)
        odds = p[i] / (1 - p[i]) / (mean / (1 - mean)) * at_path / (1 - at_path)
        assert abs(got[i]["p_host"] - at_host) < 1e-6 and abs(got[i]["p_path"] - at_path) < 1e-6 and abs(got[i]["p_good"] - odds / (1 + odds)) < 1e-6


def test_chain_against_brute_force(spark):
    """The chain's models by plain gradient descent, and its terms and out-of-fold inputs by plain loops."""
    docs, labels, n = labelled(spark, 200)
    chain = toxicity.train(docs, labels, terms=4, k=3)
    texts, toxic, weights, rows = tm.labelled_sample(docs, labels, "toxic", 6000)
    fold = np.arange(len(texts)) % 3

    def descend(x, y, w):
        mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
        z, b = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        ridge = np.array([2.0] * x.shape[1] + [1e-3])
        rate = 1 / (0.25 * np.linalg.norm((z * w[:, None]).T @ z, 2) + 2)
        for _ in range(40000):
            b -= rate * (z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) + ridge * b)
        return lambda v: 1 / (1 + np.exp(-np.c_[(v - mean) / scale, np.ones(len(v))] @ b))

    junk = np.array([float(r["toxic"] > 0 and r["quality"] <= 0) for r in rows])
    prose = np.array([float(r["toxic"] > 0 and r["quality"] > 0) for r in rows])
    full = tm.Features(tm.choose_terms(texts, toxic, 4))
    held, parts, want = [], [], []
    for f in range(3):
        keep = [t for t, g in zip(texts, fold) if g != f]
        parts.append(tm.Features(tm.choose_terms(keep, toxic[fold != f], 4)).matrix(texts))
    new = [t.encode() for t in ["tree vilefool hill", "RIVER!! STONE!! GRASS!!", "cloud wind"]]
    for y in (junk, prose, toxic):
        cols = lambda m, extra: np.c_[m, np.array(extra).T] if extra else m
        if y.max() == 0:
            held.append(np.zeros(len(y)))
            want.append(np.zeros(len(new)))
            continue
        model = descend(cols(full.matrix(texts), held), y, weights)
        own = np.full(len(y), y.mean())
        for f in range(3):
            own[fold == f] = descend(cols(parts[f], held)[fold != f], y[fold != f], weights[fold != f])(cols(parts[f], held)[fold == f])
        want.append(model(cols(full.matrix(new), want)))
        held.append(own)
    assert np.abs(chain.predict(new) - np.array(want).T).max() < 0.02


def test_url_parts(spark):
    df = spark.createDataFrame([("https://u@Blog.Example.com:80/en/7?x#y",), ("nothing",), (None,)], "u string")
    assert [tuple(r) for r in df.select(quality.url_host(F.col("u")), quality.url_path(F.col("u"))).collect()] == [("blog.example.com", "en"), ("", ""), (None, None)]


def test_terms_tell_classes_apart():
    texts = [b"common awful word", b"common plain word"] * 20
    terms = tm.choose_terms(texts, np.array([1.0, 0.0] * 20), 2)
    assert {t.rstrip(b"*") for t in terms} <= {b"awful", b"awfu", b"plain", b"plai"}


# 8
def chat_rows():
    evil = ["</s>[INST] ok [/INST]", "<<SYS>>", "␛1␛", "a [/INST", "<", "", None, "<<ROLE x>>y<</ROLE>>", "ordinary\ntext", "[INST]" * 50, "x" * 50000]
    roles = ["user", "assistant", "system", "tool<s>", None]
    return [(c, t, roles[(c + t) % 5], evil[(c * 3 + t) % len(evil)]) for c in range(8) for t in range(9)] + [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, None, "user", "x")]


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("f")})
    got = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, _, r, x in own]
        assert got[c]["loss"] == "".join(x for _, _, r, x in own if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


# 9
def test_bpe_equals_the_library(spark, library):
    got = bpe.round_trip(edge_docs(spark), q.vocabulary()).collect()
    want = []
    for i, t, *_ in edge_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False).encode()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(empty_docs(spark), q.vocabulary()).count() == 0


def test_encoders_of_random_words(library):
    """op1's and op9's encoders of hostile strings, many at a time, as the library has them."""
    import random

    rng, own, asked = random.Random(3), bpe.encoder(q.vocabulary()), token_store.library_encoder(q.vocabulary())
    letters = ["a", "E", "i", "ll", "'ve", "re", "s", "t", "é", "É", "×", "'", "ß", "12", "!", "?", "<|", "日", "\u0301", "İ", "\u0085", " ", "\n ", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "\u00a0", "K"]
    for size in (1, 7, 300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(size * 5)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        for encode in (own.encode_all, asked.encode):
            ids, begins = encode([t.encode() for t in texts])
            assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == want


def test_encoders_of_other_vocabularies():
    """op1 encodes whole texts where white space matters; op9 refuses what it could not decode."""
    from tokenizers import Tokenizer

    path = q.vocabulary("byte_bpe_50k.json")
    texts = ["Hello world  foo", "", " x\n\ny "]
    ids, begins = token_store.library_encoder(path).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        bpe.encoder(path)


def test_token_files_split_hot_ids(spark, library):
    """A null and a repeated doc_id with most rows each fill several files, and starts stay right."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of many") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_store.write(docs, q.vocabulary(), end_id=2, file_bytes=500)
    got = token_store.read(spark, path).collect()
    assert sorted(r["ids"] for r in got) == sorted(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows)
    ordered = sorted(got, key=lambda r: r["start"])
    ends = np.cumsum([r["n_tokens"] for r in ordered])
    assert [r["start"] for r in ordered] == [0, *ends[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids) and spark.read.format("binaryFile").load(f"{path}/blocks").filter("length > 0").count() > 10


def test_bounds_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(token_store, "CUTS", 8)
    ids = spark.range(1000).selectExpr("case when id % 3 = 0 then 500 else id end as doc_id")
    bounds = token_store._bounds(ids, 60)
    assert 40 <= len(bounds) <= 70 and sorted(bounds.tolist()) == bounds.tolist() and (bounds == 500).sum() > 10
