"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared inside buckets of fingerprints that agree on some bits. The bits of many
fingerprints are stored vertically, one plane for each bit; a plane xor the same plane shifted by
an offset compares every fingerprint with the one so many rows on, 64 at a time; carry-save
counters add the differing bits up, and words whose lanes have all passed the radius are abandoned.

Buckets: ``exact_keys`` cuts the bits so that any two fingerprints within the radius agree on a whole
key (pigeonhole), so no link is lost. A bucket of more than ``BUCKET`` fingerprints is not compared but cut by
further bits in the same way, until it is small; equal fingerprints are one, so that always ends. A bucket emits
a spanning forest of its links, and components are found over all of them.

Defined results: a null or empty text has the fingerprint zero, which links like any other; fewer
words than a shingle are one shingle; repeated rows share fingerprint and component; rows without a
doc_id link others like any row, and a component of only such rows has no component_id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import graph
from factloom.llm.common import dropped, released, staged

#: Fingerprints that are compared in one bucket at most.
BUCKET = 128
#: Rows of whole buckets that a task compares at a time.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z lower-cased."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash made of each hash; the first is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """``width`` signed 64-bit words; a bit is 1 if set in over half the hashes."""
    out = []
    for k in range(width):
        total = np.zeros(64, np.int64)
        for i in range(0, len(hashes), CHUNK):
            words = _mixed(hashes[i : i + CHUNK], k).astype("<u8")
            total += np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, repeats: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, fp) of all whole texts; fp is an array of ``width`` longs. repeats: count repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t or b"", words)
                fps.append(fingerprint(h if repeats else np.unique(h), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(run), f"{key} {kind}, fp array<long>")


class Planes:
    """Bit planes of fingerprints, and comparison of each with the one ``offset`` rows on."""

    def __init__(self, fps: np.ndarray, radius: int):
        n, width = fps.shape
        words = -(-n // 64) + 2
        self.planes = np.empty((64 * width, words), "<u8")
        flat = np.zeros((64, words * 64), np.uint8)
        for w in range(width):  # one word at a time, which keeps the unpacked bits few
            flat[:, :n] = np.unpackbits(np.ascontiguousarray(fps[:, w]).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
            self.planes[64 * w : 64 * w + 64] = np.packbits(flat, axis=1, bitorder="little").view("<u8")
        self.radius = radius
        # counters start so that they run over at radius + 1
        self.counters = (radius + 1).bit_length()
        self.bias = (1 << self.counters) - 1 - radius

    def within(self, offset: int, live: np.ndarray) -> np.ndarray:
        """Which of the lanes of ``live`` (a bool for each row) are within the radius of the row ``offset`` on."""
        lanes = np.zeros(-(-len(live) // 64) * 64, np.uint8)
        lanes[: len(live)] = live
        alive = np.packbits(lanes, bitorder="little").view("<u8").copy()
        at = np.flatnonzero(alive)
        alive = alive[at]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        counts = [np.full(len(at), full if self.bias >> k & 1 else 0, np.uint64) for k in range(self.counters)]
        far, by, back = offset // 64, np.uint64(offset % 64), np.uint64(64 - offset % 64)
        planes, last = self.planes, self.planes.shape[1] - 1
        for k in range(len(planes)):
            p = planes[k]
            other = p[at + far] >> by if not offset % 64 else p[at + far] >> by | p[np.minimum(at + far + 1, last)] << back
            carry = p[at] ^ other
            for c in counts[:-1]:
                carry, c[:] = c & carry, c ^ carry
            over, counts[-1] = counts[-1] & carry, counts[-1] ^ carry
            alive &= ~over
            if k % 8 == 7:
                keep = np.flatnonzero(alive)
                if not len(keep):
                    return np.zeros(0, np.int64)
                if len(keep) < 0.75 * len(at):
                    at, alive, counts = at[keep], alive[keep], [c[keep] for c in counts]
        bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(bits)
        return at[word] * 64 + lane


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of each pair in place; return which pairs joined two sets (or may have)."""
    useful = np.zeros(len(a), bool)
    todo = np.arange(len(a))
    while True:
        la, lb = labels[a[todo]], labels[b[todo]]
        todo = todo[la != lb]
        if not len(todo):
            return useful
        la, lb = labels[a[todo]], labels[b[todo]]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        np.minimum.at(labels, high, low)
        useful[todo[labels[high] == low]] = True
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def links(groups: np.ndarray, fps: np.ndarray, radius: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that span the links inside each group; ``groups`` are sorted.

    Rows with equal ``known`` labels are linked already and not compared.
    """
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    order = np.argsort(-sizes, kind="stable")  # large groups first: those with rows left are a prefix
    size = np.repeat(sizes[order], sizes[order])
    place = np.arange(len(size)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    rows = np.repeat(starts[order], sizes[order]) + place
    planes = Planes(fps[rows], radius)
    by_label = np.lexsort((np.arange(len(rows)), known[rows], groups[rows]))
    fresh = np.concatenate([[True], (known[rows][by_label][1:] != known[rows][by_label][:-1]) | (groups[rows][by_label][1:] != groups[rows][by_label][:-1])])
    labels = np.empty(len(rows), np.int64)
    labels[by_label] = by_label[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for offset in range(1, int(sizes.max(initial=0))):
        n = int(np.searchsorted(-size, -offset, side="left"))
        live = place[:n] + offset < size[:n]
        live &= labels[:n] != np.concatenate([labels[offset : n + offset], np.full(max(0, n + offset - len(labels)), -1)])[:n]
        a = planes.within(offset, live) if live.any() else ()
        if len(a):
            a = a[live[a]]
            useful = _join(labels[:n], a, a + offset)
            found.append((rows[a[useful]], rows[a[useful] + offset]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def exact_keys(radius: int, bits: int = 64):
    """Keys of which any two fingerprints within the radius share one: pairs of radius + 2 pieces of the bits.

    Returns the keys and the function that cuts a large bucket: by one of radius + 1 pieces of
    the bits that its key leaves free, of which two such fingerprints again share one.
    """
    pieces = [frozenset(range(i, bits, radius + 2)) for i in range(radius + 2)]

    def cut(parent: frozenset, _number: int) -> list[frozenset]:
        free = [i for i in range(bits) if i not in parent]
        return [parent | p for p in (frozenset(free[i :: radius + 1]) for i in range(radius + 1)) if p]

    return [a | b for a, b in combinations(pieces, 2)], cut


def _masks(keys: list[tuple[int, frozenset]], width: int) -> Column:
    """A constant array of (key, m0, m1, ...): the number of each key and its bits as words."""

    def words(bits: frozenset) -> list[int]:
        out = np.zeros(64 * width, np.uint8)
        out[list(bits)] = 1
        return [int(x) for x in np.packbits(out, bitorder="little").view("<i8")]

    one = lambda k, bits: F.struct(F.lit(k).alias("key"), *[F.lit(m).alias(f"m{i}") for i, m in enumerate(words(bits))])
    return F.array(*[one(k, bits) for k, bits in keys])


def similar_links(nodes: DataFrame, keys: list[frozenset], cut, radius: int, width: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of the nodes (node, fp, label) within the radius, spanning the links between labels in all buckets.

    A bucket counts if it holds two labels. Its rows travel without their fingerprints until then.
    """
    known = dict(enumerate(keys))
    asked, wide, small, held = list(known.items()), nodes, None, []
    while True:
        each = _masks(asked, width) if wide is nodes else _children(asked, width)
        value = F.xxhash64(*[F.col("fp")[i].bitwiseAND(F.col(f"_.m{i}")) for i in range(width)])
        rows = wide.select("node", "label", "fp", F.explode(each).alias("_")).select("node", "label", "_.key", value.alias("value"))
        # counts are aggregated before the shuffle and joined back, so a large bucket is no single group
        buckets = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        rows = rows.join(buckets.filter("low <> high").select("key", "value", "n"), ["key", "value"])
        rows = staged(rows.select("key", "value", "node", "n"), "buckets")
        held.append(rows)
        large = [r["key"] for r in rows.filter(F.col("n") > bucket).select("key").distinct().collect()]  # at most one row a key
        below = {k: cut(known[k], k + 1) for k in sorted(large)}
        last = [k for k in large if not below[k]]
        fine = (F.col("n") <= bucket) | F.col("key").isin(last) if last else F.col("n") <= bucket
        part = rows.filter(fine).select("key", "value", "node")
        small = part if small is None else small.unionByName(part)
        if not any(below.values()):
            break
        asked, fresh = [], len(known)
        for k, sets in below.items():
            if sets:
                asked.append((k, list(enumerate(sets, fresh))))
                known.update(asked[-1][1])
                fresh += len(sets)
        # keys grow, so the value of a part covers that of its bucket
        wide = rows.filter(~fine).select("key", "node").distinct().join(nodes, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def some(table: pa.Table) -> pa.RecordBatch:
            key, value, node, label = (table.column(i).to_numpy() for i in range(4))
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (value[1:] != value[:-1])]))
            flat = pa.concat_arrays(table.column(4).chunks).flatten().to_numpy().view(np.uint64).reshape(-1, width)
            a, b = links(group, flat, radius, label)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                table = pa.Table.from_batches(held)
                key, value = table.column(0).to_numpy(), table.column(1).to_numpy()
                turns = np.flatnonzero((key[1:] != key[:-1]) | (value[1:] != value[:-1]))
                if len(turns):
                    at = int(turns[-1]) + 1
                    yield some(table.slice(0, at))
                    held = table.slice(at).combine_chunks().to_batches()
        if sum(x.num_rows for x in held):
            yield some(pa.Table.from_batches(held))

    full = small.join(nodes, "node").select("key", "value", "node", "label", "fp")
    found = staged(full.repartition("key", "value").sortWithinPartitions("key", "value").mapInArrow(released(compare), "a long, b long"), "links")
    dropped(*held)
    return found


def _children(asked: list[tuple[int, list]], width: int) -> Column:
    """The keys below the ``key`` of a row in a large bucket."""
    out = None
    for k, sets in asked:
        out = (F if out is None else out).when(F.col("key") == k, _masks(sets, width))
    return out


def groups(fps: DataFrame, radius: int, width: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of ``fps`` (doc_id, fp): documents whose fingerprints link, by smallest doc_id.

    A node is a fingerprint with a number of its own, so rows without a doc_id link others too.
    """
    keys, cut = exact_keys(radius, 64 * width)
    fps = staged(fps.select("doc_id", "fp"), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = similar_links(nodes.select("node", "fp", F.col("node").alias("label")), keys, cut, radius, width, bucket)
    found = graph.components(edges)
    roots = staged(nodes.join(found, "node", "left").select("fp", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = staged(roots.join(least, "root").select("fp", "component_id"), "labels")
    dropped(nodes, edges, found, roots)
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
