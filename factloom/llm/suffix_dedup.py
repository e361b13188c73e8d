"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller
doc_id; strings are judged on the input. The work is dealt out by content:

1. Every string of ``LENGTH`` bytes has an anchor, the leftmost least hash among its ``GRAM``-byte
   substrings, so equal strings have equal anchors and neighbouring strings share theirs: a
   document is a row of runs of strings, one run an anchor. Anchors of one document only are
   dropped (``shared.shared_keys``), the others go back to their documents.
2. Each run with such an anchor is sent, with its bytes, to the task of its anchor. A task takes whole
   anchors, about ``RUNS`` runs at a time, as one text with an index of its own, since no match leaves an anchor.
   It reads the runs in batches by ascending doc_id: each batch gets a suffix array (the places of its strings
   in sorted order), which is merge-scanned against the levels of the index, and becomes a level;
   levels of similar size merge, so there are logarithmically many.
3. The strings found go back to their documents as byte ranges.

Documents stay in one table bucketed by doc_id, so their texts are shuffled once. Exact copies of a
document with a smaller doc_id are found by digest and leave before step 1. Runs that repeat inside a chunk
of documents, byte for byte, are answered there and sent on once; an anchor of more than ``HOT`` documents has its
strings dealt each by its own hash. So neither a frequent passage nor its differing borders meet in
one task.

Defined results: a null text is an empty one; documents that share a doc_id are each judged against
smaller doc_ids only; documents without a doc_id stay whole and no other is judged against them; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from factloom.llm import shared
from factloom.llm.common import new_path, released, staged

LENGTH, GRAM = 50, 20
#: Documents from which an anchor's strings are dealt one by one.
HOT = 1000
#: Bytes of text hashed at a time, and bytes whose runs are gathered before they are sent.
SLICE, CHUNK = 1 << 20, 1 << 25
#: Runs that are indexed together (whole anchors), and batches they are read in.
RUNS, BATCHES = 1 << 15, 4
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k``-byte substring, by doubling."""
    power = lambda m: np.uint64(pow(_MULTIPLIER, m, 1 << 64))
    part = _mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    size, out, done = 1, None, 0
    while k >> size.bit_length() - 1:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(data) - done - size + 1
                out, done = out[:n] * power(size) + part[done : done + n], done + size
        if k < 2 * size:
            break
        n = len(data) - 2 * size + 1
        part, size = part[:n] * power(size) + part[size : size + n], 2 * size
    return _mix(out)


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, first string, last string, anchor, anchor hash) of all runs; places count in the joined texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = gram_hashes(data, GRAM)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[: len(least) - size], least[size:]), 2 * size
    if size < width:
        rest = width - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    whole = np.flatnonzero(doc[: len(least)] == doc[LENGTH - 1 : LENGTH - 1 + len(least)])
    anchor = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[whole][1:] != doc[whole][:-1])])) if len(whole) else whole
    last = np.concatenate([first[1:] - 1, [len(whole) - 1]]) if len(first) else first
    at = anchor[first]
    return doc[whole[first]], whole[first], whole[last], at, _mix(hashes[at] * np.uint64(_MULTIPLIER))


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with about ``SLICE`` bytes of text each."""
    for b in batches:
        texts = [t or b"" for t in b.column(column).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([len(t) for t in texts]) if texts else []
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, stop - at), texts[at:stop]
            at = stop


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for b, texts in _sliced(batches, 1):
        doc, *_, key = runs(texts)
        yield _ids(b.column(0))[doc], key, sum(map(len, texts))


class SuffixLevels:
    """A logarithmic family of suffix arrays over one text.

    A level is the places of distinct strings of ``LENGTH`` bytes in sorted order, each with the smallest document it starts in.
    """

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index the strings at the ``places`` of a batch, by ascending document, of no smaller documents than before; return which start in a smaller one."""
        strings = _windows(self.text, places)
        order = np.argsort(strings, kind="stable")
        ranked = strings[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        array, least, own = places[order][start], docs[order][start], ranked[start]
        size = np.diff(np.concatenate([start, [len(ranked)]]))
        for level, level_docs in self.levels:
            mine, theirs = self._meet(own, level)
            least[mine] = np.minimum(least[mine], level_docs[theirs])
        smaller = np.empty(len(strings), bool)
        smaller[order] = np.repeat(least, size) < docs[order]
        self.levels.append((array, least))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()
        return smaller

    def _scan(self, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of a level's strings and then ``own``, both sorted, and which are equal to the one before: a merge of two runs."""
        both = np.concatenate([_windows(self.text, level), own])
        order = np.argsort(both, kind="stable")  # a stable sort merges two sorted runs in one pass
        ranked = both[order]
        return order, np.concatenate([[False], ranked[1:] == ranked[:-1]])

    def _meet(self, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``own`` strings and those of a level are equal."""
        order, same = self._scan(own, level)
        at = np.flatnonzero(same)
        return order[at] - len(level), order[at - 1]

    def _merge(self) -> None:
        (a, a_docs), (b, b_docs) = self.levels[-2:]
        order, same = self._scan(_windows(self.text, b), a)
        start = np.flatnonzero(~same)
        docs = np.minimum.reduceat(np.concatenate([a_docs, b_docs])[order], start)
        self.levels[-2:] = [(np.concatenate([a, b])[order][start], docs)]


def _windows(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``LENGTH``-byte strings that start at the places ``first``, as fixed-size byte strings."""
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    return np.ascontiguousarray(view[first]).view(f"S{LENGTH}").ravel()


def _ranges(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) byte ranges covered by strings at the ascending places ``at`` of each ``row``."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + LENGTH)]) if len(at) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:] - 1, [len(at) - 1]]) if len(a) else a
    return row[a], at[a], at[b] + LENGTH


_RUN = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("starts", pa.binary()), ("n", pa.int64()), ("strings", pa.binary())])


def _run_batch(ids, tags, starts, n, keys=None, strings=None) -> pa.RecordBatch:
    """starts: the places of a run in its document, as packed 64-bit integers; n: its strings."""
    key = pa.array(keys) if keys is not None else pa.nulls(len(ids), pa.int64())
    text = pa.array(strings, pa.binary()) if strings is not None else pa.nulls(len(ids), pa.binary())
    return pa.RecordBatch.from_arrays([key, pa.array(ids), pa.array(tags), pa.array(starts, pa.binary()), pa.array(n), text], schema=_RUN)


def _packed(places: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    raw, ends = places.astype("<i8").tobytes(), (cuts * 8).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _send_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of step 2 of (doc_id, text, keys, hot keys); rows without a key are answers.

    Of equal runs in a chunk the smallest document's goes on, once with all its places; the others are answered.
    """
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids, tags, firsts, n, keys, hashes = (np.concatenate(c) for c in zip(*(h[:6] for h in held), strict=True))
        strings = [s for h in held for s in h[6]]
        while True:
            order = np.lexsort((firsts, tags, ids, hashes))
            group = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
            size = np.diff(np.concatenate([group, [len(order)]]))
            first, at = np.repeat(order[group], size), np.repeat(size > 1, size)
            # equal hashes count only with equal bytes; runs of one hash but other bytes get a number of their own
            other = [i for i, f in zip(order[at].tolist(), first[at].tolist(), strict=True) if strings[i] != strings[f]]
            if not other:
                break
            hashes[other] = _mix(hashes[other] + np.arange(1, len(other) + 1, dtype=np.uint64))
        ids, tags, firsts, n, keys, hashes = (c[order] for c in (ids, tags, firsts, n, keys, hashes))
        least = np.repeat(ids[group], np.diff(np.concatenate([group, [len(ids)]])))
        done = np.flatnonzero(ids > least)
        if len(done):
            back = done[np.lexsort((firsts[done], tags[done], ids[done]))]
            i, t, a, z = ids[back], tags[back], firsts[back], firsts[back] + n[back] - 1
            # runs that touch become one answer
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (a[1:] > z[:-1] + LENGTH)]))
            reach = np.maximum.reduceat(z, new)
            yield _run_batch(i[new], t[new], _packed(a[new], np.arange(len(new) + 1)), reach - a[new] + 1)
        rest = np.flatnonzero(ids == least)
        fresh = np.concatenate([[True], (hashes[rest][1:] != hashes[rest][:-1]) | (tags[rest][1:] != tags[rest][:-1])])
        cuts = np.concatenate([np.flatnonzero(fresh), [len(rest)]])
        places, kept = _packed(firsts[rest], cuts), rest[fresh]
        for a in range(0, len(kept), 1 << 14):
            r = kept[a : a + (1 << 14)]
            yield _run_batch(ids[r], tags[r], places[a : a + (1 << 14)], n[r], keys[r], [strings[i] for i in order[r].tolist()])

    for b, texts in _sliced(batches, 1):
        doc, first, last, _, key = runs(texts)
        short = shared.short(key, bits).view(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        wanted, hot = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        for i, (asked, very) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            a, z = bounds[i], bounds[i + 1]
            if asked and z > a:
                wanted[a:z] = np.isin(short[a:z], np.array(asked, np.int64))
                if very:
                    hot[a:z] = np.isin(short[a:z], np.array(very, np.int64))
        w = np.flatnonzero(wanted)
        if not len(w):
            continue
        h = hot[w]
        n = np.where(h, last[w] - first[w] + 1, 1)
        row = np.repeat(w, n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        f = np.where(hot[row], first[row] + inside, first[row])
        z = np.where(hot[row], f, last[row])
        joined = b"".join(texts)
        strings = [joined[a:c] for a, c in zip(f.tolist(), (z + LENGTH).tolist(), strict=True)]
        digest = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        tags = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
        base = starts[doc[row]]
        send_key = np.where(hot[row], _mix(digest), key[row])
        held.append((_ids(b.column(0))[doc[row]], tags[doc[row]], f - base, z - f + 1, send_key.view(np.int64), _mix(digest ^ send_key), strings))
        size += sum(map(len, texts))
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed places of all rows and the borders of each row's own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i8")
    return flat, (offsets - offsets[0]) // 8


def _answers(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(starts), pa.array(ends)], ["doc_id", "tag", "start", "end"])


def _index(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Answers of whole groups of runs (rows in any order)."""
    ids, tags, n = (table.column(i).to_numpy() for i in (1, 2, 4))
    places, borders = _places(pa.concat_arrays(table.column(3).chunks))
    strings = pa.concat_arrays(table.column(5).chunks)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    order, levels = np.argsort(ids, kind="stable"), SuffixLevels(data)
    for part in np.array_split(order, BATCHES):
        if not len(part):
            continue
        row = np.repeat(part, n[part])
        at = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        smaller = levels.add(offsets[row] + at, ids[row])
        r, a, b = _ranges(row[smaller], at[smaller])
        k = (borders[1:] - borders[:-1])[r]  # each range at every place of its run
        each = np.repeat(np.arange(len(r)), k)
        start = places[borders[r][each] + np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)]
        yield _answers(ids[r][each], tags[r][each], start + a[each], start + b[each])


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        done = b.filter(b.column(0).is_null())
        if done.num_rows:
            start, _ = _places(done.column(3))
            yield _answers(done.column(1), done.column(2), start, start + done.column(4).to_numpy() + LENGTH - 1)
            b = b.filter(b.column(0).is_valid())
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= RUNS:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            turns = np.flatnonzero(key[1:] != key[:-1])
            if len(turns):
                cut = int(turns[-1]) + 1
                yield from _index(table.slice(0, cut).combine_chunks())
                rest = table.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield from _index(pa.Table.from_batches(held))


def _apply(text: bytes, copy: bool, tags: list | None, starts: list | None, ends: list | None) -> tuple[int, int, bytes]:
    """(bytes removed, spans, kept bytes) of a document."""
    if copy:
        return (len(text), 1, b"") if len(text) >= LENGTH else (0, 0, text)
    if not tags:
        return 0, 0, text
    tag = xxhash.xxh64(text).intdigest()
    tag -= (tag >> 63) << 64
    own = sorted((a, b) for t, a, b in zip(tags, starts, ends, strict=True) if t == tag)
    kept, removed, spans, at = [], 0, 0, 0
    reach = -1
    for a, b in own:
        if a > reach:
            spans += 1
            kept.append(text[at:a])
            removed += b - a
            reach = b
        elif b > reach:
            removed += b - reach
            reach = b
        at = reach
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of ``docs`` (doc_id, text); ``kept`` are the bytes that stay.

    Other columns of ``docs`` come along unless they have one of these names. hot: documents from
    which an anchor's strings are dealt one by one.
    """
    spark = docs.sparkSession
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept")]
    carried = F.struct(*[F.col(f"`{c}`") for c in more]) if more else F.struct(F.lit(0).alias("none"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), carried.alias("carried"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    known = staged(docs.select("doc_id", digest.alias("sha"), F.octet_length("text").cast("long").alias("n")), "digests")
    total = known.agg(F.sum("n")).first()[0] or 0
    known = known.filter("doc_id is not null")
    first = known.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    first = staged(first.select("sha", "least"), "first-copies")
    copies = known.join(first, "sha").filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("sha").alias("copies"))
    # texts are shuffled once, into buckets that the later joins read as they lie
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = docs.join(copies, "doc_id", "left")
    flagged = joined.select("doc_id", "text", "carried", F.coalesce(F.array_contains("copies", digest), F.lit(False)).alias("copy"))
    name = "documents_" + new_path(spark, "").rsplit("-", 1)[1]
    writer = flagged.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "documents"))
    writer.bucketBy(buckets, "doc_id").saveAsTable(name)
    lying = spark.table(name)

    bits = shared.bits_for(total // 15, buckets)
    judged = lying.filter("not copy and doc_id is not null").select("doc_id", "text")
    anchors = shared.shared_keys(judged, _anchor_keys, bits, hot)
    keys = anchors.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("very"))
    asked = judged.join(keys, "doc_id").select("doc_id", "text", "keys", "very")
    sent = asked.mapInArrow(released(lambda it: _send_runs(it, bits)), "key long, doc_id long, tag long, starts binary, n long, strings binary")
    tasks = max(buckets, total // (32 << 20))
    spread = F.coalesce("key", F.xxhash64("doc_id", "starts"))
    dealt = sent.repartition(tasks, spread).sortWithinPartitions("key")
    ranges = dealt.mapInArrow(released(_meet_runs), "doc_id long, tag long, start long, end long")
    ranges = ranges.groupBy("doc_id").agg(F.collect_list("tag").alias("tags"), F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _sliced(batches, 1):
            rows = [_apply(t, *r) for t, r in zip(texts, zip(*(b.column(i).to_pylist() for i in range(3, 7)), strict=True), strict=True)]
            cols = list(zip(*rows, strict=True))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), b.column(2)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"],
            )

    final = lying.join(ranges, "doc_id", "left").select("doc_id", "text", "carried", "copy", "tags", "starts", "ends")
    longs = [StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    out = final.mapInArrow(released(apply), StructType([*longs, StructField("kept", BinaryType()), lying.schema["carried"]]))
    spark.sql(f"drop table {name}")  # its plan and its files stay, only the catalog's entry goes
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *([F.col(f"carried.`{c}`") for c in more]))
