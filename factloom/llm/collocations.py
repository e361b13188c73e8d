"""Phrases of two to five words that occur together more often than their parts suggest.

1. Texts become codes: slices of the words of one language with their 64-bit hashes, written once. Words are counted; the hash
   of a frequent word stands for it alone (else all is done again with another seed), so hashes are names from here on.
2. Candidates, length by length: a phrase can only be frequent if its first and its last part, one word shorter, are. Both are
   looked up in a table of bits of fixed size, where a clash only lets more pass. What passes is counted by a short hash, slice by
   slice and then in a shuffle, and where that is frequent by (first part, last word). Nothing frequent is missed.
3. Counting: the candidates go into double-array tries of a bounded number of nodes, dealt by their first two words; each is
   broadcast, and numpy moves the states of all text positions at once, word by word, counting the accepting states. The
   counts of all tasks are summed; they are exact whatever hashes of phrases met in step 2.
4. Scores, the removal of phrases inside longer ones that are as frequent, and ranks are joins and windows.

Defined results: letters A-Z are lowered; a null text is an empty one; a null language is ``und``; repeated rows count as often as
they come; an empty table gives none; columns beside ``lang`` and ``text`` are ignored. A text is coded in slices cut
between pieces, so a very long one takes a slice's memory unless a single piece is longer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm import shared
from factloom.llm.common import dropped, released, staged

#: Bytes of text of a slice, bits of a table of frequent phrases, keys a task holds before it sends them, nodes of a trie.
SLICE, BITS, HELD, NODES = 1 << 22, 1 << 26, 1 << 21, 1 << 20
#: Bits of the hash by which words and phrases are counted first, and states whose counts travel as one row.
SHORT, STATES = 40, 1 << 12
#: Places of a trie that are searched at a time.
WINDOW = 1024
#: Bits of one row of a table of bits.
ROW_BITS = 1 << 15
#: Bytes: of words, blanks between words, ends of pieces.
WORD, BLANK, END = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = END
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_END = re.compile(b"[.,;:!?\n-\r]")


def _slices(texts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Texts joined by ends of pieces, about ``most`` bytes at a time; longer texts are cut behind an end."""
    held, size = [], 0
    for t in texts:
        at = 0
        while len(t) - at > most:
            m = _END.search(t, at + most)
            if not m:
                break
            yield t[at : m.end()]
            at = m.end()
        held.append(t[at:] if at else t)
        size += len(held[-1])
        if size >= most:
            yield b"\n".join(held)
            held, size = [], 0
    if size:
        yield b"\n".join(held)


def coded(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lowered words of a slice, and their codes from 1 with a 0 wherever a piece ends between two. Frequent words have small codes."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = kind == WORD
    begins, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=offsets[1:])
    body = np.ascontiguousarray(_LOW[raw[word[1:-1]]])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    piece = np.cumsum(kind == END, dtype=np.int32)[np.minimum(begins, max(len(raw) - 1, 0))] if len(begins) else np.zeros(0, np.int32)
    shift = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    codes = np.zeros(len(begins) + (int(shift[-1]) if len(shift) else 0), np.uint32)
    own = words.indices.to_numpy()
    order = np.argsort(-np.bincount(own, minlength=len(words.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes[np.arange(len(begins)) + shift] = rank[own] + 1
    return words.dictionary.take(pa.array(order)), codes


def _planes(values: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes before all second ones, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _values(raw: bytes, kind: np.dtype) -> np.ndarray:
    """The integers of ``_planes``."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def encode(docs: DataFrame, seed: int, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, n, hashes, names, codes) of each slice: its number of words, its distinct words as hashes and as lines, and its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            texts = b.column(1).cast(pa.binary())
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = xxhash.xxh64_intdigest(lang.encode(), seed)
                chosen = np.flatnonzero(langs.indices.to_numpy() == i).tolist()
                for data in _slices((texts[j].as_py() or b"" for j in chosen), slice_bytes):
                    words, codes = coded(data)
                    if not len(words):
                        continue
                    each = words.to_pylist()
                    h = np.fromiter((xxhash.xxh64_intdigest(w, own) for w in each), np.uint64, len(each))
                    row = [pa.array([x], k) for x, k in ((lang, pa.string()), (int(np.count_nonzero(codes)), pa.int64()), (h.tobytes(), pa.binary()), (b"\n".join(each), pa.binary()), (_planes(codes), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(row, ["lang", "n", "hashes", "names", "codes"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(released(run), "lang string, n long, hashes binary, names binary, codes binary")


def _hashes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _codes(value: pa.Scalar) -> np.ndarray:
    return _values(value.as_buffer(), np.dtype("<u4"))


def _times(codes: pa.Scalar, words: int) -> np.ndarray:
    """How often each word of a slice occurs."""
    return np.bincount(_codes(codes), minlength=words + 1)[1:]


def joined(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of phrases: each of a first part and a last word."""
    x = (p ^ (p >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _bits_of(names: DataFrame, column: str) -> bytes:
    """A table of ``BITS`` bits in which the lowest bits of every hash of a column are set; at most BITS / 8 bytes come together."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)
            order = np.argsort(at)
            at = at[order].astype(np.int64)
            for part in np.split(at, np.flatnonzero(np.diff(at // ROW_BITS)) + 1):
                if len(part):
                    rows.setdefault(int(part[0]) // ROW_BITS, np.zeros(ROW_BITS, bool))[part % ROW_BITS] = True
        for k, v in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(v).tobytes()], pa.binary())], ["row", "bits"])

    place = F.pmod(F.shiftright(F.col(column).bitwiseAND(BITS - 1), 15), F.lit(BITS // ROW_BITS))
    table = names.select(column).repartition(place).mapInArrow(released(fill), "row long, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in table.collect():
        at = r["row"] * (ROW_BITS // 8)
        out[at : at + ROW_BITS // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _counted(p: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs (p, w) once, with their numbers summed."""
    order = np.lexsort((w, p))
    p, w, n = p[order], w[order], n[order]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1]))) if len(p) else np.zeros(0, np.int64)
    return p[new], w[new], np.add.reduceat(n, new) if len(new) else n


def _sums(rows: DataFrame, extract, keys: dict[str, str], tasks: int, deal_by: str) -> DataFrame:
    """Sums (keys, n) of tables (keys, n) that ``extract`` makes of the record batches of ``rows``.

    A task sums what it meets and sends each other task lists of it, dealt by the hash in ``deal_by``.
    """
    names = list(keys)

    def together(tables: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(tables).group_by(names).aggregate([("n", "sum")])
        return pa.table({c: summed.column("n_sum" if c == "n" else c) for c in [*names, "n"]})

    def lists(own: pa.Table) -> Iterator[pa.RecordBatch]:
        h = own.column(deal_by).to_numpy().view(np.uint64)
        bucket = (joined(h, h) % np.uint64(tasks)).astype(np.int64)
        own, bucket = own.take(pa.array(np.lexsort((h, bucket)))).combine_chunks(), np.sort(bucket)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        columns = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), own.column(c).chunk(0)) for c in own.column_names]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *columns], ["bucket", *own.column_names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in extract(batches):
            if t.num_rows:
                held.append(t)
            if sum(x.num_rows for x in held) >= HELD:
                held = [together(held)]
                if held[0].num_rows >= HELD // 2:
                    yield from lists(held.pop())
        if held:
            yield from lists(together(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.table({c: b.column(c).flatten() for c in [*names, "n"]}) for b in batches if b.num_rows]
        if held:
            yield from together(held).combine_chunks().to_batches()

    many = ", ".join(f"{c} array<{k}>" for c, k in [*keys.items(), ("n", "long")])
    sent = rows.mapInArrow(released(send), f"bucket int, {many}")
    return sent.repartitionById(tasks, F.col("bucket")).mapInArrow(released(meet), ", ".join(f"{c} {k}" for c, k in [*keys.items(), ("n", "long")]))


def _passing(slices: DataFrame, bits: bytes, tasks: int) -> DataFrame:
    """(h, lang, word, n) of the words whose short hash is in a table of bits; only these travel as strings."""
    dense = slices.sparkSession.sparkContext.broadcast(bits)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = np.frombuffer(dense.value, np.uint8)
        for b in batches:
            for lang, hashes, names, codes in zip(*b.columns, strict=True):
                h = _hashes(hashes)
                keep = np.flatnonzero(_has(table, _short(h)))
                words = names.as_py().split(b"\n")
                some = pa.array([words[i] for i in keep.tolist()], pa.binary()).cast(pa.string())
                yield pa.table({"h": h[keep].view(np.int64), "lang": pa.array([lang.as_py()] * len(keep), pa.string()), "word": some, "n": _times(codes, len(h))[keep]})

    rows = slices.select("lang", "hashes", "names", "codes")
    return _sums(rows, extract, {"h": "long", "lang": "string", "word": "string"}, tasks, "h")


def _short(h: np.ndarray) -> np.ndarray:
    """The part of a hash by which words and phrases are counted first."""
    return h >> np.uint64(64 - SHORT)


def frequent(rows: DataFrame, extract, bits: int, min_count: int) -> DataFrame:
    """(h) of the short hashes that occur ``min_count`` times or more.

    extract: turns the record batches of ``rows`` into tuples (short hashes, numbers). A task counts what it meets and sends
    each other task one message at a time: the gaps between its sorted hashes and their numbers, compressed.
    """
    below = np.uint64(SHORT - bits)
    kind = np.dtype("<u4" if SHORT - bits <= 32 else "<u8")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def messages() -> pa.RecordBatch:
            key, n = held[0]
            bucket = (key >> below).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            low = key & ((np.uint64(1) << below) - np.uint64(1))
            packed = [zlib.compress(_planes(np.diff(low[x:y], prepend=np.uint64(0)).astype(kind)) + _planes(n[x:y].astype("<u4")), 6) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([y - x for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "packed"])

        for key, n in extract(batches):
            held.append(_once(key, n))
            size += len(held[-1][0])
            if size >= HELD:
                held = [_once(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
            if size >= HELD // 2 and len(held) == 1:
                yield messages()
                held, size = [], 0
        if held:
            held = [_once(*map(np.concatenate, zip(*held, strict=True)))]
            yield messages()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for bucket, keys, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = zlib.decompress(packed)
                low = np.cumsum(_values(raw[: keys * kind.itemsize], kind), dtype=np.uint64)
                held.append((low | np.uint64(bucket) << below, _values(raw[keys * kind.itemsize :], np.dtype("<u4")).astype(np.int64)))
        if held:
            key, n = _once(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= min_count].view(np.int64))], ["h"])

    sent = rows.mapInArrow(released(send), "bucket int, keys int, packed binary")
    return sent.repartitionById(1 << bits, F.col("bucket")).mapInArrow(released(meet), "h long")


def _once(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, with their numbers summed."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new], np.add.reduceat(n, new)


def extensions(slices: DataFrame, length: int, bits: bytes, min_count: int, dealt: int) -> DataFrame:
    """(p, w): first parts and last words of phrases of ``length`` words that occur ``min_count`` times or more.

    bits: the table of frequent phrases one word shorter; dealt: the bits of the number of tasks that count. Phrases are counted by a short hash first, which is all that is
    shuffled of most of them; only those whose hash is as frequent are counted by (p, w).
    """
    sc = slices.sparkSession.sparkContext
    known = sc.broadcast(bits)

    def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First parts, last words and short hashes of the phrases of each slice whose parts are frequent."""
        table = np.frombuffer(known.value, np.uint8)
        for b in batches:
            for hashes, codes in zip(b.column(0), b.column(1), strict=True):
                code = _codes(codes)
                h = np.append(np.uint64(0), np.frombuffer(hashes.as_buffer(), np.uint64))[code]
                inside, part = code > 0, h
                for j in range(1, length - 1):
                    part, inside = joined(part[:-1], h[j:]), inside[:-1] & (code[j:] > 0)
                often = inside & _has(table, part)
                at = np.flatnonzero(often[:-1] & often[1:])
                if len(at):
                    p, w = part[at], h[at + length - 1]
                    yield p, w, _short(joined(p, w))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for *_, key in phrases_of(batches):
            yield key, np.ones(len(key), np.int64)

    chosen = slices.select("hashes", "codes")
    counted = frequent(chosen, short, dealt, min_count)
    dense = sc.broadcast(_bits_of(counted, "h"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = np.frombuffer(dense.value, np.uint8)
        for p, w, key in phrases_of(batches):
            keep = _has(table, key)
            p, w, n = _counted(p[keep], w[keep], np.ones(int(keep.sum()), np.int64))
            yield pa.table({"p": p.view(np.int64), "w": w.view(np.int64), "n": n})

    found = _sums(chosen, whole, {"p": "long", "w": "long"}, 1 << dealt, "w")
    return found.filter(F.col("n") >= min_count).drop("n")


def _named(rows: DataFrame) -> DataFrame:
    """With column p as the hash of the phrase of columns p and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = joined(b.column("p").to_numpy().view(np.uint64), b.column("w").to_numpy().view(np.uint64))
            at = b.schema.get_field_index("p")
            yield b.set_column(at, "p", pa.array(p.view(np.int64)))

    return rows.mapInArrow(released(run), rows.schema)


def _room(used: np.ndarray, at: int, steps: np.ndarray) -> int:
    """The first place from ``at`` on, of ``WINDOW`` ones, with free slots so many ``steps`` on, or -1."""
    tries = at + np.flatnonzero(~used[at : at + WINDOW])
    # few steps leave fewer places, for which twice as many are looked up
    i, many = 1, 8
    while i < len(steps) and len(tries):
        tries = tries[~used[tries[:, None] + steps[i : i + many]].any(axis=1)]
        i, many = i + many, 2 * many
    return int(tries[0]) if len(tries) else -1


def double_array(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, slots): a trie of rows of symbols from 1 on, 0 after their end; slots are the states of the whole rows.

    A state s goes with symbol c to t = base[s] + c if check[t] is s. State 0 is the root; the symbols of its children are their
    slots. States with many children are placed first, each where all its children's slots are free; single ones fill the gaps. The search
    goes on where the last state of about as many children found room, so what is full is not searched again for each.
    """
    n, depth = keys.shape
    symbols = int(keys.max(initial=0))
    size = 2 * (symbols + n + 2) + 2 * WINDOW
    base, check, used = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
    first = np.unique(keys[:, 0])
    used[0] = used[first] = True
    check[first] = 0
    slots = keys[:, 0].astype(np.int64)

    def reach(end: int) -> None:
        nonlocal base, check, used
        while end >= len(used):
            more = len(used)
            base, check, used = np.append(base, np.zeros(more, np.int64)), np.append(check, np.full(more, -1, np.int64)), np.append(used, np.zeros(more, bool))

    for j in range(1, depth):
        rows = np.flatnonzero(keys[:, j])
        if not len(rows):
            break
        pairs, back = np.unique(slots[rows] << 32 | keys[rows, j], return_inverse=True)
        parent, symbol = pairs >> 32, pairs & 0xFFFFFFFF
        begins = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        counts = np.diff(np.append(begins, len(pairs)))
        several = np.flatnonzero(counts > 1)
        free, at, like = int(np.argmin(used)), 0, 0
        for i in several[np.argsort(-counts[several], kind="stable")].tolist():
            a, m = int(begins[i]), int(counts[i])
            if m.bit_length() != like:
                at, like = free, m.bit_length()
            own = symbol[a : a + m]
            while True:
                reach(at + WINDOW + symbols)
                found = _room(used, at, own - own[0])
                if found >= 0:
                    break
                at += WINDOW
            base[parent[a]] = found - own[0]
            taken = found + own - own[0]
            used[taken] = True
            check[taken] = parent[a]
        single = begins[counts == 1]
        reach(int(np.count_nonzero(used)) + len(single) + symbols)
        gaps = np.flatnonzero(~used)[: len(single)]
        base[parent[single]] = gaps - symbol[single]
        used[gaps] = True
        check[gaps] = parent[single]
        slots[rows] = (base[parent] + symbol)[back]
    top = int(np.flatnonzero(used)[-1]) + 1
    # beyond the last state there is room for any symbol
    return base[:top], np.append(check[:top], np.full(symbols + 1, -1)), slots


def occurrences(slices: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, n) of the phrases ``candidates`` (id, hashes): how often each occurs. A double-array trie of a bounded size at a time."""
    sc = slices.sparkSession.sparkContext
    parts = -(-candidates.count() // NODES)
    owner = F.pmod(F.xxhash64(F.col("hashes")[0], F.col("hashes")[1]), F.lit(max(parts, 1)))
    out = None
    for part in range(parts):
        rows = candidates.filter(owner == part).select("id", "hashes").orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        lists = rows.column("hashes").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        words, symbol = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        keys = np.zeros((len(sizes), int(sizes.max())), np.int64)
        keys[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = symbol + 1
        base, check, slots = double_array(keys)
        trie = sc.broadcast((words, base.astype(np.int32), check.astype(np.int32), slots.astype(np.int32), rows.column("id").to_numpy()))
        blocks = slices.select("hashes", "codes").mapInArrow(released(_counting(trie)), "block long, counts binary").repartition("block")
        counted = staged(blocks.mapInArrow(released(_summed(trie)), "id long, n long"), "occurrences")
        trie.unpersist()
        out = counted if out is None else out.unionByName(counted)
    return out


def _counting(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, check, slots, ids = trie.value
        total = np.zeros(len(base), np.int64)
        for b in batches:
            for hashes, codes in zip(b.column(0), b.column(1), strict=True):
                h = np.frombuffer(hashes.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(words, h), len(words) - 1)
                known = np.append(0, np.where(words[place] == h, place + 1, 0))
                symbol = np.append(known[_codes(codes)], 0).astype(np.int32)
                at = np.flatnonzero(symbol)
                state = symbol[at]
                live = check[state] == 0
                at, state = at[live], state[live]
                while len(at):
                    at = at + 1
                    step = symbol[at]
                    to = base[state] + step
                    live = (step > 0) & (check[to] == state)
                    at, state = at[live], to[live]
                    total += np.bincount(state, minlength=len(total))
        n = total[slots]
        blocks = [(k, n[at : at + STATES]) for k, at in enumerate(range(0, len(n), STATES)) if n[at : at + STATES].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], ["block", "counts"])

    return run


def _summed(trie):
    """Sums of the counts of each block of states, as (id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = trie.value[-1], {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(counts.as_buffer(), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[k * STATES : k * STATES + len(n)]), pa.array(n)], ["id", "n"])

    return run


def phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): (lang, n); (lang, words, f) of frequent words; (lang, words, f) of frequent phrases of two words or more."""
    slices = staged(encode(docs, seed), "coded")
    totals = staged(slices.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    dealt = shared.bits_for((totals.agg(F.sum("n")).first()[0] or 0) // 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for hashes, codes in zip(*b.columns, strict=True):
                h = _hashes(hashes)
                yield _short(h), _times(codes, len(h))

    dense = frequent(slices.select("hashes", "codes"), by_word, dealt, min_count)
    counted = staged(_passing(slices, _bits_of(dense, "h"), 1 << dealt).withColumnRenamed("n", "f"), "words")
    clash = counted.groupBy("h").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("c")).filter((F.col("c") > 1) & (F.col("f") >= min_count))
    if not clash.isEmpty():
        dropped(slices, totals, counted)
        return phrases(docs, min_count, longest, seed + 1)
    often = staged(counted.filter(F.col("f") >= min_count), "frequent")
    level = often.select(F.col("h").alias("p"), "lang", F.array("word").alias("words"), F.array("h").alias("hashes"))
    last = often.select(F.col("h").alias("w"), F.col("lang").alias("_lang"), "word")
    levels = []
    for length in range(2, longest + 1):
        found = extensions(slices, length, _bits_of(level, "p"), min_count, dealt)
        pairs = found.join(level, "p").join(last, "w").filter("lang = _lang")
        grown = pairs.select("p", "w", "lang", F.concat("words", F.array("word")).alias("words"), F.concat("hashes", F.array("w")).alias("hashes"))
        level = staged(_named(grown).drop("w"), "level")
        levels.append(level)
        if level.isEmpty():
            break
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    every = staged(every.withColumn("id", F.monotonically_increasing_id()), "candidates")
    dropped(*levels, counted)
    found = occurrences(slices, every)
    kind = every.select("lang", "words")
    out = kind.limit(0).withColumn("f", F.lit(0).cast("long")) if found is None else every.join(found.filter(F.col("n") >= min_count), "id").select("lang", "words", F.col("n").alias("f"))
    out = staged(out, "phrases")
    dropped(slices, every)
    return totals, often.select("lang", F.array("word").alias("words"), "f"), out


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by their least favourable cut."""
    totals, words, found = phrases(docs, min_count, longest)
    name = F.array_join("words", " ")
    parts = words.unionByName(found).select("lang", name.alias("part"), "f")
    size = F.size("words")
    cuts = found.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", name.alias("phrase"), "a", "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("right"),
    )
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    # products may pass 64 bits, so they are decimals of 38 digits
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase inside a longer one that is as frequent is inside one a single word longer that is, too
    inner = F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1)))
    around = found.filter(size > 2).select("lang", "f", inner.alias("words")).groupBy("lang", name.alias("phrase")).agg(F.max("f").alias("longer"))
    kept = least.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
