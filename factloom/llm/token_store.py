"""Token-id files: frequency-ranked ids in byte-aligned variable-length codes.

All texts are encoded with the tokenizers library and staged, each task with the counts of its ids;
the ids of the whole corpus are ranked, frequent ids first; documents are dealt by ranges of doc_id
and written as files of blocks. A block holds a header, its documents' ids and lengths, a stream of
control bytes (two bits for each rank: its code takes one to four bytes) and a stream of data bytes.
Reading looks up the four lengths of each control byte in a table and gathers the ranks with numpy.

Files are written and read by Spark's own sources, so any file system that Spark reaches will do:
a block is one row of a text file whose line separator is not part of the block. A file is about
``file_bytes``, which grows with the corpus between two bounds; a block is bounded by
``block_tokens`` or one document. A doc_id that many rows share, null among them, fills as many
files as it needs: its rows are dealt by a hash of their ids.

Defined results: a null text is an empty one and has the end id alone; documents with equal ids
lie next to each other, ordered by their tokens' hash; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import LatinEncoder, flat, gathered, latin_pieces, names_of, packed, slices, splits_latin, texts_of
from factloom.llm.common import new_path, released, staged

#: Header of a block: magic, global number of the first token, documents, control bytes, data bytes.
MAGIC, HEADER = b"TKB1", struct.Struct("<4sqqqq")
#: Pieces that the library encodes in one call, bytes of text that are split and rows that are coded at a time.
CALL_WORDS, TEXT_BYTES, ROWS = 256, 1 << 22, 512
#: Pieces that a worker keeps at most (about 150 bytes each).
CACHE = 1 << 19
#: Files of a corpus and bytes of a file at least and at most, if the caller does not say.
FILES, FILE_BYTES = 20_000, (8 << 20, 256 << 20)
#: Cuts that are taken in one step at most.
CUTS = 1000
#: Stands for a null doc_id in a file.
NONE = -(1 << 63)
#: Lengths of the four codes that a control byte tells of.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


class LibraryEncoder:
    """The tokenizers library, with the ids of pre-tokens kept in a bounded cache.

    Texts are cut into pre-tokens where the vocabulary splits as ``latin_pieces`` does; those that are new go to
    the library many at a time. Other vocabularies get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = sorted((i, t.content) for i, t in self.library.get_added_tokens_decoder().items())
        self.mark = specials[-1] if specials else None
        self.specials = [t.encode() for _, t in specials]
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), 1 + (specials[-1][0] if specials else 0))
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.latin = splits_latin(path)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.pieces: dict[bytes, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pick(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, k = ids.tobytes(), self.dtype.itemsize
        return [raw[a:b] for a, b in zip((k * starts).tolist(), (k * ends).tolist(), strict=True)]

    def _ask_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens: each has one token that ends a word, its last."""
        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return self._ask(pieces)
        return self._pick(ids, np.concatenate([[0], ends[:-1]]), ends)

    def _ask(self, words: list[str]) -> list[bytes]:
        """The ids of words without special tokens inside."""
        if self.mark is None:
            return [self._one(w) for w in words]
        mark_id, mark = self.mark
        ids = np.array(self.library.encode_batch_fast([f" {mark} ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(ids == mark_id)
        if len(cuts) != len(words) - 1:
            return [self._one(w) for w in words]
        return self._pick(ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new pieces, which are kept while there is room."""
        out: dict[bytes, bytes] = {b"": b""}
        for kind, some in self._sorted(new):
            for i in range(0, len(some), CALL_WORDS):
                call = some[i : i + CALL_WORDS]
                out.update(zip(map(str.encode, call), kind(call), strict=True))
        if len(self.pieces) + len(out) <= CACHE:
            self.pieces.update(out)
        return out

    def _sorted(self, new: list[bytes]) -> list[tuple]:
        """(how to ask, strings) of pre-tokens, words and stretches with special tokens."""
        special = {p for p in new if any(s in p for s in self.specials)} if any(s in b" ".join(new) for s in self.specials) else set()
        texts = [p.decode() for p in new if p and p not in special]
        plain = list(map(LatinEncoder.PLAIN.fullmatch, texts))
        return [
            (self._ask_pieces, [t for t, m in zip(texts, plain, strict=True) if m]),
            (self._ask, [t for t, m in zip(texts, plain, strict=True) if not m]),
            (lambda some: list(map(self._one, some)), [p.decode() for p in special]),
        ]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin, with the end of all."""
        if not self.latin:
            ids = [self._one(t.decode()) for t in texts]
            return np.frombuffer(b"".join(ids), self.dtype), np.cumsum([0, *map(len, ids)]) // self.dtype.itemsize
        pieces, starts = latin_pieces(texts, self.specials)
        names = names_of(pieces)
        ids = list(map(self.pieces.get, names))
        if None in ids:
            learnt = self._learn(list({p for p, x in zip(names, ids, strict=True) if x is None}))
            ids = [learnt[p] if x is None else x for p, x in zip(names, ids, strict=True)]
        tokens, ends = gathered(pieces.indices.to_numpy(), ids, self.dtype)
        return tokens, np.concatenate([[0], ends])[starts]


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def encode_codes(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and data bytes of each document; ``counts`` ranks a document, which starts a new control byte."""
    slots = -(-counts // 4) * 4
    ends = np.cumsum(counts)
    at = np.arange(len(ranks)) + np.repeat(np.cumsum(slots) - slots - (ends - counts), counts)
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(int(slots.sum()), np.uint8)
    codes[at] = more
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= more[:, None]
    total = np.concatenate([[0], np.cumsum(more.astype(np.int64) + 1)])
    return control, ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep], total[ends] - total[ends - counts]


def decode_codes(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks that ``encode_codes`` wrote."""
    slots = -(-counts // 4) * 4
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(slots) - slots - (np.cumsum(counts) - counts), counts)
    sizes = LENGTHS[control].reshape(-1)[at].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    ranks = padded[first].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(sizes > k)
        if len(wide):
            ranks[wide] |= padded[first[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_block(start: int, rows: list[list]) -> pa.RecordBatch:
    """A block of rows (doc_id, n_tokens, control, data) as a record batch of one row."""
    ids, counts, control, data = zip(*rows, strict=True)
    control, data = b"".join(control), b"".join(data)
    lists = np.array([[NONE if i is None else i for i in ids], counts], "<i8").tobytes()
    block = HEADER.pack(MAGIC, start, len(rows), len(control), len(data)) + lists + control + data
    return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])


def read_blocks(content: memoryview) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, doc_ids, counts, ranks) of each block of a file."""
    at = 0
    while at < len(content):
        magic, start, docs, n_control, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEADER.size
        ids, counts = (np.frombuffer(content, "<i8", docs, at + 8 * docs * k) for k in (0, 1))
        at += 16 * docs
        control, data = np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control)
        at += n_control + n_data + 1
        yield start, ids, counts, decode_codes(control, data, counts)


def write(docs: DataFrame, vocabulary: str, end_id: int | None = None, file_bytes: int | None = None, block_tokens: int = 1 << 20) -> str:
    """Encode ``docs`` (doc_id, text) into files in the shared folder; return the folder.

    file_bytes: about so many code bytes make a file; by default a share of the corpus within ``FILE_BYTES``.
    end_id: appended to each document.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(vocabulary)
        total = np.zeros(max(enc.size, (end_id or 0) + 1), np.int64)
        names, digest = ["doc_id", "n_tokens", "spread", "ids", "counts"], xxhash.xxh64_intdigest
        for b in batches:
            at = 0
            for some in slices(texts_of(b.column(1)), TEXT_BYTES):
                ids, begins = enc.encode(some)
                if end_id is not None:
                    ids = np.insert(ids, begins[1:], end_id)
                    begins = begins + np.arange(len(begins))
                total += np.bincount(ids, minlength=len(total))
                column = packed(ids, begins[1:])
                spread = pa.array([digest(x.as_buffer()) >> 33 for x in column], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(np.diff(begins)), spread, column, pa.nulls(len(some), pa.binary())], names)
                at += len(some)
        # one row a task, of as many figures as the vocabulary has ids
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())), pa.array([total.tobytes()])], names)

    kind = "doc_id long, n_tokens long, spread int, ids binary, counts binary"
    encoded = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(encode), kind), "tokens")
    tokens = encoded.filter("n_tokens is not null").drop("counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for row in b.column(0).to_pylist():
                own = np.frombuffer(row, np.int64)
                total = own + (total if len(total) else 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    # one row for each id of the vocabulary at most, however large the corpus
    counted = encoded.filter("counts is not null").select("counts").mapInArrow(released(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(((-r["n"], r["id"]) for r in counted))
    by_rank = np.array([i for _, i in order], np.int64)
    n_bytes = -sum(n for n, _ in order) * 3 // 2
    path = new_path(spark, "token-files")
    ranks = spark.createDataFrame([(bytearray(by_rank.astype("<u4").tobytes()),)], "block binary")
    ranks.coalesce(1).select(F.col("block").cast("string")).write.option("lineSep", "\n").text(f"{path}/ranks")
    size = file_bytes or min(max(n_bytes // FILES, FILE_BYTES[0]), FILE_BYTES[1])
    bounds = _bounds(tokens, max(1, -(-n_bytes // size)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = library_encoder(vocabulary).dtype
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                counts = some.column(1).to_numpy()
                control, data, sizes = encode_codes(rank_of[flat(some.column(3), dtype)], counts)
                cols = [
                    pa.array(_part(some.column(0), some.column(2), bounds)),
                    *some.columns[:3],
                    packed(control, np.cumsum(-(-counts // 4))),
                    packed(data, np.cumsum(sizes)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "n_tokens", "spread", "control", "data"])

    coded = tokens.mapInArrow(released(code), "part int, doc_id long, n_tokens long, spread int, control binary, data binary")
    totals = _starts(tokens, bounds)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, start, part = [], 0, 0, None
        for b in batches:
            for p, *row in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if rows and (p != part or held >= block_tokens):
                    yield pack_block(start, rows)
                    start, rows, held = start + held, [], 0
                if p != part:
                    start, part = totals[p], p
                rows.append(row)
                held += row[1]
        if rows:
            yield pack_block(start, rows)

    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "spread", "data", "control")
    blocks = dealt.drop("spread").mapInArrow(released(block), "block binary")
    blocks.select(F.col("block").cast("string")).write.option("lineSep", "\n").text(f"{path}/blocks")
    return path


def _part(doc_ids: pa.Array, spread: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The file of each document; null ids come first. A bound that is there several times is an id of several files."""
    ids = doc_ids.fill_null(NONE).to_numpy()
    first, last = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return (first + ((last - first) * spread.to_numpy().astype(np.int64) >> 31)).astype(np.int32)


def _bounds(tokens: DataFrame, files: int) -> np.ndarray:
    """About ``files`` - 1 ascending cuts of the doc_ids into equal parts: in two steps, so that no list of figures is long."""
    ids = tokens.select(F.coalesce("doc_id", F.lit(NONE)).alias("id"))
    steps = max(1, round(files**0.5)) if files > CUTS else files
    cut = lambda k: F.percentile_approx("id", [i / k for i in range(1, k)], 10 * CUTS).alias("c")
    if steps < 2:
        return np.zeros(0, np.int64)
    coarse = np.sort(np.array(ids.select(cut(steps)).first()["c"] or [], np.int64))
    if steps == files or not len(coarse):
        return coarse

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(coarse, b.column(0).to_numpy(), "left"))], ["id", "step"])

    fine = ids.mapInArrow(released(place), "id long, step long").groupBy("step").agg(cut(-(-files // steps))).collect()  # a figure a file
    # an id of several coarse cuts has all its rows in one step, which is that much larger
    times = {i: int((coarse == c).sum()) for i, c in enumerate(coarse.tolist())}
    return np.sort(np.concatenate([coarse, *(np.repeat(np.array(r["c"], np.int64), times.get(r["step"], 1)) for r in fine)]))


def _starts(tokens: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """The number of tokens before each file: one figure a file."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            np.add.at(total, _part(b.column(0), b.column(2), bounds), b.column(1).to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["part", "n"])

    rows = tokens.select("doc_id", "n_tokens", "spread").mapInArrow(released(add), "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(bounds) + 1, np.int64)
    for r in rows:
        n[r["part"]] = r["n"]
    return dict(enumerate((np.cumsum(n) - n).tolist()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files in ``path``; ids are little-endian 32-bit integers."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ranks").select("content").first()
    by_rank = np.frombuffer(bytes(content["content"])[:-1], "<u4") if content else np.zeros(0, "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0):
                for start, doc_ids, counts, ranks in read_blocks(memoryview(file.as_buffer())):
                    ends = np.cumsum(counts)
                    cols = [pa.array(doc_ids, pa.int64(), mask=doc_ids == NONE), pa.array(start + ends - counts), pa.array(counts, pa.int64()), packed(by_rank[ranks], ends)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    return files.mapInArrow(released(decode), "doc_id long, start long, n_tokens long, ids binary")


def checksums(read_back: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``read``."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

