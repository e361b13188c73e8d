"""BPE encoding and decoding for vocabularies in the tokenizers library's JSON form.

Encoding is the backtracking form of byte-pair merging: an Aho-Corasick automaton over the reversed
vocabulary gives the longest token at each place of a word; tokens are taken greedily, a neighbour
pair is checked against a pair-compatibility table (would merging ever have joined across it?), and
the encoder steps back to a shorter token or an earlier place when none fits. Each place is left
for good at most once, so time is linear in the word. Decoding gathers token strings from one
buffer by an offset table.

Words of a document are encoded once per worker and kept in a bounded cache, which changes nothing
but time: texts are cut at ASCII white space, which no normalisation or token of these
vocabularies crosses.

Defined results: a null text is an empty one and gives no ids; repeated rows give repeated rows; an
empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import released

#: Entries that a worker's caches hold at most (about 200 bytes each).
CACHE = 1 << 17
#: Bytes of text that are split at a time; so small that what a worker holds for them stays in tens of megabytes.
SLICE_BYTES = 1 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Which neighbouring tokens merging would leave apart. Ids must follow the order of the merges."""

    def __init__(self, joins: dict[tuple[int, int], int], halves: dict[int, tuple[int, int]]):
        self.joins, self.halves = joins, halves
        self.known: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            found = self.apart(left, right, None)
            if len(self.known) < CACHE // 4:
                self.known[key] = found
        return found

    def apart(self, left: int, right: int, before: int | None) -> bool:
        """Undo merges on both sides of the border, latest first; no join of what then meets may come earlier.

        before: only joins with a smaller id than this count.
        """
        joins, halves = self.joins, self.halves
        while True:
            joined = joins.get((left, right))
            if joined is not None and (before is None or joined < before):
                return False
            can_left, can_right = left in halves, right in halves
            if can_left and (left > right or not can_right):
                before, left = left, halves[left][1]
            elif can_right:
                # a join with the same id as the right token is the same kind of pair further left, and goes first
                before, right = right + 1, halves[right][0]
            else:
                return True


class Encoder:
    """One vocabulary: ``encode(text bytes) -> ids`` as little-endian integers of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder"):
            raise ValueError("only vocabularies whose tokens are joined by spaces can be decoded here")
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        pieces = [(strings.get(i, "") + " ").encode() for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        if list(halves) != sorted(halves) or len(halves) != len(merges):
            raise ValueError("token ids do not follow the order of the merges")
        self.table = PairTable({h: i for i, h in halves.items()}, halves)
        back = {c: b for b, c in byte_chars().items()}
        self.back = back
        symbols: dict[int, str] = {}
        for s, i in vocab.items():
            if i in self.specials.values():
                continue
            ends = bool(self.suffix) and s.endswith(self.suffix)
            body = s[: -len(self.suffix)] if ends else s
            if body and all(c in back for c in body):
                codes = [back[c] for c in body]
                symbols[i] = "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * ends)
        formed = set()
        for i in sorted(symbols):  # a merged token counts only if merging its own string gives it
            if i not in halves or all(h in formed for h in halves[i]) and self.table.apart(*halves[i], i):
                formed.add(i)
        by_string = {s: i for i, s in symbols.items() if i in formed}
        self.lengths = {i: len(s) for s, i in by_string.items()}
        self.shorter = {i: next((by_string[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_string), None) for s, i in by_string.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in by_string.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        split = "|".join(re.escape(s) for s in self.specials)
        self.special_pattern = re.compile(f"({split})") if split else None
        self.special_bytes = [s.encode() for s in self.specials]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, given as its bytes."""
        s = piece.decode("latin-1")
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + 256)
        n, lengths, shorter, fits = len(s), self.lengths, self.shorter, self.table.fits
        longest: list = [None] * n
        for end, token in self.automaton.iter(s[::-1]):
            at = n - 1 - end
            if longest[at] is None or lengths[token] > lengths[longest[at]]:
                longest[at] = token
        if n == lengths.get(longest[0]):
            return [longest[0]]
        dead, out, at, token = set(), [], 0, longest[0]
        while at < n:
            while token is not None:
                end = at + lengths[token]
                if end not in dead and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                continue
            out.append(token)
            at = end
            token = longest[at] if at < n else None
        return out

    def pre_tokens(self, word: str) -> list[bytes]:
        """The library's own normaliser and pre-tokeniser on a part without special tokens."""
        text = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        back = self.back
        return [bytes(back[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p]

    def word(self, word: bytes) -> bytes:
        """The ids of a stretch without ASCII white space."""
        text = word.decode()
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        out = []
        for part in parts:
            if part in self.specials:
                out.append(np.array([self.specials[part]], self.dtype).tobytes())
                continue
            for piece in self.pre_tokens(part) if part else ():
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = np.array(self.merge(piece), self.dtype).tobytes()
                    if len(self.pieces) < CACHE // 8:
                        self.pieces[piece] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        known = self.words
        got = list(map(known.get, words := text.split()))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    w = words[i]
                    ids = got[i] = known.get(w) or self.word(w)
                    if len(known) < CACHE:
                        known[w] = ids
        return b"".join(got)

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin, with the end of all."""
        ids = list(map(self.encode, texts))
        return np.frombuffer(b"".join(ids), self.dtype), np.cumsum([0, *map(len, ids)]) // self.dtype.itemsize

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all ids, a space after each, as one buffer, and where each ends in it."""
        starts, sizes = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[np.arange(len(shift)) + shift], ends


#: Byte classes: white space, letter, digit, other printable ASCII, and bytes of words that go to the library whole.
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
_CLASS = np.full(256, WHOLE, np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = DIGIT, SPACE
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Letters after an apostrophe that make a piece with it: one letter, and the second of two.
_SHORT, _LONG = np.frombuffer(b"stmd", np.uint8), {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


def latin_pieces(texts: list[bytes], specials: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut into pre-tokens, each with the white space before it, as one array, and the first piece of each text.

    ASCII letters are lower-cased. A stretch without white space that holds a special token or anything else than
    ASCII and Latin-1 letters, which composition leaves as they are, stays one piece and as it is.
    """
    joined = b"".join(texts)
    starts = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts) + 1, np.int64)
    kind, low = _CLASS[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    cut = first.copy()
    cut[1:-1] |= (kind[:-1] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    whole = np.flatnonzero(kind == WHOLE)
    if any(x in joined for x in specials):
        whole = np.concatenate([whole, *(np.array([m.start() for m in re.finditer(re.escape(x), joined)], np.int64) for x in specials)])
    kept = None
    if len(whole):
        inside = kind != SPACE
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:-1]
        word = np.cumsum(opens)
        flagged = np.zeros(int(word[-1]) + 1, bool)
        flagged[word[whole]] = True
        kept = flagged[word] & inside
        cut[:-1][kept & ~opens] = False
        low[kept] = data[kept]
    mark = np.flatnonzero(data[:-1] == 0x27)
    mark = mark[((kind[mark - 1] != OTHER) | first[mark]) & ~first[mark + 1]]
    if kept is not None:
        mark = mark[~kept[mark]]
    if len(mark):
        one = np.isin(low[mark + 1], _SHORT)
        after = low[np.minimum(mark + 2, len(low) - 1)]
        two = np.zeros(len(mark), bool)
        for x, y in _LONG.items():
            two |= (low[mark + 1] == x) & (after == y)
        two &= (mark + 2 < len(data)) & ~first[mark + 2]
        cut[mark[one | two] + 1] = False
        cut[mark[one] + 2] = True
        cut[mark[two] + 3] = True
    offsets = np.flatnonzero(cut)
    offsets[-1] = len(data)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low)])
    return pieces.dictionary_encode(), np.searchsorted(offsets, starts)


def names_of(pieces: pa.DictionaryArray) -> list[bytes]:
    """The distinct pieces without their white space."""
    own = pieces.dictionary
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].tolist() if len(own) else [0]
    raw = own.buffers()[2].to_pybytes() if len(own) else b""
    return [raw[a:b].strip() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def gathered(codes: np.ndarray, ids: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and where each piece ends."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
    flat, begins = np.frombuffer(b"".join(ids), dtype), np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[codes] - (ends - n), n)], ends


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive stretches of ``values`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def flat(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """The values of all rows of a binary column one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype) if len(column) else np.zeros(0, dtype)


class LatinEncoder(Encoder):
    """For vocabularies that lower-case and split at letters, digits and the rest (``word_bpe_49k``).

    Words of ASCII and Latin-1 letters, which composition leaves as they are, are split here; all
    others go through the library's normaliser.
    """

    PLAIN = re.compile("[\\x21-\\x7eÀ-ÖØ-öø-ÿ]+")

    def piece(self, piece: bytes) -> bytes:
        """The ids of a piece of ``latin_pieces`` without its white space."""
        text = piece.decode()
        if not self.PLAIN.fullmatch(text) or any(x in text for x in self.specials):
            return self.word(piece)
        return np.array(self.merge(text.lower().encode()), self.dtype).tobytes()

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces, starts = latin_pieces(texts, self.special_bytes)
        known, ids = self.words, []
        for p in names_of(pieces):
            x = known.get(p)
            if x is None:
                x = self.piece(p) if p else b""
                if len(known) < CACHE:
                    known[p] = x
            ids.append(x)
        tokens, ends = gathered(pieces.indices.to_numpy(), ids, self.dtype)
        return tokens, np.concatenate([[0], ends])[starts]


#: The splitting pattern that LatinEncoder stands for.
LATIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_latin(path: str) -> bool:
    """Whether a vocabulary normalises and splits as ``LatinEncoder`` does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and LATIN_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return (LatinEncoder if splits_latin(path) else Encoder)(path)


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Texts of about ``most`` bytes together."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    yield some


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of all texts; ids are little-endian integers of the vocabulary's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            at = 0
            for some in slices(texts_of(b.column(1))):
                ids, begins = enc.encode_all(some)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(np.diff(begins)), packed(ids, begins[1:])], [key, "n_tokens", "ids"])
                at += len(some)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(run), f"{key} {kind}, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, decoded_chars) of all texts, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            at = 0
            for some in slices(texts_of(b.column(1))):
                ids, begins = enc.encode_all(some)
                text, ends = enc.decode_all(ids)
                wide, ends = memoryview(ids.astype("<u4").view(np.uint8)), np.concatenate([[0], ends])[begins]
                letters, text = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)]), memoryview(text)
                rows = []
                for x, y, a, z in zip((4 * begins[:-1]).tolist(), (4 * begins[1:]).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    z = max(a, z - 1)
                    rows.append((hashlib.sha256(wide[x:y]).hexdigest(), hashlib.sha256(text[a:z]).hexdigest(), int(letters[z] - letters[a])))
                cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array(np.diff(begins)), *arrays], [key, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"]
                )
                at += len(some)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(run), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
