"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

In a pre-token the last token of each prefix is the one token that ends there and fits behind the last token of the prefix
before it (``bpe.PairTable``); so one walk over the matches of an Aho-Corasick automaton of the vocabulary gives the count of
every prefix, in time linear in the pre-token. Counts of a text's prefixes are those sums over its pre-tokens, put right
where cutting the text changes how it splits: after a run of white space, inside a contraction, inside a special token.

A prefix has the count that the library gives it as a text of its own, so counts may fall where a longer prefix merges
better. ``prefix_counts`` stores them as two bytes a character above the least of each block; ``count_at`` and ``truncated``
answer questions about budgets from what is stored, without encoding again.

For vocabularies of byte-level BPE with the splitting rule of ``byte_bpe_50k.json`` and without normaliser; others are refused.

Defined results: a null text is an empty one, with no blocks and count 0; repeated rows give repeated rows; an empty table gives
none; columns beside the key are ignored. A text is worked on in windows, so a very long one takes two bytes a character and a window.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import PairTable, byte_chars, gathered, texts_of
from factloom.llm.common import released

#: Characters of a block; each adds at most four tokens, so counts of a block differ by less than 2 ** 16.
BLOCK = 1 << 13
#: Bytes of a window.
WINDOW = 1 << 20
#: Pre-tokens and pairs of tokens that a worker remembers at most; what it has forgotten it works out again.
PIECES, PAIRS = 1 << 18, 1 << 18
#: A place where a text may be cut into windows: white space after something else always begins a pre-token.
_SAFE = re.compile(b"[!-~](?=[ \n])")
#: Letters, numbers and white space of newer Unicode versions than Python's.
_ASSIGNED = regex.compile(r"[\p{L}\p{N}\s]")
#: Kinds of characters.
OTHER, LETTER, NUMBER, SPACE = range(4)


def kinds(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where, among all code points, each stretch of one kind begins, and its kind, as the vocabulary's library splits text."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    code = np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") or not 0xD800 <= c < 0xE000 and _ASSIGNED.match(chr(c))])
    kind = np.full(0x110000, OTHER, np.uint8)
    kind[code] = SPACE
    for value, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        for at in range(0, len(code), 1 << 11):
            some = code[at : at + (1 << 11)]
            cuts = {a for _, (a, _) in split.pre_tokenize_str("".join(f"{like}{chr(c)}\n" for c in some.tolist()))}
            kind[[c for i, c in enumerate(some.tolist()) if 3 * i + 1 not in cuts]] = value
        code = code[kind[code] == SPACE]
    begins = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    return begins, kind[begins]


class Counter:
    """One vocabulary: token counts of all prefixes of texts, one a code point."""

    def __init__(self, path: str, begins: np.ndarray, kind: np.ndarray):
        self.kind = np.repeat(kind, np.diff(np.append(begins, 0x110000)))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec["normalizer"] or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without normaliser are counted here")
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        if list(halves) != sorted(halves) or len(halves) != len(merges):
            raise ValueError("token ids do not follow the order of the merges")
        self.table = PairTable({h: i for i, h in halves.items()}, halves)
        self.specials = sorted((a["content"].encode() for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, self.specials))) if self.specials else None
        back = {c: chr(b) for b, c in byte_chars().items()}
        self.automaton, formed = ahocorasick.Automaton(), set()
        for token, i in sorted(vocab.items(), key=lambda x: x[1]):
            # a merged token counts only if merging its own string gives it
            if token and all(c in back for c in token) and (i not in halves or all(h in formed for h in halves[i]) and self.table.apart(*halves[i], i)):
                formed.add(i)
                self.automaton.add_word("".join(back[c] for c in token), (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        """The counts of all prefixes of a pre-token that end between characters, as 32-bit integers."""
        n, fits = len(piece), self.fits
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    key = last[start] << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        ok = self.table.apart(last[start], token, None)
                        if len(fits) < PAIRS:
                            fits[key] = ok
                    if not ok:
                        continue
                last[end] = token
                count[end] = count[start] + 1
        if -1 in last[1:]:
            raise ValueError("the vocabulary lacks a byte")
        if piece.isascii():
            return array("I", count[1:]).tobytes()
        return array("I", [c for c, b in zip(count[1:], [*piece[1:], 0], strict=True) if b & 0xC0 != 0x80]).tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        for p in pieces:
            x = known.get(p)
            if x is None:
                x = self.piece(p)
                if len(known) < PIECES and len(p) < 64:
                    known[p] = x
            out.append(x)
        return out

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of all texts one after another, and where each text's begin; special tokens are ordinary text here."""
        joined = b"".join(texts)
        code = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        n = len(code)
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        starts = np.searchsorted(at, np.cumsum([0, *map(len, texts)]))
        if not n:
            return np.zeros(0, np.int64), starts
        kind = self.kind[code]
        first = np.zeros(n + 1, bool)
        first[starts] = True
        cut = first.copy()
        cut[1:-1] |= kind[1:] != kind[:-1]
        # the last of a run of white space goes to what follows it, if anything does: a blank as its beginning, else alone
        space = np.append(kind == SPACE, True)
        ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
        cut[ends + 1] = code[ends] != 0x20
        runs = ends[~cut[ends]]
        cut[ends] = True
        # contractions: an apostrophe that no blank precedes, and one or two letters
        mark = np.flatnonzero((code == 0x27) & cut[:-1])
        padded = np.append(code, [0, 0])
        inside = np.append(first[1:], [True, True])  # whether a text ends after the character
        one = mark[np.isin(padded[mark + 1], [ord(c) for c in "sdmt"]) & ~inside[mark]]
        two = np.zeros(len(mark), bool)
        for a, b in ("ll", "ve", "re"):
            two |= (padded[mark + 1] == ord(a)) & (padded[mark + 2] == ord(b))
        two = mark[two & ~inside[mark] & ~inside[mark + 1]]
        cut[one + 1] = cut[two + 1] = False
        cut[one + 2] = cut[two + 3] = True
        begins = np.flatnonzero(cut[:-1])
        offsets = at[np.append(begins, n)]
        cuts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined)]).dictionary_encode()
        local, piece_ends = gathered(cuts.indices.to_numpy(), self.pieces(cuts.dictionary.to_pylist()), np.dtype("<u4"))
        whole = local[piece_ends - 1].astype(np.int64)
        before = np.cumsum(whole) - whole
        counts = local + np.repeat(before, np.diff(piece_ends, prepend=0))
        # a prefix that ends after a run of white space takes the run as one, and one inside a contraction has two tokens of it
        if len(runs):
            opens = np.flatnonzero(cut & np.append(True, ~space[:-1] | first[1:]))
            opens = opens[np.searchsorted(opens, runs, "right") - 1]
            whole_runs = [joined[a:b] for a, b in zip(at[opens].tolist(), at[runs + 1].tolist(), strict=True)]
            own = np.array([np.frombuffer(x, np.uint32)[-1] for x in self.pieces(whole_runs)], np.int64)
            counts[runs] = own + np.where(opens > 0, counts[opens - 1], 0)
        counts[two + 1] = counts[two] + 1
        # counts so far run through all texts; each begins anew
        total = np.concatenate([[0], counts])[starts]
        return counts - np.repeat(total[:-1], np.diff(starts)), starts

    def counts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Counts of all prefixes of each text, special tokens taken as the library takes them."""
        parts: list[bytes] = []
        shape: list[list[tuple[int, bool]]] = []
        for t in texts:
            at, own = 0, []
            for m in self.special.finditer(t) if self.special and any(s in t for s in self.specials) else ():
                # the special token but its last character stays ordinary text of what is before it
                parts.append(t[at : m.start()] + m[0].decode()[:-1].encode())
                own.append((len(m[0].decode()) - 1, True))
                at = m.end()
            parts.append(t[at:])
            shape.append([*own, (0, False)])
        flat, starts = self.plain(parts)
        out, k = [], 0
        for own in shape:
            held, base = [], 0
            for tail, special in own:
                got = flat[starts[k] : starts[k + 1]] + base
                k += 1
                held.append(got)
                if special:
                    base = (int(got[-tail - 1]) if len(got) > tail else base) + 1
                    held.append(np.array([base]))
            out.append(np.concatenate(held) if len(held) > 1 else held[0])
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, begins: np.ndarray, kind: np.ndarray) -> Counter:
    """One counter a worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, begins, kind)
    return _COUNTERS[path]


def windows(text: bytes, most: int = WINDOW) -> Iterator[bytes]:
    """Parts of a text whose counts add up."""
    at = 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class _Blocks:
    """The blocks of one text after another: the least count of each, and what every character has above it in two bytes."""

    def __init__(self):
        self.least, self.steps, self.sizes = [], [], []

    def add(self, parts: Iterator[np.ndarray]) -> None:
        total, held, n = 0, np.zeros(0, np.int64), 0
        for c in parts:
            held = np.concatenate([held, c + total])
            total = int(held[-1]) if len(held) else total
            full = len(held) // BLOCK * BLOCK
            n += self._cut(held[:full])
            # the last character stays, for the sum so far
            held = held[full:]
        n += self._cut(held)
        self.sizes.append(n)

    def _cut(self, counts: np.ndarray) -> int:
        for at in range(0, len(counts), BLOCK):
            part = counts[at : at + BLOCK]
            self.least.append(int(part.min()))
            self.steps.append((part - part.min()).astype(">u2").tobytes())
        return -(-len(counts) // BLOCK)

    def array(self) -> pa.Array:
        rows = pa.StructArray.from_arrays([pa.array(self.least, pa.int64()), pa.array(self.steps, pa.binary())], ["least", "steps"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *self.sizes]), pa.int32()), rows)


def prefix_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_chars, n_tokens, blocks) of each row: blocks hold the token count of every prefix that ends between characters.

    Character number i (from 0) is in block i / BLOCK, at two big-endian bytes; the count of the prefix that ends with it is
    that and the block's ``least``.
    """

    known = kinds(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary, *known)
        for b in batches:
            at, held, size = 0, [], 0
            texts = texts_of(b.column(1))
            for i, t in enumerate(texts):
                held.append(t)
                size += len(t)
                if size < WINDOW and i + 1 < len(texts):
                    continue
                blocks, totals, chars = _Blocks(), [], []

                def put(parts: Iterator[np.ndarray], blocks=blocks, totals=totals, chars=chars) -> None:
                    seen = [0, 0]

                    def noted() -> Iterator[np.ndarray]:
                        for c in parts:
                            seen[0] += int(c[-1]) if len(c) else 0
                            seen[1] += len(c)
                            yield c

                    blocks.add(noted())
                    totals.append(seen[0])
                    chars.append(seen[1])

                short = [x if len(x) <= WINDOW else b"" for x in held]
                for x, counts in zip(held, own.counts(short), strict=True):
                    put(iter([counts]) if len(x) <= WINDOW else (own.counts([w])[0] for w in windows(x)))
                lengths = pa.array([len(x) for x in held], pa.int64())
                columns = [b.column(0).slice(at, len(held)), lengths, pa.array(chars, pa.int64()), pa.array(totals, pa.int64()), blocks.array()]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_chars", "n_tokens", "blocks"])
                at, held, size = i + 1, [], 0

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, n_chars long, n_tokens long, blocks array<struct<least: long, steps: binary>>"
    return docs.select(key, "text").mapInArrow(released(run), schema)


def count_at(n_chars: Column) -> Column:
    """Of a row of ``prefix_counts``: the token count of the first ``n_chars`` characters; 0 for none, null beyond the text."""
    at = n_chars - 1
    block = F.get("blocks", F.floor(at / BLOCK).cast("int"))
    step = F.conv(F.hex(F.substring(block["steps"], (2 * (at % BLOCK) + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    return F.when(n_chars == 0, 0).when(n_chars > 0, block["least"] + step)


def truncated(counts: DataFrame, limits: list[int], key: str = "doc_id") -> DataFrame:
    """(key, limit, n_chars, n_tokens) of each row of ``prefix_counts``: the longest prefix of at most ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, blocks in enumerate(b.column(1)):
                least = np.array([x["least"].as_py() for x in blocks.values] if blocks.is_valid else [], np.int64)
                for limit in limits:
                    fits = np.flatnonzero(least <= limit)
                    chars = tokens = 0
                    if len(fits):
                        k = int(fits[-1])
                        have = np.frombuffer(blocks.values[k]["steps"].as_buffer(), ">u2") + least[k]
                        last = int(np.flatnonzero(have <= limit)[-1])
                        chars, tokens = k * BLOCK + last + 1, int(have[last])
                    rows.append((i, limit, chars, tokens))
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], [key, "limit", "n_chars", "n_tokens"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, "blocks").mapInArrow(released(run), f"{key} {kind}, limit long, n_chars long, n_tokens long")
