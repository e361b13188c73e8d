"""Keys that several rows have, found by packed messages.

Each row (an id) has any number of 64-bit keys. Keys are dealt by their first bits; a task sends each other
task one message for a chunk of its rows: the following 32 bits of every key and a short number for its id.
Repeats inside a chunk are counted there and sent once, so a key that most rows have is no large group anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import released

#: Bytes of input whose keys are gathered before they are sent, and keys that a task gets on average.
CHUNK, KEYS = 1 << 25, 1 << 19
#: Tasks that keys are dealt to, at most 2 ** MOST_BITS.
MOST_BITS = 17


def bits_for(keys: int, least: int) -> int:
    """The bits of a key that number its task: in proportion to all keys, ``least`` tasks or more."""
    return min(max(1, (max(least, keys // KEYS) - 1).bit_length()), MOST_BITS)


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of a key that is compared: that of its task and 32 bits more."""
    return keys >> np.uint64(32 - bits)


def _messages(ids: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows to send for a chunk's (id, key) pairs: keys of several of its ids answered
    at once and sent on with their count, all keys by task."""
    shift = 64 - bits
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    ids, keys = ids[fresh], keys[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([start, [len(keys)]]))
    many = np.repeat(count > 1, count)
    numbers, place = np.unique(ids[start], return_inverse=True)
    place = np.where(count > 1, len(numbers), place).astype(np.uint32)
    bucket = (keys[start] >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    low = (short(keys[start], bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = place[a:b]
        used, back = np.unique(own[own < len(numbers)], return_inverse=True)
        slot = np.full(b - a, len(used), np.uint32)
        slot[own < len(numbers)] = back
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        yield {
            "bucket": int(bucket[a]),
            "key": low[a:b].tobytes(),
            "slot": slot.astype(kind).tobytes(),
            "ids": zlib.compress(np.diff(numbers[used], prepend=0).tobytes(), 1),
            "counts": count[a:b][own == len(numbers)].astype(np.uint32).tobytes(),
        }
    keys, ids = keys[many], ids[many]
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield {"bucket": int(bucket[a]), "key": keys[a:b].tobytes(), "ids": zlib.compress(ids[a:b].tobytes(), 1)}


def shared_keys(rows: DataFrame, extract: Callable, bits: int, many: int = 1 << 62) -> DataFrame:
    """(id, key, hot) of the keys that several ids have; hot: more than ``many``.

    extract: turns the record batches of ``rows`` into tuples (ids, keys, bytes read), an id beside each key.
    The keys of the result are ``short``.
    """
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("slot", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, size = [], [], 0
        for own, key, read in extract(batches):
            ids.append(own)
            keys.append(key)
            size += read
            if size >= CHUNK:
                if sum(map(len, keys)):
                    yield pa.RecordBatch.from_pylist(list(_messages(np.concatenate(ids), np.concatenate(keys), bits)), schema)
                ids, keys, size = [], [], 0
        if sum(map(len, keys)):
            yield pa.RecordBatch.from_pylist(list(_messages(np.concatenate(ids), np.concatenate(keys), bits)), schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, counts, told = [], [], [], []
        for b in batches:
            for bucket, key, slot, packed, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if slot is None:  # repeats inside one chunk
                    told.append((short(np.frombuffer(key, np.uint64), bits), np.frombuffer(zlib.decompress(packed), np.int64)))
                    continue
                low = np.frombuffer(key, np.uint32).astype(np.uint64)
                numbers = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))
                slots = np.frombuffer(slot, np.uint16 if len(slot) == 2 * len(low) else np.uint32)
                n = np.ones(len(low), np.int64)
                n[slots == len(numbers)] = np.frombuffer(count, np.uint32)
                keys.append(low | np.uint64(bucket << 32))
                ids.append(np.concatenate([numbers, [0]])[slots])
                counts.append(n)
        if not keys:
            return
        keys_, ids_, counts_ = np.concatenate(keys), np.concatenate(ids), np.concatenate(counts)
        keys.clear(), ids.clear(), counts.clear()
        order = np.argsort(keys_, kind="stable")
        keys_, ids_, counts_ = keys_[order], ids_[order], counts_[order]
        start = np.flatnonzero(np.concatenate([[True], keys_[1:] != keys_[:-1]]))
        size = np.diff(np.concatenate([start, [len(order)]]))
        n_ids = np.add.reduceat(counts_, start)
        known, per_row = keys_[start], np.repeat(n_ids, size)
        pick = (counts_ == 1) & (per_row > 1)
        out = [(ids_[pick], keys_[pick], per_row[pick] > many)]
        for k, d in told:
            out.append((d, k, n_ids[np.searchsorted(known, k)] > many))
        for d, k, h in out:
            for a in range(0, len(d), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(k[s].view(np.int64)), pa.array(h[s])], ["id", "key", "hot"])

    sent = rows.mapInArrow(released(send), "bucket int, key binary, slot binary, ids binary, counts binary")
    return sent.repartitionById(1 << bits, F.col("bucket")).mapInArrow(released(meet), "id long, key long, hot boolean")
