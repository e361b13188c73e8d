"""Media columns: Matroska files written to and read from a binary column.

``mux`` stores a payload as 8-bit mono PCM frames in a Matroska file: EBML header, segment, one
audio track, clusters of laced simple blocks, and cues. ``packets`` parses any file of that
container: variable-length element ids and sizes, unknown sizes, the timestamp scale, the tracks' frame
durations, clusters, simple blocks and block groups with durations, the four kinds of lacing (none, Xiph,
fixed, EBML) and cues, giving one packet a frame with its track, timestamp in nanoseconds and byte range. A laced
frame follows the one before by its share of the block's duration, else by the track's frame duration, else at
the same time. Features come from the packet table and the bytes it points to.

Defined results: a null text is an empty payload, padded like any other; equal texts give equal
files; repeated rows stay; an empty table gives none; other columns are ignored. A file that breaks
the format raises ``ValueError`` with the place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import released

# Fixed values of the container format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK, DEFAULT_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB, 0x23E383
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose content is elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = range(4)

#: A frame's bytes (an 8-bit sample each), samples a second, frames in a laced block, blocks in a cluster.
FRAME, RATE, LACED, BLOCKS = 576, 8000, 4, 32
FRAME_MS = FRAME * 1000 // RATE
#: Nanoseconds of a tick where a file does not say.
TICK = 1_000_000


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    end: int
    key: bool


def size_bytes(n: int, width: int = 0) -> bytes:
    """An element size: one to eight bytes, of which the first set bit tells the width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(
    EBML,
    uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
)
_SETUP = element(INFO, uint(TIMESTAMP_SCALE, TICK) + element(MUXING_APP, b"factloom") + element(WRITING_APP, b"factloom")) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, FRAME_MS * TICK) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def lace(frames: list[bytes], kind: int) -> bytes:
    """The content of a block after its flags."""
    if kind == NO_LACING:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file of ``payload``, whose length is a multiple of ``FRAME``."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues, per = [_SETUP], [], LACED * BLOCKS
    at = len(_SETUP)
    for first in range(0, len(frames), per):
        time, blocks = first * FRAME_MS, []
        for k in range(first, min(first + per, len(frames)), LACED):
            some = frames[k : k + LACED]
            kind = FIXED_LACING if len(some) > 1 else NO_LACING
            head = size_bytes(1) + struct.pack(">hB", k * FRAME_MS - time, 0x80 | kind << 1)
            blocks.append(element(SIMPLE_BLOCK, head + lace(some, kind)))
        cluster = element(CLUSTER, uint(TIMESTAMP, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, place after it, whether all its bits are set) of a variable-length integer."""
    first = data[at] if at < len(data) else 0
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    mask = (1 << 7 * width) - 1
    return (value if keep else value & mask), at + width, value & mask == mask


def elements(data: bytes, start: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, content start, content end) of the elements in a byte range; one of unknown size ends
    where its parent's next sibling begins."""
    at = start
    while at < end:
        kind, body, _ = _vint(data, at, keep=True)
        size, body, unknown = _vint(data, body)
        stop = end if unknown else body + size
        if unknown and kind == CLUSTER:
            place = body
            while place < end:
                k, b, _ = _vint(data, place, keep=True)
                if k in (CLUSTER, CUES, TRACKS, INFO):
                    break
                n, b, _ = _vint(data, b)
                place = b + n
            stop = place
        if stop > end:
            raise ValueError(f"element {kind:x} at {at} passes its parent's end")
        yield kind, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block."""
    if kind == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED_LACING:
        size = (end - at) // n
        if size * n != end - at:
            raise ValueError(f"fixed lacing does not divide the block at {at}")
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH_LACING:
            size, more = 0, True
            while more:
                if at >= end:
                    raise ValueError(f"a lacing size runs past the block's end at {at}")
                size, more, at = size + data[at], data[at] == 255, at + 1
        else:
            value, after, _ = _vint(data, at)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing passes the block's end at {at}")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def _setup(data: bytes, parts: list[tuple[int, int, int]]) -> tuple[int, dict[int, int]]:
    """The nanoseconds of a tick, and those of a frame of each track that tells them."""
    tick, frames = TICK, {}
    for part, a, b in parts:
        if part == INFO:
            tick = next((_uint(data, x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP_SCALE), TICK)
        elif part == TRACKS:
            for entry, c, d in elements(data, a, b):
                if entry == TRACK_ENTRY:
                    own = {k: (x, y) for k, x, y in elements(data, c, d)}
                    if TRACK_NUMBER in own and DEFAULT_DURATION in own:
                        frames[_uint(data, *own[TRACK_NUMBER])] = _uint(data, *own[DEFAULT_DURATION])
    return tick, frames


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """The packet table and the cues (time in nanoseconds, track, place of the cluster in the file) of a file."""
    found: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    for kind, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        parts = list(elements(data, a, b))
        tick, frame_of = _setup(data, parts)
        for part, c, d in parts:
            if part == CLUSTER:
                time = 0
                for k, e, f in elements(data, c, d):
                    duration, inside, key = None, [(k, e, f)] if k == SIMPLE_BLOCK else [], False
                    if k == TIMESTAMP:
                        time = _uint(data, e, f)
                    elif k == BLOCK_GROUP:
                        group = list(elements(data, e, f))
                        inside = [g for g in group if g[0] == BLOCK]
                        duration = next((tick * _uint(data, x, y) for g, x, y in group if g == BLOCK_DURATION), None)
                        # a block of a group depends on no other frame where it refers to none
                        key = all(g != REFERENCE_BLOCK for g, *_ in group)
                    for block, x, y in inside:
                        track, x, _ = _vint(data, x)
                        offset, flags = struct.unpack_from(">hB", data, x)
                        ranges = _frames(data, x + 3, y, flags >> 1 & 3)
                        step = frame_of.get(track, 0) if duration is None else duration // len(ranges)
                        for i, (s, t) in enumerate(ranges):
                            found.append(Packet(track, tick * (time + offset) + i * step, s, t, bool(flags & 0x80) if block == SIMPLE_BLOCK else key))
            elif part == CUES:
                for point, e, f in elements(data, c, d):
                    if point == CUE_POINT:
                        inner = list(elements(data, e, f))
                        time = next((_uint(data, x, y) for k, x, y in inner if k == CUE_TIME), 0)
                        for k, x, y in inner:
                            if k == CUE_TRACK_POSITIONS:
                                at = {z: _uint(data, v, w) for z, v, w in elements(data, x, y)}
                                cues.append((tick * time, at.get(CUE_TRACK, 0), a + at.get(CUE_CLUSTER_POSITION, 0)))
    return found, cues


def pad(text: bytes) -> bytes:
    """The payload of a text: bytes 255 up to a positive multiple of ``FRAME``."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def mux_column(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media) of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                media = pa.array([mux(pad(t)) for t in texts], pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), media], [key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(run), f"{key} {kind}, n_bytes long, media binary")


def features(media: bytes) -> tuple[bytes, str]:
    """The stored bytes of track 1 and a line of features of its packets and samples."""
    table, cues = packets(media)
    raw = b"".join([media[p.start : p.end] for p in table if p.track == 1])
    samples = np.frombuffer(raw, np.uint8)
    # a cue is good if a cluster begins at its place
    good = sum(media[place : place + 4] == CLUSTER.to_bytes(4, "big") for _, _, place in cues)
    level, cross = 0, 0
    if len(samples):
        level = int(samples.astype(np.int64).sum()) // len(samples)
        cross = int(np.count_nonzero(np.diff(samples >= 128)))
    last = max((p.timestamp for p in table), default=0)
    end = last // TICK + FRAME_MS if table else 0
    return raw, f"packets={len(table)};cues={len(cues)}/{good};ms={end};mean={level};crossings={cross};key={sum(p.key for p in table)}"


def read_column(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the files of ``mux_column`` back: digests of payload and file, and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                raw, feature = features(m)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(
        released(run),
        f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
