"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of RFC 8794 and RFC 9559.
EBML = 0x1A45DFA3
SEGMENT = 0x18538067
SEEK_HEAD = 0x114D9B74
INFO = 0x1549A966
TRACKS = 0x1654AE6B
CLUSTER = 0x1F43B675
CUES = 0x1C53BB6B
CHAPTERS = 0x1043A770
ATTACHMENTS = 0x1941A469
TAGS = 0x1254C367
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
CODEC_ID = 0x86
DEFAULT_DURATION = 0x23E383
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER_TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
BLOCK_DURATION = 0x9B
REFERENCE_BLOCK = 0xFB
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1
DOC_TYPE = 0x4282

_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, ATTACHMENTS, TAGS}
LACING = ("none", "xiph", "fixed", "ebml")

RATE = 8000  # samples, one byte each, a second
FRAME = 512
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32


class MatroskaError(ValueError):
    """The bytes are not well-formed Matroska."""


# --- reading -----------------------------------------------------------------


def read_vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int]:
    """(value, next position); the value keeps its length marker if asked, and
    is -1 for the reserved all-ones size."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise MatroskaError(f"cut-off number at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not marker:
        mask = (1 << 7 * length) - 1
        value = -1 if value & mask == mask else value & mask
    return value, at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, data start, data end) of each element of known size."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, end, marker=True)
        size, at = read_vint(data, at, end)
        if size < 0 or at + size > end:
            raise MatroskaError(f"element {ident:#x} at byte {start} runs past its parent")
        yield ident, start, at, at + size
        at += size


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MatroskaError("a float has 0, 4 or 8 bytes")
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


@dataclass
class Media:
    """What a file holds: packets as tuples in the order of PACKET_FIELDS."""

    timestamp_scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (time, track, cluster position)
    clusters: list[int] = field(default_factory=list)  # positions in the segment


PACKET_FIELDS = ("cluster", "block", "packet", "track", "timestamp_ns", "byte_start", "byte_length", "keyframe", "lacing")


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of the frames, start of the first) of a block's payload."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a laced block without its frame count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise MatroskaError("fixed lacing with unequal frames")
        return [(end - at) // count] * count, at
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("cut-off Xiph lacing")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for i in range(count - 1):
            before = at
            value, at = read_vint(data, at, end)
            if i:
                value = int.from_bytes(data[before:at], "big") & ((1 << 7 * (at - before)) - 1)
                value = sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(value)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError("lacing runs past its block")
    return [*sizes, last], at


def _read_block(m: Media, data: bytes, a: int, b: int, time: int, number: int, simple: bool, key: bool) -> None:
    track, at = read_vint(data, a, b)
    if at + 3 > b:
        raise MatroskaError("cut-off block header")
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    step = m.tracks.get(track, {}).get("default_duration", 0)
    stamp = (time + offset) * m.timestamp_scale
    for i, size in enumerate(sizes):
        m.packets.append(
            (len(m.clusters) - 1, number, i, track, stamp + i * step, at, size, bool(flags & 0x80) if simple else key, LACING[lacing])
        )
        at += size


def _read_cluster(m: Media, data: bytes, at: int, end: int) -> int:
    """Reads up to ``end`` or, if that is unknown (-1), up to the next element
    that only a segment has; gives the position after the cluster."""
    limit = len(data) if end < 0 else end
    time, number = 0, 0
    while at < limit:
        element, body = read_vint(data, at, limit, marker=True)
        if end < 0 and element in _TOP:
            return at
        size, body = read_vint(data, body, limit)
        stop = body + size
        if size < 0 or stop > limit:
            raise MatroskaError(f"element {element:#x} at byte {at} runs past its cluster")
        if element == CLUSTER_TIMESTAMP:
            time = _uint(data, body, stop)
        elif element == SIMPLE_BLOCK:
            _read_block(m, data, body, stop, time, number, True, False)
            number += 1
        elif element == BLOCK_GROUP:
            block, key = None, True
            for inner, _, a, b in elements(data, body, stop):
                if inner == BLOCK:
                    block = (a, b)
                elif inner == REFERENCE_BLOCK:
                    key = False
            if block:
                _read_block(m, data, *block, time, number, False, key)
                number += 1
        at = stop
    return at


def _read_track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    number, out = 0, {}
    for e, _, x, y in elements(data, a, b):
        if e == TRACK_NUMBER:
            number = _uint(data, x, y)
        elif e == CODEC_ID:
            out["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif e == TRACK_TYPE:
            out["type"] = _uint(data, x, y)
        elif e == DEFAULT_DURATION:
            out["default_duration"] = _uint(data, x, y)
        elif e == AUDIO:
            for f, _, p, q in elements(data, x, y):
                if f == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, p, q)
                elif f == CHANNELS:
                    out["channels"] = _uint(data, p, q)
                elif f == BIT_DEPTH:
                    out["bits"] = _uint(data, p, q)
    return number, out


def read_media(data: bytes) -> Media:
    """Parses a whole file; raises MatroskaError where it is malformed."""
    m, at, end = Media(), 0, len(data)
    element, body = read_vint(data, at, end, marker=True)
    if element != EBML:
        raise MatroskaError("no EBML header")
    size, body = read_vint(data, body, end)
    at = body + max(size, 0)
    if at > end:
        raise MatroskaError("cut-off EBML header")
    while at < end:
        element, body = read_vint(data, at, end, marker=True)
        size, body = read_vint(data, body, end)
        stop = end if size < 0 else body + size
        if stop > end:
            raise MatroskaError(f"element {element:#x} at byte {at} is cut off")
        if element == SEGMENT:
            _read_segment(m, data, body, stop)
        at = stop
    return m


def _read_segment(m: Media, data: bytes, origin: int, end: int) -> None:
    at = origin
    while at < end:
        start = at
        element, body = read_vint(data, at, end, marker=True)
        size, body = read_vint(data, body, end)
        stop = body + size
        if size < 0 and element != CLUSTER or stop > end:
            raise MatroskaError(f"element {element:#x} at byte {start} runs past its segment")
        if element == CLUSTER:
            m.clusters.append(start - origin)
            at = _read_cluster(m, data, body, -1 if size < 0 else stop)
            continue
        if element == INFO:
            for e, _, a, b in elements(data, body, stop):
                if e == TIMESTAMP_SCALE:
                    m.timestamp_scale = _uint(data, a, b)
                elif e == DURATION:
                    m.duration = _float(data, a, b)
        elif element == TRACKS:
            for e, _, a, b in elements(data, body, stop):
                if e == TRACK_ENTRY:
                    number, track = _read_track(data, a, b)
                    m.tracks[number] = track
        elif element == CUES:
            for e, _, a, b in elements(data, body, stop):
                if e != CUE_POINT:
                    continue
                time = 0
                for f, _, x, y in elements(data, a, b):
                    if f == CUE_TIME:
                        time = _uint(data, x, y)
                    elif f == CUE_TRACK_POSITIONS:
                        got = {g: _uint(data, p, q) for g, _, p, q in elements(data, x, y)}
                        m.cues.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
        at = stop


# --- writing -----------------------------------------------------------------


def vint(value: int, length: int = 0) -> bytes:
    """A size as the shortest variable-length number (or one of ``length``)."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block_body(frames: Sequence[bytes], track: int, offset: int, flags: int = 0x80) -> bytes:
    """A block of several frames: fixed lacing if they are equally long, else
    EBML lacing; none for a single frame."""
    head = vint(track) + struct.pack(">h", offset)
    if len(frames) == 1:
        return head + bytes([flags]) + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return head + bytes([flags | 4, len(frames) - 1]) + b"".join(frames)
    lace = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
        lace += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + bytes([flags | 6, len(frames) - 1]) + lace + b"".join(frames)


_HEADER = element(
    EBML,
    uint(0x4286, 1), uint(0x42F7, 1), uint(0x42F2, 4), uint(0x42F3, 8),
    element(DOC_TYPE, b"matroska"), uint(0x4287, 4), uint(0x4285, 2),
)
_FRAME_NS = FRAME * 10**9 // RATE
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), element(CODEC_ID, b"A_PCM/INT/LIT"),
        uint(DEFAULT_DURATION, _FRAME_NS),
        element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), uint(CHANNELS, 1), uint(BIT_DEPTH, 8)),
    ),
)


def write_media(payload: bytes) -> bytes:
    """A Matroska file with the bytes as 8-bit mono samples: laced simple
    blocks in clusters, with a cue for each cluster."""
    ms = 1000 * FRAME // RATE
    info = element(
        INFO,
        uint(TIMESTAMP_SCALE, 1_000_000), element(0x4D80, b"ringfold"), element(0x5741, b"ringfold"),
        element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)),
    )
    parts = [info, _TRACKS]
    at, cues = sum(map(len, parts)), []
    per_block = FRAME * FRAMES_A_BLOCK
    per_cluster = per_block * BLOCKS_A_CLUSTER
    for c in range(0, len(payload), per_cluster):
        time = c // FRAME * ms
        blocks = []
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            block_end = min(b + per_block, c + per_cluster, len(payload))
            frames = [payload[f : min(f + FRAME, block_end)] for f in range(b, block_end, FRAME)]
            blocks.append(element(SIMPLE_BLOCK, block_body(frames, 1, (b - c) // FRAME * ms)))
        cluster = element(CLUSTER, uint(CLUSTER_TIMESTAMP, time), *blocks)
        cues.append(
            element(CUE_POINT, uint(CUE_TIME, time), element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER_POSITION, at)))
        )
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(element(CUES, *cues))
    return _HEADER + element(SEGMENT, *parts)


# --- columns -----------------------------------------------------------------


def text_payload(text: bytes) -> bytes:
    """The text's bytes, padded with zeros to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p[5] : p[5] + p[6]] for p in media.packets if p[3] == track)


#: Columns of the packet table after the packet's own.
_TABLE = (
    ("cluster", "long"), ("block", "long"), ("packet", "integer"), ("track", "long"), ("timestamp_ns", "long"), ("byte_start", "long"),
    ("byte_length", "long"), ("keyframe", "boolean"), ("lacing", "string"), ("cluster_position", "long"), ("cue_ns", "long"),
    ("track_type", "long"), ("codec", "string"), ("sample_rate", "double"), ("error", "string"),
)
_ARROW = {"long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def packets_of(media: Media) -> list[tuple]:
    """Rows of the packet table. A cue's time stands at the packet it leads to:
    the first of its track in its cluster that is not before it (of several
    cues, the first in time)."""
    cues: dict[tuple[int, int], list[int]] = {}
    for time, track, position in media.cues:
        cues.setdefault((track, position), []).append(time * media.timestamp_scale)
    for times in cues.values():
        times.sort(reverse=True)
    out = []
    for p in media.packets:
        position, track = media.clusters[p[0]], media.tracks.get(p[3], {})
        times, cue = cues.get((p[3], position), []), None
        while times and times[-1] <= p[4]:
            time = times.pop()
            cue = time if cue is None else cue
        out.append((*p, position, cue, track.get("type"), track.get("codec"), track.get("rate"), None))
    return out


def packet_table(df: DataFrame, media: str, ident: str) -> DataFrame:
    """One row per packet of each file in the binary column ``media``:
    (ident, cluster, block, packet, track, timestamp_ns, byte_start,
    byte_length, keyframe, lacing, cluster_position, cue_ns, track_type, codec,
    sample_rate, error).

    Byte ranges count from the file's start, cluster positions from its
    segment's; ``cue_ns`` is the time of the cue that leads to the packet, null
    for others. A null file has no rows; a malformed one has a single row with
    only its ``error``. Repeated and null idents are fine, and other columns
    are not read.
    """
    rows = df.select(F.col(ident).alias(ident), F.col(media).alias("__rf_media")).where("__rf_media is not null")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    got = packets_of(read_media(batch.column("__rf_media")[k].as_py()))
                except MatroskaError as e:
                    got = [(*[None] * (len(_TABLE) - 1), str(e))]
                for j in range(0, len(got), 8192):
                    part = got[j : j + 8192]
                    cols = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*part), _TABLE, strict=True)]
                    owner = batch.column(ident).take(pa.array([k] * len(part), pa.int32()))
                    yield pa.RecordBatch.from_arrays([owner, *cols], names=[ident, *[name for name, _ in _TABLE]])

    schema = rows.select(ident).schema
    for name, kind in _TABLE:
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def with_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): every whole text as a Matroska file; null counts as empty."""
    rows = docs.select(F.col(doc_id).alias(doc_id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__rf_text"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                files = [write_media(text_payload(t)) for t in part.column("__rf_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(files, pa.binary())], names=[doc_id, "media"])

    return rows.mapInArrow(run, rows.select(doc_id).schema.add("media", "binary"))


def _digest(text: bytes) -> tuple:
    stored = write_media(text_payload(text))
    media = read_media(stored)
    payload = payload_of(stored, media)
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    last = media.packets[-1]
    feature = (
        f"clusters={len(media.clusters)};blocks={len({p[:2] for p in media.packets})};packets={len(media.packets)};"
        f"cues={len(media.cues)};last_ms={last[4] // 10**6};peak={int(np.abs(samples).max())};"
        f"sum={int(samples.sum(dtype=np.int64))};crossings={crossings}"
    )
    return (
        len(text),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-64:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        feature,
    )


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text stored as a Matroska file and read back.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature); a null text counts as empty, which is stored as 64
    zeros. Equal texts give equal values; repeated and null ids are fine;
    other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias(doc_id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__rf_text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                column = part.column("__rf_text")
                got = [_digest(column[i].as_py()) for i in range(part.num_rows)]
                cols = [pa.array(c, t) for c, t in zip(zip(*got), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), *cols], names=[doc_id, *names])

    schema = rows.select(doc_id).schema
    for name, kind in zip(names, ("long", "long", "string", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
