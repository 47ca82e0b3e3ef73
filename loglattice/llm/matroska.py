"""Media columns: a Matroska writer and parser, packet tables, and features read back from stored media.

The parser walks variable-length EBML elements (known and unknown sizes), clusters, SimpleBlocks and BlockGroups with
all four lacings, and cues, and gives every frame's track, timestamp and byte range.  The writer stores 8-bit samples
losslessly as laced PCM blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._store import stored

# Matroska element ids (fixed values of the format, RFC 8794 and RFC 9559)
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = frozenset((SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACES))

SAMPLE_RATE = 8_000
FRAME = 512  # samples of a frame: 64 ms
FRAMES = 8  # frames laced into a block
CLUSTER_BYTES = 32_768  # about 4 s, well inside a block's 16-bit relative timestamp
UNIT = 64


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(kind: int, value: int) -> bytes:
    return _element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _uint(VERSION, 1) + _uint(READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_TRACK = _element(
    TRACKS,
    _element(
        ENTRY,
        _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)),
    ),
)


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """(lacing flags, block body): none, fixed-size where all are equal, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    head += _size(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        step, width = now - before, 1
        while abs(step) >= 1 << 7 * width - 1:
            width += 1
        head += (step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return 0x06, head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one PCM track of unsigned 8-bit samples."""
    duration = len(payload) * 1000 / SAMPLE_RATE
    body = [_element(INFO, _uint(SCALE, 1_000_000) + _element(MUXER, b"loglattice") + _element(WRITER, b"loglattice") + _element(DURATION, struct.pack(">d", duration))), _TRACK]
    at, cues = sum(map(len, body)), []
    for begin in range(0, len(payload), CLUSTER_BYTES):
        part, time = payload[begin : begin + CLUSTER_BYTES], begin * 1000 // SAMPLE_RATE
        blocks = [_uint(TIMESTAMP, time)]
        for offset in range(0, len(part), FRAME * FRAMES):
            chunk = part[offset : offset + FRAME * FRAMES]
            flags, data = _laced([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)])
            blocks.append(_element(SIMPLE, b"\x81" + struct.pack(">hB", offset * 1000 // SAMPLE_RATE, 0x80 | flags) + data))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE, _uint(CUE_TIME, time) + _element(CUE_PLACES, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, bytes read); -1 for the unknown size.  keep: with the length marker, as ids are."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width


def elements(data: bytes, at: int = 0, end: int | None = None):
    """(id, place of the element, start of its body, end of its body) in file order, into all parents."""
    end = len(data) if end is None else end
    while at < end:
        place = at
        kind, width = _vint(data, at, keep=True)
        at += width
        size, width = _vint(data, at)
        at += width
        stop = end if size < 0 else at + size
        if stop > len(data):
            raise ValueError(f"element {kind:#x} at byte {place} is cut off")
        yield kind, place, at, stop
        at = at if kind in _PARENTS else stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block's body."""
    track, width = _vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at + width)
    at += width + 3
    kind = flags & 0x06
    if not kind:
        return track, time, flags, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 0x02:  # Xiph
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 0x06:  # EBML
        for i in range(count - 1):
            value, width = _vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            at += width
    else:
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    out.append((at, end - at))
    if any(size < 0 for _, size in out):
        raise ValueError("a laced block's sizes exceed it")
    return track, time, flags, out


def parse(data: bytes) -> dict:
    """{'packets': (track, timestamp ns, start, size, keyframe, lacing, cluster) ..., 'cues': (ns, track, cluster) ...,
    'tracks': {number: {codec, rate, channels, depth}}, 'scale': ns}; raises ValueError on damaged input."""
    packets, cues, tracks, clusters = [], [], {}, []
    scale, segment, cluster_time, cluster, track, cue = 1_000_000, 0, 0, 0, {}, [0, 0]
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for kind, place, a, b in elements(data):
            if kind == EBML:
                if not place and all(k != DOC_TYPE or data[x:y] in (b"matroska", b"webm") for k, _, x, y in elements(data, a, b)):
                    continue
                raise ValueError("not Matroska")
            elif kind == SEGMENT:
                segment = a
            elif kind == SCALE:
                scale = number(a, b)
            elif kind == ENTRY:
                track = {"codec": "", "rate": 8000.0, "channels": 1, "depth": 0}
            elif kind == NUMBER:
                tracks[number(a, b)] = track
            elif kind == CODEC:
                track["codec"] = data[a:b].decode("ascii", "replace")
            elif kind == RATE:
                track["rate"] = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
            elif kind in (CHANNELS, DEPTH):
                track["channels" if kind == CHANNELS else "depth"] = number(a, b)
            elif kind == CLUSTER:
                cluster, cluster_time = place - segment, 0
                clusters.append(cluster)
            elif kind == TIMESTAMP:
                cluster_time = number(a, b)
            elif kind in (SIMPLE, BLOCK):
                own, time, flags, ranges = _frames(data, a, b)
                for start, size in ranges:
                    packets.append((own, (cluster_time + time) * scale, start, size, bool(flags & 0x80), flags >> 1 & 3, cluster))
            elif kind == CUE_TIME:
                cue[0] = number(a, b)
            elif kind == CUE_TRACK:
                cue[1] = number(a, b)
            elif kind == CUE_CLUSTER:
                cues.append((cue[0] * scale, cue[1], number(a, b)))
    except (IndexError, struct.error) as e:
        raise ValueError("damaged Matroska data") from e
    return {"packets": packets, "cues": cues, "tracks": tracks, "scale": scale, "clusters": clusters}


def packets(table: DataFrame, key: str, media: str) -> DataFrame:
    """Packet table of a media column: key, packet, track, timestamp_ns, start, size, keyframe, lacing, cluster, error.

    One row a frame; null and empty media give none; media that is no Matroska gives one row with its error and nulls.
    """

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(10)]
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data:
                    continue
                try:
                    found = [(k, i, *p, None) for i, p in enumerate(parse(data)["packets"])]
                except ValueError as e:
                    found = [(k, *[None] * 8, str(e))]
                for row in found:
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, *(pa.int64(),) * 5, pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [key, "packet", "track", "timestamp_ns", "start", "size", "keyframe", "lacing", "cluster", "error"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, media).mapInArrow(run, f"`{key}` {kind}, packet long, track long, timestamp_ns long, start long, size long, keyframe boolean, lacing long, cluster long, error string")


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a Matroska file."""

    def run(batches):
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for at in range(0, len(raw), 512):
                part = raw[at : at + 512]
                media = [mux(t + bytes(-len(t) % UNIT if t else UNIT)) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def _feature(samples: np.ndarray, found: dict) -> str:
    """Levels of the samples, and the shape of the packet table."""
    times = [p[1] for p in found["packets"]]
    level = samples.astype(np.int64) - 128
    cross = int((np.signbit(level[1:]) != np.signbit(level[:-1])).sum())
    spread = np.bincount(samples >> 4, minlength=16)
    indexed = sum(c in set(found["clusters"]) for _, _, c in found["cues"])
    return f"packets={len(times)};clusters={len(found['clusters'])};cues={indexed};last_ms={times[-1] // 1_000_000 if times else 0};sum={int(level.sum())};energy={int((level * level).sum())};crossings={cross};levels={'.'.join(map(str, spread.tolist()))}"


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored media(key, n_bytes, media), all from the bytes read back through the packet table."""

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                found = parse(data)
                payload = b"".join(data[p[2] : p[2] + p[3]] for p in found["packets"])
                for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), _feature(np.frombuffer(payload, np.uint8), found)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], [key, "n_bytes", *names])

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame) -> DataFrame:
    """Store each document's text as media and describe it from the stored bytes.

    docs(doc_id, text, ...): a null or empty text is 64 zero bytes; texts of any length are stored whole; repeated rows
    give a row each and equal texts equal values; a null doc_id is kept; other columns are ignored; an empty table gives
    no rows.  Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    return media_features(stored(with_media(docs), "media"))
