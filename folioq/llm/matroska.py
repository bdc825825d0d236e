"""Matroska: a parser from bytes to packet tables, and a muxer for 8-bit PCM to go with it."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

# Element ids of EBML and Matroska.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}

#: The muxer's shape: samples a second, samples a frame (64 ms), frames a laced block, blocks a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 32
ALIGN = 64


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A variable-length integer; all ones in the value bits are reserved, hence the - 1."""
    width = width or next(w for w in range(1, 9) if x < (1 << 7 * w) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def _uint(ident: int, x: int) -> bytes:
    return element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def _block(track: int, relative: int, frames: list[bytes], lacing: str) -> bytes:
    flags = {"none": 0, "xiph": 0x02, "fixed": 0x04, "ebml": 0x06}[lacing] | 0x80
    head = vint(track) + struct.pack(">hB", relative, flags)
    sizes = [len(f) for f in frames]
    if lacing == "none":
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml" and len(frames) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def mux_pcm(samples: bytes) -> bytes:
    """One track of 8-bit mono PCM. Whole blocks use fixed-size lacing; the last block uses EBML or Xiph lacing by turns of its
    number of frames, or none for a single frame."""
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    duration = len(samples) * 1000 / RATE
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", duration)) + element(MUXING_APP, b"folioq") + element(WRITING_APP, b"folioq"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio
    parts, cues = [info, element(TRACKS, element(TRACK_ENTRY, entry))], []
    at = sum(map(len, parts))
    step = FRAME * LACED
    for c in range(0, len(samples), step * BLOCKS):
        base = c * 1000 // RATE
        blocks = [_uint(TIMESTAMP, base)]
        for b in range(c, min(c + step * BLOCKS, len(samples)), step):
            frames = [samples[i : i + FRAME] for i in range(b, min(b + step, len(samples)), FRAME)]
            even = len(frames) > 1 and len(frames[-1]) == FRAME
            lacing = "fixed" if even else "none" if len(frames) == 1 else "ebml" if len(frames) % 2 else "xiph"
            blocks.append(element(SIMPLE_BLOCK, _block(1, b * 1000 // RATE - base, frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: track, timestamp in ns, first byte, size, key frame, lacing, frame's place in its block
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    clusters: int = 0
    #: time in ns, track, the cluster's first byte in the file
    cues: list[tuple[int, int, int]] = field(default_factory=list)


class Damaged(ValueError):
    """The bytes are not what an element's head says."""


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, the place after it, and whether all value bits are ones (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of the body, byte after it). An element of unknown size ends before the next one that can't be inside it."""
    while at < end:
        ident, body, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, body)
        if unknown:
            stop = end
            if ident == CLUSTER:
                stop = next((p for p, i in _heads(data, body, end) if i in TOP_LEVEL), end)
        elif (stop := body + size) > end:
            raise Damaged(f"element {ident:X} at byte {at} ends after its parent")
        yield ident, body, stop
        at = stop


def _heads(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < end:
        ident, body, _ = read_vint(data, at, keep_marker=True)
        yield at, ident
        size, body, _ = read_vint(data, body)
        at = body + size


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, bool, str, list[tuple[int, int]]]:
    """A block's track, relative timestamp, key flag, lacing, and its frames' (first byte, size)."""
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise Damaged(f"block cut off at byte {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    sizes: list[int] = []
    if lacing != "none":
        count, at = data[at] + 1, at + 1
        if lacing == "fixed":
            if (end - at) % count:
                raise Damaged("fixed lacing does not divide the block")
            sizes = [(end - at) // count] * (count - 1)
        elif lacing == "xiph":
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        elif count > 1:
            size, at, _ = read_vint(data, at)
            sizes.append(size)
            for _ in range(count - 2):
                d, after, _ = read_vint(data, at)
                size += d - ((1 << 7 * (after - at) - 1) - 1)
                at = after
                sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Damaged(f"laced frames are longer than their block at byte {at}")
    out = []
    for n in [*sizes, last]:
        out.append((at, n))
        at += n
    return track, relative, bool(flags & 0x80), lacing, out


def parse(data: bytes) -> Media:
    """Tracks, packets with timestamps and byte ranges, and cues of a Matroska file; raises Damaged."""
    out = Media()
    for ident, a, b in children(data, 0, len(data)):
        if ident == EBML:
            for i, c, d in children(data, a, b):
                if i == DOC_TYPE:
                    out.doc_type = data[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif ident == SEGMENT:
            _segment(data, a, b, out)
    return out


def _segment(data: bytes, a: int, b: int, out: Media) -> None:
    for ident, c, d in children(data, a, b):
        if ident == INFO:
            for i, e, f in children(data, c, d):
                if i == TIMESTAMP_SCALE:
                    out.timestamp_scale = _number(data, e, f)
                elif i == DURATION:
                    out.duration = _real(data, e, f)
        elif ident == TRACKS:
            for i, e, f in children(data, c, d):
                if i == TRACK_ENTRY:
                    _track(data, e, f, out)
        elif ident == CLUSTER:
            _cluster(data, c, d, out)
        elif ident == CUES:
            for i, e, f in children(data, c, d):
                if i == CUE_POINT:
                    _cue(data, e, f, a, out)


def _track(data: bytes, a: int, b: int, out: Media) -> None:
    got: dict = {"default_duration": 0}
    for i, c, d in children(data, a, b):
        if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            got[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[i]] = _number(data, c, d)
        elif i == CODEC_ID:
            got["codec"] = data[c:d].decode("ascii", "replace")
        elif i == AUDIO:
            for j, e, f in children(data, c, d):
                if j == SAMPLING_FREQUENCY:
                    got["rate"] = _real(data, e, f)
                elif j in (CHANNELS, BIT_DEPTH):
                    got["channels" if j == CHANNELS else "bits"] = _number(data, e, f)
    out.tracks[got.get("number", 0)] = got


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    out.clusters += 1
    base = 0
    for i, c, d in children(data, a, b):
        if i == TIMESTAMP:
            base = _number(data, c, d)
        elif i == SIMPLE_BLOCK:
            _packets(data, c, d, base, out, None)
        elif i == BLOCK_GROUP:
            inside = list(children(data, c, d))
            key = all(j != 0xFB for j, _, _ in inside)  # without a reference to another block
            for j, e, f in inside:
                if j == BLOCK:
                    _packets(data, e, f, base, out, key)


def _packets(data: bytes, a: int, b: int, base: int, out: Media, key: bool | None) -> None:
    track, relative, flag, lacing, frames = frames_of(data, a, b)
    start = (base + relative) * out.timestamp_scale
    each = out.tracks.get(track, {}).get("default_duration", 0)
    for k, (at, n) in enumerate(frames):
        out.packets.append((track, start + k * each, at, n, flag if key is None else key, lacing, k))


def _cue(data: bytes, a: int, b: int, segment: int, out: Media) -> None:
    time, tracks = 0, []
    for i, c, d in children(data, a, b):
        if i == CUE_TIME:
            time = _number(data, c, d) * out.timestamp_scale
        elif i == CUE_TRACK_POSITIONS:
            got = {j: _number(data, e, f) for j, e, f in children(data, c, d) if j in (CUE_TRACK, CUE_CLUSTER_POSITION)}
            tracks.append((got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
    out.cues += [(time, t, p) for t, p in tracks]


def packet_table(media: DataFrame, *, data: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each packet: key, track, timestamp_ns, start, size, keyframe, lacing, part; and error.

    Media that is null gives no rows; media that is empty or has no clusters neither. Damaged media gives one row with
    its packets null and `error` set. Keys may be null or repeated; each row is parsed by itself.
    """
    schema = "key string, track long, timestamp_ns long, start long, size long, keyframe boolean, lacing string, part int, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1)):
                if not m.is_valid:
                    continue
                try:
                    rows = [(k, *p, None) for p in parse(m.as_py()).packets]
                except (Damaged, IndexError, struct.error) as e:
                    rows = [(k, *[None] * 7, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return media.select(named(key).cast("string").alias("key"), named(data).cast("binary").alias("data")).mapInArrow(run, schema)


def stored(text: str | None) -> tuple[bytes, int]:
    """The text's media file, and its length in bytes as UTF-8. Zeros fill the payload up to a positive multiple of 64."""
    raw = (text or "").encode()
    size = max(ALIGN, -(-len(raw) // ALIGN) * ALIGN)
    return mux_pcm(raw.ljust(size, b"\0")), len(raw)


def read_back(media: bytes) -> tuple[bytes, str]:
    """Payload and features of a stored text, from the packets that the parser finds in its bytes."""
    m = parse(media)
    payload = b"".join(media[a : a + n] for _, _, a, n, _, _, _ in m.packets)
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    laced = {k: sum(p[5] == k and p[6] == 0 for p in m.packets) for k in ("none", "xiph", "fixed", "ebml")}
    crossings = int(np.count_nonzero(np.diff(x * len(x) >= x.sum())))  # of the mean
    seek = sum(media[p : p + 4] == _id(CLUSTER) for _, _, p in m.cues)
    parts = {
        "tracks": len(m.tracks), "clusters": m.clusters, "packets": len(m.packets), "cues": seek, **{f"{k}_blocks": v for k, v in laced.items()},
        "last_ns": m.packets[-1][1] if m.packets else 0, "duration_ms": round(m.duration), "sum": int(x.sum()), "energy": int((x * x).sum()), "crossings": crossings,
    }
    return payload, ";".join(f"{k}={v}" for k, v in parts.items())


def text_media(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row.

    Each text is stored as a Matroska file of 8-bit samples, which is parsed again; payload columns come from what was read back.
    A null text counts as empty; an empty one is 64 zero samples. Ids may be null or repeated; equal texts give equal values. Long texts
    become many clusters. An empty table gives no rows; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(t: str | None) -> tuple:
        media, n = stored(t)
        payload, feature = read_back(media)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(one(t.as_py()) for t in b.column(1)))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    return src.mapInArrow(run, schema)
