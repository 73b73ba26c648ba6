"""Media columns: Matroska files as packet tables.

``parse`` reads a Matroska file from bytes: variable-length EBML elements (of
known and unknown size), tracks, clusters, simple blocks and block groups with
no, Xiph, EBML or fixed-size lacing, and cues.  ``mux`` writes a file of 8-bit
PCM packets.  ``packets`` turns a binary column into a table with one row per
packet: track, timestamp, key flag, lace index and byte range.

Rows are independent, so a file is worked on where it was read: no shuffle, and
memory for the largest batch of files only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pondera.llm import textkit

# Element IDs of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
MUXING_APP, WRITING_APP, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x4D80, 0x5741, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: What ends an element of unknown size: only these two kinds may have one.
_ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}}
#: Sampling rates that features are computed for.
_RATES = (1.0, 1e9)


class MatroskaError(ValueError):
    """The bytes are not a Matroska file that can be read."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    key: bool
    lace: int
    offset: int
    size: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _vint(b: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are ones (an unknown size)."""
    if at >= end or not b[at]:
        raise MatroskaError(f"bad variable-length integer at byte {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise MatroskaError(f"truncated integer at byte {at}")
    v = int.from_bytes(b[at : at + n], "big")
    ones = (1 << 7 * n) - 1
    return (v if keep_marker else v & ones), at + n, v & ones == ones


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, start of data, end of data)`` of the elements in a range."""
    while at < end:
        kind, start, last = _element_at(b, at, end)
        yield kind, start, last
        at = last


def _element_at(b: bytes, at: int, end: int) -> tuple[int, int, int]:
    kind, p, _ = _vint(b, at, end, True)
    size, p, unknown = _vint(b, p, end, False)
    if not unknown:
        if p + size > end:
            raise MatroskaError(f"element at byte {at} ends after its parent")
        return kind, p, p + size
    if kind not in _ENDS:
        raise MatroskaError(f"element at byte {at} must have a size")
    q = p
    while q < end and _vint(b, q, end, True)[0] not in _ENDS[kind]:
        q = _element_at(b, q, end)[2]  # a segment's clusters may have no size either
    return kind, p, q


def _uint(b: bytes, s: int, e: int) -> int:
    if e - s > 8:
        raise MatroskaError(f"integer of {e - s} bytes at byte {s}")
    return int.from_bytes(b[s:e], "big")


def _float(b: bytes, s: int, e: int) -> float:
    if e == s:
        return 0.0
    if e - s not in (4, 8):
        raise MatroskaError("a float must have 0, 4 or 8 bytes")
    return struct.unpack(">f" if e - s == 4 else ">d", b[s:e])[0]


def _block(b: bytes, s: int, e: int, base: int, key: bool | None, media: Media) -> None:
    track, p, _ = _vint(b, s, e, False)
    if p + 3 > e:
        raise MatroskaError(f"truncated block at byte {s}")
    rel, flags = struct.unpack(">hB", b[p : p + 3])
    p += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing:
        if p >= e:
            raise MatroskaError(f"truncated lacing at byte {s}")
        n, p = b[p] + 1, p + 1
        if lacing == 2:
            if (e - p) % n:
                raise MatroskaError(f"fixed-size lacing doesn't divide the block at byte {s}")
            sizes = [(e - p) // n] * n
        else:
            for i in range(n - 1):
                if lacing == 1:
                    v = 0
                    while True:
                        if p >= e:
                            raise MatroskaError(f"truncated lacing at byte {s}")
                        v, p = v + b[p], p + 1
                        if b[p - 1] != 255:
                            break
                else:
                    q = p
                    v, p, _ = _vint(b, p, e, False)
                    if i:
                        v += sizes[-1] - ((1 << 7 * (p - q) - 1) - 1)
                sizes.append(v)
            sizes.append(e - p - sum(sizes))
            if min(sizes) < 0:
                raise MatroskaError(f"laced sizes exceed the block at byte {s}")
    else:
        sizes = [e - p]
    step = media.tracks.get(track, {}).get("default_duration", 0)
    at = (base + rel) * media.scale
    if max(abs(at), abs(at + len(sizes) * step)) >= 1 << 63:
        raise MatroskaError(f"timestamp out of range at byte {s}")
    simple = key is None
    for i, n in enumerate(sizes):
        media.packets.append(Packet(track, at + i * step, bool(flags & 0x80) if simple else bool(key), i, p, n))
        p += n


def parse(b: bytes) -> Media:
    """Tracks, packets, clusters and cues of a file; raises ``MatroskaError`` on bad bytes.

    Files that were joined are read one after another: a new header or segment ends
    one whose size isn't known.
    """
    media, seen = Media(), False
    for kind, s, e in elements(b, 0, len(b)):
        if kind == EBML:
            media.doc_type = next((b[x:y].decode("ascii", "replace").rstrip("\0") for k, x, y in elements(b, s, e) if k == DOC_TYPE), "")
        elif kind == SEGMENT:
            seen, media.scale = True, 1_000_000
            for k, x, y in elements(b, s, e):
                if k == INFO:
                    for i, u, v in elements(b, x, y):
                        if i == TIMESTAMP_SCALE:
                            media.scale = _uint(b, u, v)
                        elif i == DURATION:
                            media.duration = _float(b, u, v)
                elif k == TRACKS:
                    _tracks(b, x, y, media)
                elif k == CLUSTER:
                    _cluster(b, x, y, s, media)
                elif k == CUES:
                    _cues(b, x, y, media)
    if not seen:
        raise MatroskaError("no segment")
    return media


def _tracks(b: bytes, s: int, e: int, media: Media) -> None:
    for k, x, y in elements(b, s, e):
        if k != TRACK_ENTRY:
            continue
        t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "default_duration": 0}
        for i, u, v in elements(b, x, y):
            if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[i]] = _uint(b, u, v)
            elif i == CODEC_ID:
                t["codec"] = b[u:v].decode("ascii", "replace")
            elif i == AUDIO:
                for j, m, n in elements(b, u, v):
                    if j == SAMPLING_FREQUENCY:
                        t["rate"] = _float(b, m, n)
                    elif j in (CHANNELS, BIT_DEPTH):
                        t["channels" if j == CHANNELS else "bits"] = _uint(b, m, n)
        media.tracks[t["number"]] = t


def _cluster(b: bytes, s: int, e: int, segment: int, media: Media) -> None:
    base = 0
    for k, x, y in elements(b, s, e):
        if k == CLUSTER_TIMESTAMP:
            base = _uint(b, x, y)
            media.clusters.append((base, s - segment))
        elif k == SIMPLE_BLOCK:
            _block(b, x, y, base, None, media)
        elif k == BLOCK_GROUP:
            inner = list(elements(b, x, y))
            key = all(i != REFERENCE_BLOCK for i, _, _ in inner)
            for i, u, v in inner:
                if i == BLOCK:
                    _block(b, u, v, base, key, media)


def _cues(b: bytes, s: int, e: int, media: Media) -> None:
    for k, x, y in elements(b, s, e):
        if k != CUE_POINT:
            continue
        time = track = at = 0
        for i, u, v in elements(b, x, y):
            if i == CUE_TIME:
                time = _uint(b, u, v)
            elif i == CUE_TRACK_POSITIONS:
                for j, m, n in elements(b, u, v):
                    if j == CUE_TRACK:
                        track = _uint(b, m, n)
                    elif j == CUE_CLUSTER_POSITION:
                        at = _uint(b, m, n)
        media.cues.append((time, track, at))


def _size(n: int) -> bytes:
    for k in range(1, 9):
        if n < (1 << 7 * k) - 1:
            return (n | 1 << 7 * k).to_bytes(k, "big")
    raise MatroskaError("element too large")


def _element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and the data of a block: none for one frame, fixed-size for equal ones, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 2, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytearray([len(frames) - 1]) + _size(sizes[0])
    for a, c in zip(sizes, sizes[1:-1], strict=False):
        d = c - a
        k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
        head += (d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return 3, bytes(head) + b"".join(frames)


_HEAD = _element(EBML, _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(EBML_MAX_ID, 4) + _number(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))


def mux(payload: bytes, *, frame: int = 256, lace: int = 8, blocks: int = 16, rate: int = 8000) -> bytes:
    """A file with the payload as one track of unsigned 8-bit mono PCM.

    Frames of ``frame`` samples (a whole number of milliseconds), up to ``lace`` in
    a block, up to ``blocks`` in a cluster, and a cue for each cluster.
    """
    if not payload or frame * 1000 % rate or frame * lace * blocks * 1000 // rate > 32767:
        raise ValueError("a payload and whole milliseconds in 16 bits are needed")
    ms = 1000 / rate
    info = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * ms)) + _element(MUXING_APP, b"pondera") + _element(WRITING_APP, b"pondera"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio
    body = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues = len(body[0]) + len(body[1]), b""
    for c in range(0, len(payload), frame * lace * blocks):
        start = int(c * ms)
        parts = [_number(CLUSTER_TIMESTAMP, start)]
        for p in range(c, min(c + frame * lace * blocks, len(payload)), frame * lace):
            part = payload[p : p + frame * lace]
            flag, data = _laced([part[i : i + frame] for i in range(0, len(part), frame)])
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", int(p * ms) - start, 0x80 | flag << 1) + data))
        cluster = _element(CLUSTER, b"".join(parts))
        cues += _element(CUE_POINT, _number(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at)))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, cues))
    return _HEAD + _element(SEGMENT, b"".join(body))


def pad(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def samples(b: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(b[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def describe(media: Media, payload: bytes) -> str:
    """Container counts and signal features of what was read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    last = max(media.packets, key=lambda p: p.timestamp_ns, default=None)
    rate = media.tracks.get(last.track, {}).get("rate", 0.0) if last and payload else 0.0
    if not _RATES[0] <= rate <= _RATES[1]:  # NaN is in no range
        raise MatroskaError("no payload, track or sampling rate to describe")
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={last.timestamp_ns // 1_000_000 + int(last.size * 1000 // rate)};mean={int(x.sum() * 1000 // len(x))};power={int((x * x).sum() // len(x))};crossings={crossings}"


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as a Matroska file: ``doc_id, n_bytes, media`` (binary).

    A null text is empty; an empty one is stored as its padding.  Ids are of any type
    and may be null.  Repeated rows are stored each, equal texts as equal files.  A
    text is held whole, about four times its bytes.  Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textkit.slices(batch, "text"):
                part = batch.slice(i, j - i)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    textkit.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of each stored file's payload.

    A null or damaged file has nulls and its error as feature.  Repeated rows are
    read each; an empty table gives an empty one.  Other columns are ignored.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for n, b in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "media")), strict=True):
                b = b or b""
                try:
                    media = parse(b)
                    data = samples(b, media)
                    found = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), describe(media, data))
                except MatroskaError as e:
                    found = (None, None, None, f"error: {e}")
                rows.append((n, *found[:3], len(b), hashlib.sha256(b).hexdigest(), found[3]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True))], names)

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def packets(files: DataFrame, *, key: str, media: str) -> DataFrame:
    """The packet table of a binary column: ``key``, track, codec, timestamp_ns, is_key, lace, byte_offset, byte_size, error.

    A null or unreadable file has one row with its error and nulls.  Repeated
    rows give repeated packets; an empty table gives an empty one.
    """
    kind = files.schema[key].dataType.simpleString()
    cast = files.select(files[key].cast("string").alias("k"), files[media].alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.string()), ("track", pa.int64()), ("codec", pa.string()), ("timestamp_ns", pa.int64()), ("is_key", pa.bool_()), ("lace", pa.int32()), ("byte_offset", pa.int64()), ("byte_size", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got = parse(b or b"")
                    rows = [(k, p.track, got.tracks.get(p.track, {}).get("codec"), p.timestamp_ns, p.key, p.lace, p.offset, p.size, None) for p in got.packets]
                except MatroskaError as e:
                    rows = [(k, *[None] * 7, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = cast.mapInArrow(run, "k string, track bigint, codec string, timestamp_ns bigint, is_key boolean, lace int, byte_offset bigint, byte_size bigint, error string")
    return out.withColumn(key, out["k"].cast(kind)).select(key, *out.columns[1:])
