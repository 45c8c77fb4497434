"""Media columns in ISO base media containers: a writer of sample tracks and a box walker.

``mux`` stores a payload as fixed-size 8-bit PCM samples in chunks of an ISO container; ``probe``
walks the nested boxes, decodes the sample tables and reports codec, duration and the byte ranges
of the key frames without looking into the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, record_batches, rows

SAMPLE = 576
CHUNK_SAMPLES = 16
KEY_EVERY = 8
TIMESCALE = 8000
CODEC = b"raw "
_CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"moof", b"traf", b"mvex", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box; bodies of 4 GB and more get the 64-bit size form."""
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def pad(text: str | None) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of the sample size; null is empty."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // SAMPLE)) * SAMPLE - len(raw))


def mux(payload: bytes) -> bytes:
    """An ISO container that holds the payload, a positive multiple of SAMPLE bytes, unchanged."""
    n = len(payload) // SAMPLE
    if not n or n * SAMPLE != len(payload):
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    duration, chunks = n * SAMPLE, -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    runs += [(chunks, last, 1)] if last != CHUNK_SAMPLES or chunks == 1 else []
    keys = range(1, n + 1, KEY_EVERY)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    entry = box(CODEC, b"\0" * 6, struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(first: int) -> bytes:
        offsets = [first + k * CHUNK_SAMPLES * SAMPLE for k in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        table = full(b"co64" if wide else b"stco", 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, SAMPLE)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, struct.pack(">II", SAMPLE, n)),
            full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), struct.pack(">I4sI", 12, b"url ", 1)))
        minf = box(b"minf", full(b"smhd", 0, b"\0" * 4), dinf, stbl)
        mdhd = full(b"mdhd", 1, struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0))
        hdlr = full(b"hdlr", 0, b"\0" * 4, b"soun", b"\0" * 12, b"samples\0")
        tkhd = full(b"tkhd", 1, struct.pack(">QQIIQQHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0x100, 0), _MATRIX, b"\0" * 8)
        mvhd = full(b"mvhd", 1, struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    first = len(ftyp) + size + head
    if len(moov(first)) != size:  # offsets beyond 4 GB widen the table
        first += len(moov(first)) - size
    return ftyp + moov(first) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    ticks: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keys: list[int] | None = None

    def key_ranges(self) -> list[tuple[int, int]]:
        """(first byte, bytes) of each key frame; without a sync table every sample is one."""
        which = range(len(self.sizes)) if self.keys is None else (k - 1 for k in self.keys)
        return [(self.offsets[k], self.sizes[k]) for k in which]


def walk(data: bytes | memoryview, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first body byte, end) of every box, depth first; raises ValueError on a bad size."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise ValueError(f"a box is cut off at byte {lo}")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if hi - lo < 16:
                raise ValueError(f"a box is cut off at byte {lo}")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            raise ValueError(f"box {kind!r} at byte {lo} has a size of {size}")
        yield (*path, kind), body, end
        if kind in _CONTAINERS:
            yield from walk(data, body, end, (*path, kind))
        lo = end


def _compact(data: bytes | memoryview, at: int, bits: int, n: int) -> list[int]:
    """n sample sizes of 4, 8 or 16 bits; of two in a byte the upper is first."""
    if bits == 4:
        return [b >> shift & 15 for b in data[at : at + (n + 1) // 2] for shift in (4, 0)][:n]
    if bits not in (8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", data, at))


def probe(data: bytes) -> list[Track]:
    """The tracks of a container, from its boxes and sample tables alone.

    Raises ValueError for movie fragments, whose samples no table of the movie box names.
    """
    tracks: list[Track] = []
    tables: dict[bytes, object] = {}

    def close() -> None:
        if tracks and tables:
            _place(tracks[-1], tables)
            tables.clear()

    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            raise ValueError(f"a movie fragment at byte {at - 8}")
        if kind == b"trak":
            close()
            tracks.append(Track())
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr":
            t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", data, at + 4)
            flat = struct.unpack_from(f">{2 * n}I", data, at + 8)
            t.ticks = sum(count * delta for count, delta in zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, at + 4)
            tables[b"stsz"] = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind == b"stz2":
            bits, n = struct.unpack_from(">xxxBI", data, at + 4)
            tables[b"stsz"] = _compact(data, at + 12, bits, n)
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", data, at + 4)
            t.keys = list(struct.unpack_from(f">{n}I", data, at + 8))
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, at + 4)
            tables[b"stco"] = list(struct.unpack_from(f">{n}{'Q' if kind == b'co64' else 'I'}", data, at + 8))
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", data, at + 4)
            flat = struct.unpack_from(f">{3 * n}I", data, at + 8)
            tables[kind] = list(zip(flat[::3], flat[1::3], strict=True))
    close()
    return tracks


def _place(track: Track, tables: dict) -> None:
    """Sample sizes and file offsets from the size, chunk and sample-to-chunk tables."""
    track.sizes = tables.get(b"stsz", [])
    chunks, runs = tables.get(b"stco", []), tables.get(b"stsc", [])
    k = 0
    for i, (first, per) in enumerate(runs):
        stop = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for chunk in range(first, stop):
            at = chunks[chunk - 1]
            for _ in range(per):
                if k == len(track.sizes):
                    return
                track.offsets.append(at)
                at += track.sizes[k]
                k += 1
    if k != len(track.sizes):
        raise ValueError(f"the chunks place {k} of {len(track.sizes)} samples")


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order, joining neighbours before they are copied."""
    pieces: list[tuple[int, int]] = []
    for at, n in zip(track.offsets, track.sizes, strict=True):
        if pieces and sum(pieces[-1]) == at:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + n)
        else:
            pieces.append((at, n))
    return b"".join(data[at : at + n] for at, n in pieces)


def feature(track: Track) -> str:
    """codec, handler, duration from the time-to-sample table and the key frames' number, first range and checksum of all."""
    ranges = track.key_ranges()
    packed = struct.pack(f">{2 * len(ranges)}Q", *(v for r in ranges for v in r))
    first = f"{ranges[0][0]}+{ranges[0][1]}" if ranges else "-"
    return f"codec={track.codec.strip()};handler={track.handler};duration={track.ticks}/{track.timescale};samples={len(track.sizes)};keys={len(ranges)};first={first};ranges={zlib.crc32(packed):08x}"


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text stored losslessly in a container of its own.

    Null and empty texts give one sample of bytes 255; repeated rows and equal texts give equal
    media; other columns are ignored.  Containers go on in batches of about 8 MB, a longer one
    alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = ((d, len((t or "").encode()), mux(pad(t))) for d, t in rows(batches, "doc_id", "text", at_once=64))
        yield from record_batches(source, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """``media_table`` of docs, written to the shared folder and read back."""
    return materialize(media_table(docs), "media")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``media_table`` give, read from the containers alone.

    codec and duration (seconds) come from the sample tables, and key_ranges has the first byte and
    the number of bytes of every key frame in the container; payload, checksums and feature are
    digests.
    """
    kinds = {
        "doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
        "media_bytes": "long", "media_sha256": "string", "feature": "string", "codec": "string", "duration": "double",
        "key_ranges": "array<struct<first: long, bytes: long>>",
    }
    ranges_type = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, arrow.get(k, ranges_type)) for n, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def features() -> Iterator[tuple]:
            for doc_id, n_bytes, data in rows(batches, "doc_id", "n_bytes", "media", at_once=64):
                track = probe(data)[0]
                payload = payload_of(data, track)
                yield (
                    doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec.strip(), track.ticks / track.timescale,
                    [{"first": a, "bytes": n} for a, n in track.key_ranges()],
                )

        yield from record_batches(features(), schema)

    return media.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
