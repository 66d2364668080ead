"""Media columns: text bytes as 8-bit samples in ISO media containers, and features read from their boxes.

``to_container`` stores a payload as a 'raw ' track: ftyp, mdat, moov with nested boxes and sample tables (stts, stsc,
stsz, stco, stss). ``features`` walks the boxes and decodes those tables only, without decoding samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Bytes of a sample, samples of a chunk (the first of each chunk is a keyframe), samples a second.
UNIT, CHUNK, RATE = 64, 16, 125
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def to_container(payload: bytes) -> bytes:
    """An ISO media file of a payload whose size is a positive multiple of UNIT; equal payloads give equal files."""
    samples = len(payload) // UNIT
    keys = range(1, samples + 1, CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    at = len(head) + 8
    offsets = [at + (k - 1) * UNIT for k in keys]
    matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE * UNIT << 16 & 0xFFFFFFFF))
    runs = [(1, CHUNK, 1)] if samples % CHUNK == 0 else [(1, CHUNK, 1)][: len(keys) - 1] + [(len(keys), samples % CHUNK, 1)]
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, samples, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, samples)),
        full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets)),
        full(b"stss", struct.pack(f">I{len(offsets)}I", len(offsets), *keys)),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, samples, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, samples, 0, 0, 256, 0), matrix, bytes(8), flags=7)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, samples, 65536, 256), matrix, bytes(24), struct.pack(">I", 2))
    return head + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def boxes(data, at: int, end: int):
    """(kind, start of body, end) of the boxes from ``at``, with 64-bit and open sizes."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"bad size of box {kind!r} at {at}")
        yield kind, body, stop
        at = stop


def walk(data, at: int = 0, end: int | None = None, path: tuple = ()):
    for kind, body, stop in boxes(data, at, len(data) if end is None else end):
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))


def table(data, at: int, width: int) -> list[tuple]:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return list(struct.iter_unpack(f">{width}I", data[at + 8 : at + 8 + 4 * width * n]))


def track(data, at: int, end: int) -> dict:
    """Codec, duration and the byte ranges of samples and keyframes of the track whose body is ``at`` to ``end``."""
    found = {path[-1]: body for path, body, _ in walk(data, at, end)}
    scale, length = struct.unpack_from(">IQ", data, found[b"mdhd"] + 20) if data[found[b"mdhd"]] == 1 else struct.unpack_from(">II", data, found[b"mdhd"] + 12)
    codec = data[found[b"stsd"] + 12 : found[b"stsd"] + 16].decode("latin-1")
    one, count = struct.unpack_from(">II", data, found[b"stsz"] + 4)
    sizes = [one] * count if one else [s for (s,) in struct.iter_unpack(">I", data[found[b"stsz"] + 12 : found[b"stsz"] + 12 + 4 * count])]
    places = [p for (p,) in table(data, found[b"stco"], 1)] if b"stco" in found else [a << 32 | b for a, b in table(data, found[b"co64"], 2)]
    runs = table(data, found[b"stsc"], 3)
    ends = [r[0] for r in runs[1:]] + [len(places) + 1]
    ranges, k = [], 0
    for (first, per, _), stop in zip(runs, ends):
        for place in places[first - 1 : stop - 1]:
            for _ in range(per):
                ranges.append((place, sizes[k]))
                place, k = place + sizes[k], k + 1
    keys = [s for (s,) in table(data, found[b"stss"], 1)] if b"stss" in found else range(1, count + 1)
    spent = sum(n * d for n, d in table(data, found[b"stts"], 2))
    return {"codec": codec, "duration_ms": length * 1000 // scale, "ticks": spent, "samples": ranges, "keyframes": [ranges[k - 1] for k in keys]}


def tracks(data: bytes) -> list[dict]:
    """All tracks in the order of their boxes."""
    return [track(data, body, stop) for path, body, stop in walk(data) if path[-1] == b"trak"]


def features(data: bytes) -> dict:
    """Codec, duration and the byte ranges of samples and keyframes of the first track, from its sample tables."""
    return next(track(data, body, stop) for path, body, stop in walk(data) if path[-1] == b"trak")


def payload_of(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    return b"".join([data[a : a + n] for a, n in ranges])


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
                      ("codec", pa.string()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of each whole text (UTF-8, null as empty, zero bytes up to a positive multiple of UNIT).

    One row for each row of ``docs``; an empty text is one zero sample; other columns are ignored.
    """

    def store(batches):
        for b in common.slices(batches, 64):
            raw = [t.encode() for t in common.texts(b.column(1))]
            yield common.batch(MEDIA, doc_id=b.column(0), n_bytes=[len(r) for r in raw], media=[to_container(r + bytes(-len(r) % UNIT or (not r) * UNIT)) for r in raw])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read each container back: digests of its payload, codec, duration_ms, number of samples and all keyframe byte ranges of its first track."""

    def read(batches):
        for b in common.slices(batches, 64):
            out = []
            for doc, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                f = features(data)
                payload = payload_of(data, f["samples"])
                keys = [{"offset": at, "size": size} for at, size in f["keyframes"]]
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f["codec"].strip(), f["duration_ms"], len(f["samples"]), keys))
            yield common.batch(FEATURES, **dict(zip(FEATURES.names, zip(*out) if out else [[]] * len(FEATURES))))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_ms long, samples long, keyframes array<struct<offset:long,size:long>>")


def feature_string(codec: Column, duration_ms: Column, samples: Column, keyframes: Column) -> Column:
    """One line of the features: number of keyframes, the first and last byte range and a checksum over all."""
    said = lambda k: F.concat(k.offset.cast("string"), F.lit("+"), k.size.cast("string"))
    edge = lambda at: F.coalesce(said(F.try_element_at(keyframes, F.lit(at))), F.lit(""))
    parts = {"codec": codec, "duration_ms": duration_ms, "samples": samples, "keyframes": F.size(keyframes), "first": edge(1), "last": edge(-1), "ranges_crc32": F.crc32(F.array_join(F.transform(keyframes, said), ";").cast("binary"))}
    return F.concat_ws(",", *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in parts.items()))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_features(media_column(common.load(spark, sf_dir, "documents")))
    shown = ("codec", "duration_ms", "samples", "keyframes")
    return read.withColumn("feature", feature_string(*map(F.col, shown))).drop(*shown)
