"""Token-id output: adaptive context-mixing range coding in independently reset, checksummed blocks.

Every block starts from an empty model. Three predictors speak about the next id: order 2 and order 1 (the id that last
followed the same two ids, or the same id, in this block) and order 0 (adaptive counts of groups of ids). Their
predictions are mixed with weights that follow each predictor's recent success, and the mixed distribution drives a
64-bit range coder. Blocks do not depend on each other, so NumPy codes many of them side by side, one lane a block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .tokens import encoder

MAGIC = b"SMT2"
#: Ids of a block, blocks coded side by side (about), ids after which a frame ends (at a document's end).
BLOCK, LANES = 1024, 4096
FRAME = 2 * BLOCK * LANES
#: Positions at which the order-0 distribution is rebuilt from the counts so far.
REBUILD = (128, 512)
#: Entries of a block's tables of orders 1 and 2; bits of the place in a group of ids.
H1, H2, WIDE = 512, 1024, 6
#: Success of a predictor in sixteenths: at a block's start, and what a miss or a hit makes of it (of 16 and up: it did not speak).
FIRST1, FIRST2 = 4, 12
AFTER = np.array([[c - max(1, c // 4) if c else 0, c + max(1, (15 - c) // 4) if c < 15 else 15] for c in range(16)] + [[c, c] for c in range(16)], np.uint8).ravel()


def mixing(bits: int) -> np.ndarray:
    """By both predictors' success and whether they agree: widths of order 2, of order 1 and of both, eighths left to order 0."""
    rows = np.zeros((4, 1 << 14), np.uint32)
    for c2 in range(32):
        for c1 in range(32):
            a2, a1 = (2 * c2 + 1 if c2 < 16 else 0), (2 * c1 + 1 if c1 < 16 else 0)
            q = (7 * (32 * (a1 + a2) - a1 * a2) + 512) // 1024
            for same in (0, 1):
                both = q << (bits - 3)
                own = both * (a1 + a2 if same and a2 else a2) // max(a1 + a2, 1)
                rows[:, c2 << 8 | same << 6 | c1] = own, both - own, both, 8 - q
    return rows


class Mixer:
    """Model state of ``lanes`` blocks; the coder asks for the split of the range, then tells the id that came."""

    def __init__(self, lanes: int, vocab: int, decodes: bool):
        self.lanes, self.groups, self.decodes = lanes, (vocab >> WIDE) + 1, decodes
        self.low_bits = max(1, int(2 * self.groups - 1).bit_length())
        self.bits = self.low_bits + WIDE + 3
        self.id = np.uint16 if vocab < 65535 else np.uint32
        at = np.arange(lanes, dtype=np.int64)
        self.at1, self.at2, self.at0, self.atl = at * H1, at * H2, at * self.groups, at << self.low_bits
        self.tab1, self.tab2 = np.zeros(lanes * H1, self.id), np.zeros(lanes * H2, self.id)
        self.seen = np.zeros(lanes * self.groups, np.uint32)
        self.p1 = self.p2 = np.zeros(lanes, np.uint32)
        self.c1, self.c2 = np.full(lanes, FIRST1, np.uint8), np.full(lanes, FIRST2, np.uint8)
        self.spoke = np.empty((lanes, 2), np.uint8)  # both predictors' success and flags, read as one number
        self.two, self.one, self.both, self.eighths = mixing(self.bits)
        self.rebuild(0)

    def rebuild(self, n: int) -> None:
        """Order-0 frequencies of the groups: one each, the rest in proportion to the counts. ``cells``: start and frequency."""
        total, seen = 1 << self.low_bits, self.seen.reshape(self.lanes, -1)
        if not n:
            seen = seen[:1]
        freq = 1 + seen * np.uint32(total - self.groups) // np.uint32(n) if n else np.full(seen.shape, total // self.groups, np.uint32)
        freq[:, 0] += total - freq.sum(1, dtype=np.uint32)
        cells = (np.cumsum(freq, 1, dtype=np.uint32) - freq) << np.uint32(16) | freq
        self.cells = (cells if n else np.repeat(cells, self.lanes, 0)).ravel()
        if self.decodes:
            names = np.tile(np.arange(self.groups, dtype=np.uint16), len(freq))
            own = np.repeat(names, freq.ravel())
            self.group_of = own if n else np.tile(own, self.lanes)

    def split(self) -> None:
        """Widths of the order-2 and of both predictions, and the eighths left to order 0."""
        h = self.p1 * np.uint32(0x9E3779B1)
        self.k1 = self.at1 + (h >> np.uint32(20) & np.uint32(H1 - 1))
        self.k2 = self.at2 + ((h ^ self.p2 * np.uint32(0x85EBCA6B)) >> np.uint32(19) & np.uint32(H2 - 1))
        self.g1, self.g2 = self.tab1.take(self.k1), self.tab2.take(self.k2)
        self.e1 = self.c1 | (self.g1 == 0).view(np.uint8) << np.uint8(4)
        self.e2 = self.c2 | (self.g2 == 0).view(np.uint8) << np.uint8(4)
        np.bitwise_or(self.e1, (self.g1 == self.g2).view(np.uint8) << np.uint8(6), out=self.spoke[:, 0])
        self.spoke[:, 1] = self.e2
        at = self.spoke.view("<u2").ravel().astype(np.int64)
        self.w2, self.w1, self.u, self.left = self.two.take(at), self.one.take(at), self.both.take(at), self.eighths.take(at)

    def learn(self, x1: np.ndarray, ids: np.ndarray, group: np.ndarray) -> None:
        """``x1``: the ids plus one in the tables' type; ``group``: where their groups' cells lie."""
        self.c1 = AFTER.take(self.e1 << np.uint8(1) | (x1 == self.g1).view(np.uint8))
        self.c2 = AFTER.take(self.e2 << np.uint8(1) | (x1 == self.g2).view(np.uint8))
        self.tab1[self.k1] = x1
        self.tab2[self.k2] = x1
        self.seen[group] += np.uint32(1)
        self.p2, self.p1 = self.p1, ids


def code_blocks(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """The coded words of each block."""
    lanes, steps = len(blocks), max(map(len, blocks))
    ids = np.zeros((steps, lanes), np.uint32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    m, mask = Mixer(lanes, vocab, False), np.uint64(0xFFFFFFFF)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, pos = np.zeros((lanes, steps * (m.bits + 2) // 32 + 4), np.int64), np.zeros(lanes, np.int64)
    bits, s32, low_mask, wide = np.uint64(m.bits), np.uint64(32), np.uint32((1 << WIDE) - 1), np.uint32(WIDE)
    zero = np.uint32(0)
    plus_one, inner = (ids + np.uint32(1)).astype(m.id), ids & low_mask
    groups = ids >> wide
    for t in range(steps):
        if t in REBUILD:
            m.rebuild(t)
        m.split()
        x1 = plus_one[t]
        hit2 = (x1 == m.g2) & (m.w2 > zero)
        hit1 = (x1 == m.g1) & (m.w1 > zero)
        group = m.at0 + groups[t]
        cell = m.cells.take(group)
        f = cell & np.uint32(0xFFFF)
        start = m.u + m.left * ((cell >> np.uint32(16) << wide) + inner[t] * f)
        size = m.left * f
        np.copyto(start, m.w2, where=hit1)
        np.copyto(size, m.w1, where=hit1)
        np.copyto(start, zero, where=hit2)
        np.copyto(size, m.w2, where=hit2)
        r = width >> bits
        add = r * start
        low += add
        width = r * size
        carry = low < add
        if carry.any():
            i = np.flatnonzero(carry)
            out[i, pos[i] - 1] += 1
        i = np.flatnonzero(width <= mask)
        if len(i):
            own = low[i]
            at = pos[i]
            out[i, at] = own >> s32
            pos[i] = at + 1
            low[i] = own << s32
            width[i] <<= s32
        m.learn(x1, ids[t], group)
    i = np.arange(lanes)
    out[i, pos] = low >> s32
    out[i, pos + 1] = low & mask
    while (over := out >> 32).any():
        out &= 0xFFFFFFFF
        out[:, :-1] += over[:, 1:]
    out = out.astype("<u4")
    return [out[i, : n + 2].tobytes() for i, n in enumerate(pos.tolist())]


def decode_blocks(coded: list[bytes], sizes: list[int], vocab: int) -> list[np.ndarray]:
    lanes, steps = len(coded), max(sizes)
    words = np.zeros((lanes, max(map(len, coded)) // 4 + 4), np.uint32)
    for i, c in enumerate(coded):
        words[i, : len(c) // 4] = np.frombuffer(c, "<u4")
    m, mask = Mixer(lanes, vocab, True), np.uint64(0xFFFFFFFF)
    bits, s32, limit, wide = np.uint64(m.bits), np.uint64(32), np.uint64((1 << m.bits) - 1), np.uint32(WIDE)
    last, row = words.shape[1] - 1, np.arange(lanes, dtype=np.int64) * words.shape[1]
    flat = words.ravel()
    code, width, pos = words[:, 0].astype(np.uint64) << s32 | words[:, 1], np.full(lanes, 2**64 - 1, np.uint64), np.full(lanes, 2)
    out = np.empty((steps, lanes), "<u4")
    zero, one = np.uint32(0), np.uint32(1)
    for t in range(steps):
        if t in REBUILD:
            m.rebuild(t)
        m.split()
        r = width >> bits
        v = np.minimum(code // r, limit).astype(np.uint32)
        hit2, hit1 = v < m.w2, v < m.u  # what both claim is order 2's
        slot = np.maximum(v, m.u)
        slot -= m.u
        slot //= m.left
        group = m.group_of.take(m.atl + (slot >> wide))
        cell = m.cells.take(m.at0 + group)
        f = cell & np.uint32(0xFFFF)
        low = cell >> np.uint32(16) << wide
        inner = (slot - low) // f
        x = (group.astype(np.uint32) << wide) + inner
        start = m.u + m.left * (low + inner * f)
        size = m.left * f
        np.copyto(x, m.g1 - one, where=hit1)
        np.copyto(start, m.w2, where=hit1)
        np.copyto(size, m.w1, where=hit1)
        np.copyto(x, m.g2 - one, where=hit2)
        np.copyto(start, zero, where=hit2)
        np.copyto(size, m.w2, where=hit2)
        code -= r * start
        width = r * size
        i = np.flatnonzero(width <= mask)
        if len(i):
            at = pos[i]
            code[i] = code[i] << s32 | flat.take(row[i] + np.minimum(at, last))
            pos[i] = at + 1
            width[i] <<= s32
        # damaged words may give ids beyond the vocabulary; the block's checksum tells
        m.learn((x + one).astype(m.id), x, m.at0 + np.minimum(x >> wide, np.uint32(m.groups - 1)))
        out[t] = x
    out = out.T.copy()
    return [out[i, :n] for i, n in enumerate(sizes)]


def batches_of(blocks: int) -> list[slice]:
    """Blocks coded together: about LANES each, in equal parts."""
    cuts = np.linspace(0, blocks, max(1, round(blocks / LANES)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def write_frame(docs: list[int | None], lengths: list[int], ids: np.ndarray, vocab: int) -> bytes:
    """A file image: header, document index, block table (ids, bytes, crc32 of the ids), coded blocks."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded = [c for part in batches_of(len(blocks)) for c in code_blocks(blocks[part], vocab)]
    table = np.array([[len(b), len(c), zlib.crc32(b.tobytes())] for b, c in zip(blocks, coded)], "<u4").reshape(-1, 3)
    head = struct.pack("<4sIIQI", MAGIC, vocab, len(docs), len(ids), len(blocks))
    null = np.array([d is None for d in docs], "u1").tobytes()
    index = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + null
    return b"".join([head, index, table.tobytes(), *coded])


def read_frame(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their lengths and all ids; a damaged block raises."""
    magic, vocab, n, total, blocks = struct.unpack_from("<4sIIQI", image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize("<4sIIQI")
    docs, lengths = np.frombuffer(image, "<i8", n, at), np.frombuffer(image, "<i8", n, at + 8 * n)
    null = np.frombuffer(image, "u1", n, at + 16 * n)
    at += 17 * n
    table = np.frombuffer(image, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    ends = at + 12 * blocks + np.cumsum(table[:, 1])
    ids = np.empty(total, "<u4")
    for part in batches_of(blocks):
        coded = [image[e - s : e] for e, s in zip(ends[part], table[part, 1])]
        for k, b in enumerate(decode_blocks(coded, table[part, 0].tolist(), vocab), part.start):
            if zlib.crc32(b.tobytes()) != table[k, 2]:
                raise ValueError(f"block {k} is damaged")
            ids[k * BLOCK : k * BLOCK + len(b)] = b
    return [None if z else int(d) for d, z in zip(docs, null)], lengths, ids


FRAMES = pa.schema([("frame", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
DOCS = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocab: int) -> DataFrame:
    """Token files of ``docs`` (doc_id, text) in ascending doc_id order, stored as (shard, frame, n_docs, n_ids, image).

    A null text is empty, so its document holds the end id alone; null ids come first; rows that share an id stay
    neighbours; an empty table gives no frame. Frames hold whole documents.
    """

    def to_frames(batches):
        enc = encoder(tokenizer)
        no, ids, names, sizes, held = 0, [], [], [], 0
        end = np.array([end_id], "<u4")

        def frame():
            return common.batch(FRAMES, frame=[no], n_docs=[len(names)], n_ids=[held], image=[write_frame(names, sizes, np.concatenate(ids), vocab)])

        for b in common.slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), enc.encode(common.texts(b.column(1)))):
                ids += [text, end]
                names.append(doc)
                sizes.append(len(text) + 1)
                held += sizes[-1]
                if held >= FRAME:
                    yield frame()
                    no, ids, names, sizes, held = no + 1, [], [], [], 0
        if names:
            yield frame()

    rows = docs.select("doc_id", "text").repartitionByRange(common.partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    frames = rows.mapInArrow(to_frames, "frame int, n_docs long, n_ids long, image binary")
    return common.stash(frames.withColumn("shard", F.spark_partition_id()), "token-files", "none")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def to_docs(batches):
        for b in batches:
            for shard, no, image in zip(*(b.column(i).to_pylist() for i in range(3))):
                names, sizes, ids = read_frame(image)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
                yield common.batch(DOCS, shard=[shard] * len(names), frame=[no] * len(names), doc_id=names, before=ends - sizes, n_tokens=sizes, ids_crc32=crc)

    docs = files.select("shard", "frame", "image").mapInArrow(to_docs, "shard int, frame int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    by_frame = Window.partitionBy("shard").orderBy("frame")
    starts = files.select("shard", "frame", (F.sum("n_ids").over(by_frame) - F.col("n_ids")).alias("frame_start")).join(shards, "shard")
    return docs.join(starts, ["shard", "frame"]).select("doc_id", (F.col("shard_start") + F.col("frame_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(common.load(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2, 50257)
    return read_token_files(files)
