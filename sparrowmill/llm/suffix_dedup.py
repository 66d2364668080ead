"""Exact substring deduplication by a common-prefix-aware distributed merge sort of suffixes.

Every byte of a text that is covered by a ``length``-byte string which also starts earlier in the corpus is removed.

1. Equal whole texts are one text, owned by the smallest doc_id; copies lose everything.
2. Suffixes are anchored: of each ``length``-byte window the positions with the least hash of GRAM bytes. Equal windows
   have equal anchors, so sorting the anchored suffixes alone finds every repeat. Anchors whose fingerprint occurs once
   are dropped by a distributed count before any suffix is sent (duplicate detection on prefixes).
3. Tasks sort the suffixes left, front-code them (length of the prefix shared with the one before, then the rest), and
   exchange these runs. A loser tree merges a bucket's runs; it keeps the length of each loser's common prefix with the
   winner and so never compares a known prefix again.
   Within a run, windows that repeat an earlier one of the run are settled at once and leave it. What is left of a
   frequent fingerprint is dealt to buckets window by window, by a hash of the whole window, so no bucket is hot.
4. In the merged order, windows are equal where neighbouring suffixes share enough bytes to the right of the anchor and
   the bytes to its left agree; all but the earliest are repeats. Their spans go back to the texts.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Bytes of a fingerprint, suffixes that a task sorts at a time, suffixes of a merge bucket (mean), bytes of a text looked at at a time.
GRAM, FLUSH, BUCKET, PIECE = 32, 60_000, 40_000, 1 << 22
#: Occurrences from which a fingerprint is frequent, distinct texts that a task remembers.
HOT, TEXTS = 40_000, 100_000
FIRST = -(2**63)  # a null doc_id comes before all others


def fingerprints(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    h = raw.astype(np.uint64) + np.uint64(0x9E37)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(pick, v: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values that follow each other."""
    step = 1
    while 2 * step <= width:
        v, step = pick(v[:-step], v[step:]), 2 * step
    return pick(v[: len(v) - (width - step)], v[width - step :]) if width > step else v


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are the least of some window, the fingerprints, and each window's least hash."""
    h = fingerprints(raw)
    low = (h >> np.uint64(32)).astype(np.uint32)
    width = length - GRAM + 1
    least = sliding(np.minimum, low, width)
    edge = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == low), h, least


def pieces(raw: np.ndarray, length: int):
    """(first position, end, place of the slice, slice) of a text's pieces; a slice has all bytes that its positions' windows touch."""
    for a in range(0, len(raw), PIECE):
        b = min(len(raw), a + PIECE)
        at = max(0, a - (length - GRAM))
        yield a, b, at, raw[at : min(len(raw), b + length)]


@lru_cache(1)
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


UNIQUE = pa.schema([("uid", pa.int64()), ("key", pa.binary()), ("owner", pa.int64()), ("packed", pa.binary())])


def unique_texts(docs: DataFrame, length: int) -> DataFrame:
    """Distinct texts of at least ``length`` bytes as a table bucketed by uid: uid, key, owner, packed (zstd)."""

    def rows(batches):
        first: dict[bytes, int] = {}
        least: dict[bytes, int] = {}
        uid = lambda key: int.from_bytes(key[:8], "little", signed=True)
        def later():
            return common.batch(UNIQUE, uid=[uid(k) for k in least], key=list(least), owner=list(least.values()), packed=[None] * len(least))

        for b in common.slices(batches):
            out = []
            for order, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                key = hashlib.sha256(raw).digest()[:16]
                if key not in first:
                    first[key] = order
                    out.append((uid(key), key, order, codec()[0].compress(raw)))
                elif order < least.get(key, first[key]):
                    least[key] = order
            yield common.batch(UNIQUE, **dict(zip(UNIQUE.names, zip(*out) if out else [[]] * 4)))
            if len(first) > TEXTS:
                yield later()
                first.clear()
                least.clear()
        if least:
            yield later()

    spark = docs.sparkSession
    long_ones = docs.where(F.octet_length("text") >= length).select(F.coalesce("doc_id", F.lit(FIRST)).alias("order"), "text")
    parts = common.partitions(spark)
    found = long_ones.mapInArrow(rows, "uid long, key binary, owner long, packed binary").repartition(parts, "uid")
    return common.bucketed(found.groupBy("uid", "key").agg(F.min("owner").alias("owner"), F.first("packed", True).alias("packed")), "uid", "texts", parts)


def candidates(texts: DataFrame, length: int) -> DataFrame:
    """uid and its anchors (p, whether frequent) whose fingerprint occurs twice or more among the distinct texts."""
    arrow = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("p", pa.int64())])

    def rows(batches):
        for b in common.slices(batches, 64):
            for uid, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, end, place, raw in pieces(np.frombuffer(codec()[1].decompress(packed), np.uint8), length):
                    if len(raw) >= length:
                        at, h, _ = anchors(raw, length)
                        at = at[(at + place >= a) & (at + place < end)]
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), uid)), pa.array(at + place)], schema=arrow)

    found = texts.select("uid", "packed").mapInArrow(rows, "h long, uid long, p long")
    # written first, so that the join deals both sides anew and Spark can split a frequent fingerprint
    twice = common.stash(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "repeated-fingerprints")
    return found.join(twice, "h").groupBy("uid").agg(F.collect_list(F.struct("p", "hot")).alias("at"))


def front_code(right: np.ndarray, left: np.ndarray, order: np.ndarray) -> bytes:
    """A sorted run: prefix lengths shared with the suffix before, the rests, left contexts, (owner, uid, p, jlo, jhi)."""
    shared = np.zeros(len(right), np.uint8)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), right.shape[1])
    rest = right[np.arange(right.shape[1])[None] >= shared[:, None]]
    head = struct.pack("<III", len(right), right.shape[1], left.shape[1])
    return codec()[0].compress(head + shared.tobytes() + rest.tobytes() + left.tobytes() + order.astype("<i8").tobytes())


def front_decode(run: bytes):
    """Suffixes as bytes, shared prefix lengths, left contexts, orders."""
    data = codec()[1].decompress(run)
    n, width, left_width = struct.unpack_from("<III", data)
    shared = np.frombuffer(data, np.uint8, n, 12)
    at, before, suffixes = 12 + n, b"", []
    for s in shared.tolist():
        before = before[:s] + data[at : at + width - s]
        at += width - s
        suffixes.append(before)
    left = np.frombuffer(data, np.uint8, n * left_width, at).reshape(n, left_width)
    return suffixes, shared.tolist(), left, np.frombuffer(data, "<i8", 5 * n, at + n * left_width).reshape(n, 5)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of sorted runs (suffixes, shared prefixes): (run, place) in order, and the prefix each shares with the one before.

    ``known[i]`` is the common prefix of run i's head with the last winner it met. A head with the longer known prefix
    is the smaller one; only heads with equal known prefixes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, place, losers = [0] * k, [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, other = known[a], known[b]
        if h > other:
            return a, b
        if other > h:
            return b, a
        if x == y:
            known[b if a < b else a] = len(x)
            return (a, b) if a < b else (b, a)
        diff = int.from_bytes(x[h:], "big") ^ int.from_bytes(y[h:], "big")
        at = len(x) - (diff.bit_length() + 7) // 8
        if x[at] < y[at]:
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if k > 1 else 0
    order, shared = [], []
    while heads[win] is not None:
        order.append((win, place[win]))
        shared.append(known[win])
        place[win] += 1
        suffixes, common_prefix = runs[win]
        if place[win] < len(suffixes):
            heads[win], known[win] = suffixes[place[win]], common_prefix[place[win]]
        else:
            heads[win] = None
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2
    return order, shared


def repeats(shared: np.ndarray, left: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in merged order: which of their windows (one column for each byte left of the anchor) repeat an earlier one."""
    width = length - GRAM + 1
    all_hits = np.zeros((len(order), width), bool)
    near = shared >= GRAM  # without a neighbour that shares a fingerprint no window can repeat
    pick = np.flatnonzero(near | np.append(near[1:], False))
    shared, left, order = shared[pick], left[pick], order[pick]
    rank = np.lexsort((order[:, 2], order[:, 1], order[:, 0]))
    hit = np.zeros((len(order), width), bool)
    side = np.zeros(len(order), np.uint64)
    for j in range(width):
        if j:
            side = (side + left[:, -j].astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0x9E3779B97F4A7C15)
            side ^= side >> np.uint64(31)
        group = np.cumsum(shared < length - j).astype(np.uint64)
        key = (side ^ (group * np.uint64(0xD6E8FEB86659FD93)))[rank]
        own = np.flatnonzero(((order[:, 3] <= j) & (j <= order[:, 4]))[rank])
        _, first, back = np.unique(key[own], return_index=True, return_inverse=True)
        hit[rank[own], j] = first[back] != np.arange(len(own))
    all_hits[pick] = hit
    return all_hits


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """uid and its spans (owner, start, end) covered by repeats; spans may overlap."""
    width = length - GRAM + 1
    found = common.stash(candidates(texts, length), "anchors")
    total = found.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n")).collect()[0]["n"]
    buckets = max(common.partitions(texts.sparkSession), -(-total // BUCKET))
    arrow = pa.schema([("bucket", pa.int64()), ("run", pa.binary())])

    def spans_of(hit: np.ndarray, who: np.ndarray) -> np.ndarray:
        """(uid, owner, start, end) of the runs of windows that are hit, one suffix a row of ``hit``."""
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, j0), (_, j1) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # windows j0..j1-1 of suffix i
        return np.stack([who[i, 1], who[i, 0], who[i, 2] - j1 + 1, who[i, 2] - j0 + length], 1).astype("<i8")

    def coded(right, left, order, bucket):
        at = np.lexsort((np.ascontiguousarray(right).view(f"S{length}").ravel(), bucket))
        right, left, order, bucket = right[at], left[at], order[at], bucket[at]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = [(int(bucket[a]), front_code(right[a:b], left[a:b], order[a:b])) for a, b in zip([0, *cuts], [*cuts, len(bucket)])]
        return common.batch(arrow, **dict(zip(arrow.names, zip(*out))))

    def window_hashes(right, left, i, j):
        """Hashes of the windows with j bytes left of the anchors of suffixes i; equal windows have equal ones."""
        h = j.astype(np.uint64) + np.uint64(0x51ED)
        for k in range(width - 1):
            step = (h + left[i, width - 2 - k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = np.where(k < j, step ^ (step >> np.uint64(29)), h)
        for k in range(length):
            step = (h + right[i, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = np.where(k < length - j, step ^ (step >> np.uint64(31)), h)
        return h

    def runs(batches):
        held, n = [], 0
        task, seq = TaskContext.get().partitionId(), 0

        def flush():
            """Runs of what is held. Repeats within it become spans at once; they go out in a bucket of their own."""
            nonlocal seq
            right, left, order, h, hot = (np.concatenate(x) for x in zip(*held))
            at = np.argsort(np.ascontiguousarray(right).view(f"S{length}").ravel(), kind="stable")
            right, left, order, h, hot = right[at], left[at], order[at], h[at], hot[at]
            differ = right[1:] != right[:-1]
            shared = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), length)])
            hit = repeats(shared, left, order, length)
            spans = spans_of(hit, order)
            if len(spans):
                seq += 1
                yield common.batch(arrow, bucket=[-(task << 32 | seq)], run=[codec()[0].compress(spans.tobytes())])
            left_over = (np.arange(width) >= order[:, 3:4]) & (np.arange(width) <= order[:, 4:5]) & ~hit
            keep = left_over.any(1)
            order[:, 3], order[:, 4] = left_over.argmax(1), width - 1 - left_over[:, ::-1].argmax(1)
            plain = np.flatnonzero(keep & ~hot)
            if len(plain):
                yield coded(right[plain], left[plain], order[plain], (h[plain] % np.uint64(buckets)).astype(np.int64))
            i, j = np.nonzero(left_over & hot[:, None])
            for part in np.array_split(np.arange(len(i)), -(-len(i) // FLUSH) or 1):
                if len(part):
                    own, js = i[part], j[part]
                    row = order[own]
                    row[:, 3] = row[:, 4] = js
                    yield coded(right[own], left[own], row, (window_hashes(right, left, own, js) % np.uint64(buckets)).astype(np.int64))

        view = np.lib.stride_tricks.sliding_window_view
        for b in common.slices(batches, 64):
            for uid, owner, packed, spots in zip(*(b.column(i).to_pylist() for i in range(4))):
                whole = np.frombuffer(codec()[1].decompress(packed), np.uint8)
                spots = dict((s["p"], s["hot"]) for s in spots)
                where, is_hot = np.array(sorted(spots), np.int64), np.array([spots[p] for p in sorted(spots)], bool)
                for a, end, place, raw in pieces(whole, length):
                    own = (where >= a) & (where < end)
                    if not own.any():
                        continue
                    _, h, least = anchors(raw, length)
                    low = (h >> np.uint64(32)).astype(np.uint32)
                    padded = np.concatenate([np.zeros(width - 1, np.uint8), raw, np.zeros(length, np.uint8)])
                    own &= where - place < len(h)
                    for some in np.array_split(np.flatnonzero(own), -(-int(own.sum()) // FLUSH) or 1):
                        part = where[some] - place
                        start = part[:, None] - np.arange(width)[None]  # of the window with j bytes left of the anchor
                        inside = (start >= 0) & (start < len(least))
                        mine = inside & (least[np.clip(start, 0, len(least) - 1)] == low[part][:, None])
                        lo, hi = mine.argmax(1), width - 1 - mine[:, ::-1].argmax(1)
                        row = np.stack([np.full(len(part), owner), np.full(len(part), uid), part + place, lo, hi], 1)
                        keep = mine.any(1)
                        held.append((view(padded, length)[part + width - 1][keep], view(padded, width - 1)[part][keep], row[keep], h[part][keep], is_hot[some][keep]))
                        n += int(keep.sum())
                        if n >= FLUSH:
                            yield from flush()
                            held.clear()
                            n = 0
        if n:
            yield from flush()

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # spans, settled within a run
            spans = np.concatenate([np.frombuffer(codec()[1].decompress(r), "<i8").reshape(-1, 4) for r in rows["run"]])
        else:
            decoded = [front_decode(r) for r in sorted(rows["run"])]
            order, shared = merge_runs([d[:2] for d in decoded])
            starts = np.cumsum([0, *(len(d[0]) for d in decoded)])
            at = np.array([starts[r] + i for r, i in order], np.int64)
            left, who = np.concatenate([d[2] for d in decoded])[at], np.concatenate([d[3] for d in decoded])[at]
            spans = spans_of(repeats(np.array(shared), left, who, length), who)
        return pd.DataFrame(spans, columns=["uid", "owner", "start", "end"])

    joined = texts.join(found, "uid").select("uid", "owner", "packed", "at")
    spans = joined.mapInArrow(runs, "bucket long, run binary").groupBy("bucket").applyInPandas(merge, "uid long, owner long, start long, end long")
    return spans.groupBy("uid").agg(F.collect_list(F.struct("owner", "start", "end")).alias("spans"))


def dedup_texts(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """Distinct texts of at least ``length`` bytes: key (first 16 bytes of SHA-256), owner, n_removed, n_spans, kept_sha256, kept (or null)."""
    texts = unique_texts(docs, length)
    spans = common.stash(repeated_spans(texts, length), "spans")
    arrow = pa.schema([("key", pa.binary()), ("owner", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches):
        for b in common.slices(batches, 64):
            out = []
            for key, owner, packed, own in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                raw, parts, last, gone, runs = codec()[1].decompress(packed), [], 0, 0, 0
                if own.is_valid:
                    who, start, end = (own.values.field(k).to_numpy() for k in ("owner", "start", "end"))
                    start, end = start[who == owner], end[who == owner]
                    at = np.argsort(start, kind="stable")
                    start, reach = start[at], np.maximum.accumulate(end[at])
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else start
                    for a, z in zip(start[new].tolist(), np.append(reach[new[1:] - 1], reach[-1:]).tolist()):
                        parts.append(raw[last:a])
                        gone, runs, last = gone + z - a, runs + 1, z
                kept = b"".join([*parts, raw[last:]])
                out.append((key, owner, gone, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield common.batch(arrow, **dict(zip(arrow.names, zip(*out) if out else [[]] * 6)))

    joined = texts.join(spans, "uid", "left").select("key", "owner", "packed", "spans")
    return joined.mapInArrow(cut, "key binary, owner long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text).

    A null text is empty; texts shorter than ``length`` bytes lose nothing; a null doc_id comes before all others; of
    equal texts only that with the smallest doc_id can keep bytes, and repeated rows (same id, same text) share its
    result; an empty table gives no rows; other columns are ignored. A long text is looked at PIECE bytes at a time.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("order"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("key", F.when(F.col("n_bytes") >= length, F.unhex(F.substring("sha", 1, 32))))
    rows = rows.join(dedup_texts(docs, length).drop("kept"), "key", "left")
    copy = F.col("owner").isNotNull() & (F.col("order") != F.col("owner"))
    pick = lambda whole, else_: F.when(copy, whole).otherwise(F.coalesce(*else_))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), ("n_removed", zero)).alias("n_removed"), pick(F.lit(1).cast("long"), ("n_spans", zero)).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), ("kept_sha256", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated strings removed from ``text``; all rows and columns stay, whatever their names.

    Characters cut in part at a removed run's edge go with it; a text that is all repeats becomes empty; a null stays null.
    Null ids, repeated rows and empty tables as in ``suffix_dedup``.
    """
    name, held, owner, kept = common.fresh(docs.columns, "text_key", "short_text", "text_owner", "kept_bytes")
    done = dedup_texts(docs, length, True).select(F.col("key").alias(name), F.col("owner").alias(owner), F.col("kept").alias(kept))
    rows = docs.withColumn(name, F.when(F.octet_length("text") >= length, F.unhex(F.substring(F.sha2("text", 256), 1, 32))))
    rows = rows.withColumn(held, F.when(F.col(name).isNull(), F.col("text"))).drop("text").join(done, name, "left")
    mine = F.coalesce("doc_id", F.lit(FIRST)) == F.col(owner)
    rows = rows.withColumn(kept, F.when(F.col(owner).isNotNull() & ~mine, F.lit(b"")).otherwise(F.col(kept)))
    cut = rows.select(*(F.col(held).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns), kept)

    def decode(batches):
        for b in common.slices(batches):
            at = b.schema.get_field_index("text")
            text = [t if k is None else k.decode("utf-8", "ignore") for t, k in zip(b.column(at).to_pylist(), b.column(kept).to_pylist())]
            yield b.set_column(at, b.schema.field(at), pa.array(text, b.schema.field(at).type)).drop_columns([kept])

    return cut.mapInArrow(decode, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.load(spark, sf_dir, "documents"))
