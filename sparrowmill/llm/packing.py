"""Best-fit packing by bin completion.

Documents become token pieces; pieces are dealt to groups of bounded size by a hash, so no key can be hot, and each
group is packed on its own: a best-fit-decreasing incumbent first, then bin completion branch and bound, which fills
the bin of the largest piece left with undominated fillings and prunes on the waste that a better packing may have.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .tokens import encoder

#: Pieces of a group (mean), fillings kept for a bin and alternatives tried to find them, bins that one search may open
#: besides one for each piece. A search that runs out leaves the incumbent, so these bound time, not the result's rows;
#: ``exact`` lifts all but the first.
GROUP, FILLINGS, STEPS, NODES = 20_000, 6, 60, 60_000


class Sizes:
    """A multiset of sizes with a bit mask of those present."""

    def __init__(self, sizes):
        self.count = Counter(sizes)
        self.mask = sum(1 << s for s, n in self.count.items() if n)

    def take(self, s: int, n: int = 1) -> None:
        self.count[s] -= n
        if not self.count[s]:
            self.mask &= ~(1 << s)

    def put(self, s: int, n: int = 1) -> None:
        self.count[s] += n
        self.mask |= 1 << s

    def at_most(self, s: int) -> int:
        """The largest size present up to ``s``, 0 if there is none."""
        return max(0, (self.mask & ((1 << (s + 1)) - 1)).bit_length() - 1) if s > 0 else 0


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes to the fullest bin that still takes it."""
    bins, by_room, rooms = [], defaultdict(list), 0
    for s in sorted(sizes, reverse=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = cap, len(bins)
            bins.append([])
        bins[k].append(s)
        if room > s:
            by_room[room - s].append(k)
            rooms |= 1 << (room - s)
    return bins


def fillings(left: Sizes, room: int, waste: int) -> list[list[int]]:
    """Some undominated fillings of ``room`` that waste at most ``waste``, the fullest first.

    Equal pieces are taken together, and only alternatives count as steps: each descent goes on to its end.
    """
    found: list[tuple[int, list[tuple[int, int]]]] = []
    steps = 0

    def grow(own: list[tuple[int, int]], room: int, top: int) -> None:
        nonlocal steps
        s = left.at_most(min(room, top))
        if not s:
            if room <= waste and not any(left.at_most(a + room) > a for a, _ in own):
                found.append((room, own))
            return
        tried, n = 0, min(left.count[s], room // s)
        while s and (not tried or tried < 3 and len(found) < FILLINGS and steps < STEPS):
            steps += tried > 0
            left.take(s, n)
            grow([*own, (s, n)], room - n * s, s - 1)
            left.put(s, n)
            tried += 1
            if tried == 1 and n > 1:
                n -= 1
            elif s := left.at_most(s - 1):
                n = min(left.count[s], room // s)

    grow([], room, room)
    return [[s for s, n in f for _ in range(n)] for _, f in sorted(found, key=lambda x: x[0])]


def all_fillings(left: Sizes, room: int, waste: int) -> Iterator[list[int]]:
    """Every filling of ``room`` that wastes at most ``waste`` and that no added or larger piece improves, one at a time."""

    def grow(own: list[tuple[int, int]], room: int, top: int) -> Iterator[list[int]]:
        s = left.at_most(min(room, top))
        if not s and room <= waste and not left.at_most(room) and not any(left.at_most(a + room) > a for a, _ in own):
            yield [s for s, n in own for _ in range(n)]
        while s:
            for n in range(min(left.count[s], room // s), 0, -1):
                left.take(s, n)
                yield from grow([*own, (s, n)], room - n * s, s - 1)
                left.put(s, n)
            s = left.at_most(s - 1)

    return grow([], room, room)


def complete(sizes: list[int], cap: int, goal: int, exact: bool = False) -> list[list[int]] | None:
    """A packing into ``goal`` bins, or None if the search ends or, unless ``exact``, runs out of nodes."""
    left, spare, bins, nodes = Sizes(sizes), goal * cap - sum(sizes), [], 0
    stack: list[tuple[int, Iterator[list[int]], int]] = []  # size that opened the bin, fillings not tried, waste allowed before it
    down = True
    while True:
        if down:
            top = left.mask.bit_length() - 1
            if top <= 0:
                return bins
            nodes += 1
            if nodes > NODES + len(sizes) and not exact:
                return None
            left.take(top)
            # a search through all fillings goes on while other bins are filled, so it has a copy of what is left
            tries = all_fillings(Sizes(left.count), cap - top, spare) if exact else iter(fillings(left, cap - top, spare))
            stack.append((top, tries, spare))
        top, rest, before = stack[-1]
        fill = next(rest, None)
        if fill is not None:
            for s in fill:
                left.take(s)
            bins.append([top, *fill])
            spare, down = before - (cap - top - sum(fill)), True
        else:
            stack.pop()
            left.put(top)
            if not stack:
                return None
            for s in bins.pop()[1:]:
                left.put(s)
            down = False


def lower_bound(sizes: list[int], cap: int) -> int:
    """Bins that any packing needs (L2): for each a, sizes over ``cap - a`` leave no room for sizes from a on."""
    if not sizes:
        return 0
    n = np.bincount(sizes, minlength=cap + 1)
    counts, sums = np.cumsum(n), np.cumsum(n * np.arange(cap + 1))
    half = cap // 2
    a = np.arange(1, half + 1)
    room = (counts[cap - a] - counts[half]) * cap - (sums[cap - a] - sums[half])
    need = counts[cap] - counts[half] + np.maximum(0, -((room - (sums[half] - sums[a - 1])) // cap))
    return int(max(-(-sum(sizes) // cap), need.max(initial=0)))


def pack(sizes: list[int], cap: int, exact: bool = False) -> list[list[int]]:
    """Bins of sizes: best fit, improved by bin completion until the bound is met or the search gives no better one.

    With ``exact`` the search has no bounds and the bins are as few as can be, in time that may grow exponentially.
    """
    bins = best_fit(sizes, cap)
    least = lower_bound(sizes, cap)
    while len(bins) > least and (better := complete(sizes, cap, len(bins) - 1, exact)) is not None:
        bins = better
    return bins


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, cap: int) -> DataFrame:
    """Pieces of at most ``cap`` ids: doc_id, piece, start, length, ids_crc32 (ids as little-endian uint32)."""

    def cut(batches):
        enc = encoder(tokenizer)
        for b in common.slices(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(common.texts(b.column(1)))):
                raw = ids.tobytes() + end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), 4 * cap)):
                    part = raw[at : at + 4 * cap]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield common.batch(PIECES, **dict(zip(PIECES.names, zip(*rows) if rows else [[]] * 5)))

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int, cap: int, exact: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``cap`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece with the
    end id; rows that share an id are packed each for itself; an empty table gives no rows; other columns are ignored.
    Of equal lengths any piece may take any place. ``exact``: each group has as few sequences as can be, however long
    the search takes.
    """
    pieces = common.stash(token_pieces(docs, tokenizer, end_id, cap), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP))

    def pack_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, sizes in enumerate(pack(rows["length"].tolist(), cap, exact)):
            at = 0
            for s in sizes:
                places[s].append((k, at))
                at += s
        put = [places[s].pop() for s in rows["length"].tolist()]
        rows["sequence_id"] = [int(key[0]) * 2**32 + k for k, _ in put]
        rows["offset"] = [at for _, at in put]
        return rows.drop(columns="g")

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack_group, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.load(spark, sf_dir, "documents"), "word_bpe_49k.json", 0, 2048)
