"""Byte-pair tokens of a public vocabulary: ids and counts over Arrow batches.

A vocabulary is a file of base64 tokens with their ranks. Texts are cut by the vocabulary's pattern; in each piece the
pair of neighbours that makes the token of the lowest rank is merged, until none does. Pieces that came before are
looked up; the merging of a long piece keeps its pairs in a heap, so that time grows with its length alone.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: How the vocabulary cuts texts (fixed value): short forms, letters, numbers and signs with the space before them, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers, the longest of them, and bytes up to which a piece is merged without a heap.
REMEMBERED, LONG, SHORT = 1 << 17, 64, 40
#: Characters up to which the tokens' own library encodes a text, where it is installed; its pattern may give up on very long runs.
BY_LIBRARY = 100_000


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.cut, self.known, self.none = regex.compile(PATTERN), {}, max(self.ranks.values(), default=0) + 1
        try:
            import tiktoken

            self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}) if self.ranks else None
        except ImportError:
            self.library = None

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece. Parts are spans of bytes in a linked list; a pair in the heap is void once either part has changed."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT:
            return self.merged_short([piece[i : i + 1] for i in range(n)])
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                k = end[after[i]]
                if (r := ranks.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def merged_short(self, parts: list[bytes]) -> list[int]:
        """As ``merged``, by looking at all pairs again: quicker for the few bytes of most words."""
        get, none = self.ranks.get, self.none
        while len(parts) > 1:
            found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            if (least := min(found)) == none:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def ids_of(self, piece: str) -> list[int]:
        """Ids of a piece that isn't remembered."""
        ids = self.merged(piece.encode())
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.library and len(text) <= BY_LIBRARY:
            return self.library.encode_ordinary(text)
        out, get = [], self.known.get
        for piece in self.cut.findall(text):
            out += get(piece) or self.ids_of(piece)
        return out

    def count(self, text: str) -> int:
        if self.library and len(text) <= BY_LIBRARY:
            return len(self.library.encode_ordinary(text))
        get = self.known.get
        return sum([len(get(piece) or self.ids_of(piece)) for piece in self.cut.findall(text)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    """Number of tokens of a text, for functions that run inside tasks; the vocabulary is read where it is used."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return vocabulary(self.path).count(text)


def token_ids(path: str) -> Callable[[Column], Column]:
    """Arrays of texts -> arrays of their ids; null texts have none, a null array stays null. ``path`` is one that all executors have."""

    @F.arrow_udf("array<array<int>>")
    def ids(lists: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if own is None else [v.encode(t or "") for t in own] for own in lists.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return ids


def token_counts(path: str) -> Callable[[Column], Column]:
    """Arrays of texts -> arrays of their numbers of tokens; null texts have none, a null array stays null."""

    @F.arrow_udf("array<int>")
    def counts(lists: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if own is None else [v.count(t or "") for t in own] for own in lists.to_pylist()], pa.list_(pa.int32()))

    return counts
