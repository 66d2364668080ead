"""Word error rates as expressions: words become symbols, so the built-in edit distance counts words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType, StructType

from .text import words

#: First code point of the symbols; together with the next 6000 it stays in one plane of letters.
FIRST_SYMBOL, SYMBOLS = 0x3400, 6000


def _symbols(text_words: Column, vocabulary: Column) -> Column:
    # all symbols at once: four hex digits for each word, read as UTF-16
    codes = F.array_join(F.transform(text_words, lambda w: F.hex(F.array_position(vocabulary, w) + FIRST_SYMBOL)), "")
    return F.decode(F.unhex(codes), "UTF-16BE")


def distance(ref: list[str], hyp: list[str]) -> int:
    """Edit distance of two lists of words of any size; two rows of the table in memory."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in (ref, hyp))
    step = np.arange(len(b) + 1)
    row = step
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # insertions: the least of what is left of a cell, plus the way from there
        row = np.minimum.accumulate(np.concatenate([[i], best]) - step) + step
    return int(row[-1])


@F.pandas_udf(LongType())
def _long_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else distance(list(r), list(h)) for r, h in zip(ref, hyp)], dtype="Int64")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of arrays of words; pairs with more than SYMBOLS distinct words go through Arrow, the others stay native."""
    # bound as lambda variables, so that words and vocabulary are made once a row
    def edits(p: Column, vocabulary: Column) -> Column:
        return F.when(F.size(vocabulary) <= SYMBOLS, F.levenshtein(_symbols(p.r, vocabulary), _symbols(p.h, vocabulary)).cast("long"))

    def each(p: Column) -> Column:
        return F.transform(F.array(F.array_union(p.r, p.h)), lambda v: edits(p, v))[0]

    short = F.transform(F.array(F.struct(ref.alias("r"), hyp.alias("h"))), each)[0]
    beyond = (F.size(ref) + F.size(hyp) > SYMBOLS) & (F.size(F.array_union(ref, hyp)) > SYMBOLS)
    return F.coalesce(short, _long_edits(F.when(beyond, ref), F.when(beyond, hyp)))


def wer(ref: Column, hyp: Column) -> Column:
    """Edits by reference words; 0 where both are empty, null where only the reference is."""
    r, h = words(ref), words(hyp)
    return F.when(F.size(r) > 0, word_edits(r, h) / F.size(r)).when(F.size(h) == 0, 0.0)


def bucket(rate: Column) -> Column:
    return F.when(rate == 0, "zero").when(rate == 1, "one").when(rate > 1, "over one").when(rate > 0, "between")


def distance_ladder(manual: Column, machine: Column, norm_manual: Column, norm_machine: Column) -> Column:
    """Edit rate of a manual against a machine text: of the normalised texts; without a manual text of the machine text
    against nothing; of the raw manual text where only normalising empties it; 0 where nothing is left on either side."""
    given = lambda c: c != ""
    ref = F.when(given(norm_manual), norm_manual).when(given(manual), manual).when(given(norm_machine), norm_machine).otherwise(machine)
    hyp = F.when(given(norm_manual) | given(manual), norm_machine).otherwise(F.lit(""))
    return wer(ref, hyp)


#: Cells of a row of costs that are worked on at once, for all pairs together.
CELLS = 1 << 18


def edit_counts(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Substitutions, deletions and insertions of a least alignment of each pair; of equally good ones matches and
    substitutions come first, then deletions, seen from the end.

    Pairs of like size are aligned together, row by row: each cell carries the substitutions and deletions of its own
    best way, so there is no way back and memory is that of a row. A cell that insertions lead to has those of the last
    cell before it that none leads to.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (-len(pairs[k][1]), -len(pairs[k][0])))
    at = 0
    while at < len(order):
        width = len(pairs[order[at]][1]) + 1
        some = order[at : at + max(1, CELLS // width)]
        at += len(some)
        some.sort(key=lambda k: -len(pairs[k][0]))
        out[some] = aligned([pairs[k] for k in some], width)
    return out


def aligned(pairs: list[tuple[list[str], list[str]]], width: int) -> np.ndarray:
    """``edit_counts`` of pairs with falling numbers of reference words, by rows of ``width`` cells."""
    ids: dict[str, int] = {}
    number = lambda words: [ids.setdefault(w, len(ids)) for w in words]
    refs, hyps = [number(r) for r, _ in pairs], np.full((len(pairs), width - 1), -1)
    for k, (_, h) in enumerate(pairs):
        hyps[k, : len(h)] = number(h)
    column, last = np.arange(width), np.array([len(h) for _, h in pairs])
    cost = np.tile(column, (len(pairs), 1))
    subs, dels, out = np.zeros_like(cost), np.zeros_like(cost), np.zeros((len(pairs), 3), np.int64)
    lengths = np.array([len(r) for r in refs])
    for i in range(int(lengths.max(initial=0)) + 1):
        n = int((lengths >= i).sum())
        if i:
            cost, subs, dels = cost[:n], subs[:n], dels[:n]
            wrong = (hyps[:n] != np.array([r[i - 1] for r in refs[:n]])[:, None]).astype(np.int64)
            across = cost[:, :-1] + wrong <= cost[:, 1:] + 1
            best, s, d = cost + 1, subs.copy(), dels + 1
            best[:, 1:] = np.where(across, cost[:, :-1] + wrong, best[:, 1:])
            s[:, 1:] = np.where(across, subs[:, :-1] + wrong, s[:, 1:])
            d[:, 1:] = np.where(across, dels[:, :-1], d[:, 1:])
            # where insertions lead from: the last of the least costs less places
            cost = np.minimum.accumulate(best - column, 1) + column
            source = np.maximum.accumulate(np.where(cost == best, column, 0), 1)
            subs, dels = np.take_along_axis(s, source, 1), np.take_along_axis(d, source, 1)
        for k in np.flatnonzero(lengths[:n] == i):
            c, a, b = cost[k, last[k]], subs[k, last[k]], dels[k, last[k]]
            out[k] = a, b, c - a - b
    return out


@F.pandas_udf(StructType().add("subs", "long").add("dels", "long").add("ins", "long"))
def alignment(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Substitutions, deletions and insertions of arrays of words; null arrays are empty."""
    words = lambda x: [] if x is None else list(x)
    return pd.DataFrame(edit_counts([(words(r), words(h)) for r, h in zip(ref, hyp)]), columns=["subs", "dels", "ins"], dtype="int64")
