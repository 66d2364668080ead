"""Token budgets and training sequences over arrays of token ids. Times are milliseconds from a segment's start.

``count`` says how many tokens a caption has; words stand for tokens unless a caller brings a vocabulary's own counts
(``bpe.token_counts`` over ``spoken``, with ``context_of``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import words

CONTEXT = 448
#: Longest window and shortest usable audio in milliseconds.
WINDOW, SHORTEST = 30_000, 15


@dataclass(frozen=True)
class Vocabulary:
    """Special ids of the English vocabulary (fixed values)."""

    start: int = 50257
    end: int = 50256
    no_speech: int = 50361
    no_timestamps: int = 50362
    first_time: int = 50363
    pad: int = 51864


def word_tokens(text: Column) -> Column:
    return F.size(words(text))


def context_modes(captions: Column, last: Column, count: Callable[[Column], Column] = word_tokens, limit: int = CONTEXT) -> Column:
    """Struct of token numbers with and without times, whether each fits ``limit``, and ``over``: neither does.

    With times every caption has two more tokens, a segment that isn't the last one more, and a sequence has its start
    and end; without, a sequence has three tokens besides the text. Null captions are over.
    """
    return context_of(F.transform(captions, lambda c: count(F.trim(c))), last, limit)


def spoken(captions: Column) -> Column:
    """Captions as a vocabulary counts them: trimmed, behind a space."""
    return F.transform(captions, lambda c: F.concat(F.lit(" "), F.trim(F.coalesce(c, F.lit("")))))


def context_of(counts: Column, last: Column, limit: int = CONTEXT) -> Column:
    """``context_modes`` of captions with these numbers of tokens."""
    text = F.aggregate(counts, F.lit(0), lambda n, c: n + c)
    with_times = text + 2 * F.size(counts) + F.when(last, 0).otherwise(1) + 2
    without = text + 3
    return F.struct(
        F.coalesce(with_times <= limit, F.lit(False)).alias("ts_mode"), F.coalesce(without <= limit, F.lit(False)).alias("no_ts_mode"),
        with_times.cast("long").alias("num_tokens_ts_mode"), without.cast("long").alias("num_tokens_no_ts_mode"),
        F.coalesce((with_times > limit) & (without > limit), F.lit(True)).alias("over"))


def times_valid(spans: Column, start: Column, end: Column) -> Column:
    """Whether spans (start, end) are there, lie within ``start`` and ``end`` and within the first start and the last end, none backwards."""
    first, last = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
    inside = lambda s: (s.start <= s.end) & (s.start >= F.greatest(start, first)) & (s.end <= F.least(end, last))
    # the arguments of element_at are only looked at where there are spans
    return F.when(F.size(spans) > 0, (first >= start) & (last <= end) & F.forall(spans, inside)).otherwise(False)


def too_short(start: Column, end: Column) -> Column:
    return end - start < SHORTEST


def too_short_audio(samples: Column, rate: int = 16_000) -> Column:
    return samples / rate < SHORTEST / 1000


def time_token(ms: Column, v: Vocabulary = Vocabulary()) -> Column:
    """Null beyond the window."""
    return F.when(ms <= WINDOW, F.lit(v.first_time) + F.floor(ms / 20)).cast("int")


def sequence(captions: Column, norm_end: Column, ts_mode: Column, only_no_ts: Column, timed: Column, v: Vocabulary = Vocabulary()) -> Column:
    """Token ids of a segment. ``captions``: array of (start, end, ids); ``timed``: the draw for time tokens.

    Silence: with the window filled, the no-speech token; else times of nothing if drawn and allowed. Speech: times
    around each caption and the end's time if drawn, allowed and all within the window; else the text alone. A
    segment beyond the window loses its last caption, if it has more, and its times.
    """
    one = lambda *ids: F.array(*(F.lit(i).cast("int") if isinstance(i, int) else i for i in ids))
    ending = time_token(F.least(norm_end, F.lit(WINDOW)), v)
    bare = lambda ids: F.concat(one(v.start, v.no_timestamps), ids, one(v.end))
    nothing = F.when(norm_end >= WINDOW, one(v.start, v.no_timestamps, v.no_speech, v.end)).when(
        ~only_no_ts & timed, F.concat(one(v.start, v.first_time), F.array(ending, ending), one(v.end))).otherwise(bare(F.array().cast("array<int>")))
    beyond = norm_end > WINDOW
    own = F.when(beyond & (F.size(captions) > 1), F.slice(captions, F.lit(1), F.greatest(F.size(captions) - 1, F.lit(1)))).otherwise(captions)
    marked = F.flatten(F.transform(own, lambda c: F.concat(F.array(time_token(c.start, v)), c.ids, F.array(time_token(c.end, v)))))
    plain = bare(F.flatten(F.transform(own, lambda c: c.ids)))
    fits = F.forall(own, lambda c: (c.start <= WINDOW) & (c.end <= WINDOW))
    speech = F.when(timed & ts_mode & ~only_no_ts & ~beyond & fits, F.concat(one(v.start), marked, F.array(ending), one(v.end))).otherwise(plain)
    return F.when(F.size(captions) == 0, nothing).otherwise(speech)


def padded(ids: Column, length: int = CONTEXT, pad: int = Vocabulary.pad) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def teacher_forcing(ids: Column) -> tuple[Column, Column]:
    """Inputs (all ids but the last) and targets (all but the first), padded."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return padded(F.slice(ids, F.lit(1), n)), padded(F.slice(ids, F.lit(2), n))


def sequence_faults(ids: Column, length: int = CONTEXT, vocabulary: int = Vocabulary.pad) -> Column:
    """Names of what is wrong with a sequence: too long to be an input, or an id that no vocabulary has."""
    faults = F.array(F.when(F.size(ids) - 1 > length, "too long"), F.when(F.array_max(ids) >= vocabulary, "unknown id"))
    return F.array_compact(faults)
