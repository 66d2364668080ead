"""Rules over decoder output: skipping, falling back, anomalies, slicing by time tokens, tidying of chunks; small audio helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import FILLER, join_lines, strip_foreign

#: Fixed thresholds of the decoding rules.
NO_SPEECH, LOG_PROBABILITY, COMPRESSION = 0.6, -1.0, 2.4
IMPROBABLE, SHORT_WORD, LONG_WORD, FIRST_WORDS = 0.15, 0.133, 2.0, 8
#: Signs that are no words (fixed list).
PUNCTUATION = list("\"'“¿([{-") + list("\"'.。,，!！?？:：”)]}、")


def skipped(no_speech: Column, log_probability: Column) -> Column:
    """Silence that the text's own probability doesn't speak against."""
    return (no_speech > NO_SPEECH) & ~(log_probability > LOG_PROBABILITY)


def falls_back(compression: Column, log_probability: Column, no_speech: Column) -> Column:
    """Too repetitive or improbable, unless it is silence."""
    return ((compression > COMPRESSION) | (log_probability < LOG_PROBABILITY)) & ~((no_speech > NO_SPEECH) & (log_probability < LOG_PROBABILITY))


def first_good_attempt(attempts: DataFrame, key: str, temperature: str) -> DataFrame:
    """Of each key's attempts (compression_ratio, avg_logprob, no_speech_prob) the coolest that doesn't fall back, else the hottest."""
    bad = falls_back(F.col("compression_ratio"), F.col("avg_logprob"), F.col("no_speech_prob"))
    whole = F.struct(*attempts.columns)
    best = F.coalesce(F.min_by(whole, F.when(~bad, F.col(temperature))), F.max_by(whole, F.col(temperature)))
    return attempts.groupBy(key).agg(best.alias("best")).select("best.*")


def word_score(word: Column) -> Column:
    """How odd a word (start, end, probability) is: improbable, very short or very long."""
    length = word.end - word.start
    odd = F.when(F.coalesce(word.probability, F.lit(0.0)) < IMPROBABLE, 1.0).otherwise(0.0)
    return odd + F.when(length < SHORT_WORD, (SHORT_WORD - length) * 15).otherwise(0.0) + F.when(length > LONG_WORD, length - LONG_WORD).otherwise(0.0)


def segment_odd(words: Column) -> Column:
    """Whether the first words, signs left out, are odd together; no words, not odd."""
    own = F.slice(F.filter(words, lambda w: ~w.word.isin(PUNCTUATION)), 1, FIRST_WORDS)
    score = F.aggregate(own, F.lit(0.0), lambda s, w: s + word_score(w))
    return F.coalesce((F.size(words) > 0) & ((score >= 3) | (score + 0.01 >= F.size(own))), F.lit(False))


def cleared(segment: Column, start: str = "start", end: str = "end", text: str = "text", lists: tuple[str, ...] = ("tokens", "words")) -> Column:
    """A segment that is instantaneous or blank loses its text and lists."""
    blank = (segment[start] == segment[end]) | (F.trim(segment[text]) == "")
    fields = {text: F.when(blank, "").otherwise(segment[text])} | {k: F.when(blank, F.slice(segment[k], 1, 0)).otherwise(segment[k]) for k in lists}
    for name, value in fields.items():
        segment = segment.withField(name, value)
    return segment


def spoken(chunks: Column) -> Column:
    """Chunks (start, end, text) up to the first that only repeats a filler; blank ones go, line ends within texts too, and
    a closing "foreign" leaves the last one."""
    fillers = F.transform(chunks, lambda c: F.trim(c.text).rlike(FILLER))
    first = F.array_position(fillers, True)
    own = F.when(first > 0, F.slice(chunks, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0)))).otherwise(chunks)
    tidy = F.transform(F.filter(own, lambda c: F.trim(c.text) != ""), lambda c: c.withField("text", F.trim(join_lines(F.trim(c.text)))))
    return F.transform(tidy, lambda c, i: F.when(i == F.size(tidy) - 1, c.withField("text", strip_foreign(c.text))).otherwise(c))


def time_slices(tokens: Column, first_time: int = 50363) -> Column:
    """Slices (start, end as numbers of time tokens; tokens) of decoder output, cut between neighbouring time tokens.

    A single time token at the end closes the last slice; tokens after the last cut are left for the next window. Without
    a cut all tokens are one slice from 0 to the last time token, or to null if there is none but the first.
    """
    n = F.size(tokens)
    is_time = lambda i: F.get(tokens, i) >= first_time
    inner = F.filter(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: is_time(i) & is_time(i - 1))
    single = F.coalesce((n > 1) & is_time(n - 1) & ~is_time(n - 2), F.lit(False))
    cuts = F.when((F.size(inner) > 0) & single, F.concat(inner, F.array(n))).otherwise(inner)
    starts = F.concat(F.array(F.lit(0)), F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))))
    part = lambda a, b: F.struct((F.get(tokens, a) - first_time).alias("start"), (F.get(tokens, b - 1) - first_time).alias("end"), F.slice(tokens, a + 1, b - a).alias("tokens"))
    times = F.filter(tokens, lambda t: t >= first_time)
    last = F.when(F.size(times) > 0, F.nullif(F.get(times, F.size(times) - 1) - first_time, F.lit(0)))
    whole = F.array(F.struct(F.lit(0).alias("start"), last.cast("int").alias("end"), tokens.alias("tokens")))
    return F.when(F.size(cuts) > 0, F.zip_with(starts, cuts, part)).otherwise(whole)


def mono(channels: Column) -> Column:
    """The mean of channels (array of equally long arrays of samples)."""
    zero = F.transform(F.get(channels, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(channels, zero, lambda s, c: F.zip_with(s, c, lambda a, b: a + b)), lambda x: x / F.size(channels))


def peak_normalised(samples: Column) -> Column:
    """Samples by the largest magnitude; silence stays."""
    top = F.array_max(F.transform(samples, F.abs))
    return F.transform(samples, lambda x: F.when(top > 0, x / top).otherwise(x))


def from_pcm(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / 32768.0)


def trimmed_audio(samples: Column, length: int = 480_000) -> Column:
    """Cut or filled with silence to ``length``."""
    own = F.slice(samples, 1, length)
    return F.concat(own, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(own)))


def learning_rate(step: Column, steps: int) -> Column:
    """Share of the full rate: a rise over the first 0.2 %, then a straight fall."""
    rise = -(-2 * steps // 1000)
    return F.when(step < rise, step / max(1, rise)).otherwise(F.greatest(F.lit(0.0), (F.lit(steps) - step) / max(1, steps - rise)))


def audio_minutes_a_second(samples: Column, seconds: Column, rate: int = 16_000) -> Column:
    return F.try_divide(samples / rate / 60, seconds)
