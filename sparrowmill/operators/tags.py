"""Quality tags of documents: name -> column builder over the caption array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, wer
from .language import language_of

TAGS = {
    "casing": lambda c: T.casing(T.casing_counts(c)),
    "repeating_lines": T.repeating_lines,
    "has_comma_period": T.has_comma_period,
    "has_proper_cap_after_punct_line": T.capital_after_stop,
    "num_words": T.word_count,
    "text_lang": lambda c: T.text_language(T.plain_text(c)),
}
#: Tags that also need the machine captions (null: none).
PAIR_TAGS = {"edit_dist": lambda c, m: edit_distance(T.plain_text(c), T.machine_text(m, keep_first=False))}


def edit_distance(manual: Column, machine: Column) -> Column:
    return wer.distance_ladder(manual, machine, T.normalise(manual), T.normalise(machine))


def tag(docs: DataFrame, names: list[str], captions: str = "captions", machine: str = "mach_captions", profiles: dict | None = None) -> DataFrame:
    """``docs`` with one column for each tag; an unknown tag is an error. ``profiles``: learned languages for text_lang, else its word lists decide."""
    if unknown := [n for n in names if n not in TAGS | PAIR_TAGS]:
        raise ValueError(f"unknown tags: {unknown}")
    no_captions = F.array().cast("array<string>")
    other = F.coalesce(F.col(machine), no_captions) if machine in docs.columns else no_captions
    own = TAGS | ({"text_lang": lambda c: language_of(T.plain_text(c), profiles)} if profiles else {})
    return docs.withColumns({n: own[n](F.col(captions)) if n in own else PAIR_TAGS[n](F.col(captions), other) for n in names})


def tag_segments(rows: DataFrame, manual: str = "seg_text", machine: str = "mach_seg_text") -> DataFrame:
    """Segments with seg_num_words and seg_edit_dist; null texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.withColumns({"seg_num_words": F.size(T.words(text(manual))).cast("long"), "seg_edit_dist": edit_distance(text(manual), text(machine))})


def from_config(docs: DataFrame, steps: list[dict], profiles: dict | None = None) -> DataFrame:
    """The tags that a configuration's steps name; whatever else a step has is handed to the tag."""
    for s in steps:
        docs = tag(docs, [s["tag"]], profiles=profiles, **{k: v for k, v in s.items() if k != "tag"})
    return docs


def stat_rows(rows: DataFrame, stats: dict[str, tuple[str, Column]], shard: str) -> DataFrame:
    """(shard, tag, stat, total, n): sums of each statistic and the number of rows, so that shards add up.

    ``stats``: name of the statistic -> (tag, its value for a row).
    """
    wide = rows.groupBy(shard).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(v, F.lit(0)).cast("double")).alias(k) for k, (_, v) in stats.items()))
    entries = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(k).alias("stat"), F.col(f"`{k}`").alias("total")) for k, (t, _) in stats.items()))
    return wide.select(shard, "n", F.explode(entries).alias("e")).select(shard, "e.*", "n")


def rolled_up(stats: DataFrame, *by: str) -> DataFrame:
    """(tag, stat, value) over all shards or ``by``: durations and other statistics are sums, counts are means over rows, named avg."""
    is_count = F.col("stat").contains("count") & ~F.col("stat").contains("dur")
    whole = stats.groupBy(*by, "tag", "stat").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return whole.select(*by, "tag", F.when(is_count, F.replace("stat", F.lit("count"), F.lit("avg"))).otherwise(F.col("stat")).alias("stat"), F.when(is_count, F.col("total") / F.col("n")).otherwise(F.col("total")).alias("value"))


def tag_stats(tagged: DataFrame, shard: str) -> DataFrame:
    """Long-form counts (shard, tag, stat, value); averages are made of them at the end, so shards add up."""
    stats = {
        ("casing", k): F.sum((F.col("casing") == k).cast("long")) for k in ("upper", "lower", "mixed")
    } | {("repeating_lines", "count"): F.sum(F.col("repeating_lines").cast("long")), ("num_words", "total"): F.sum("num_words")}
    wide = tagged.groupBy(shard).agg(*(v.alias(f"{t}|{s}") for (t, s), v in stats.items()))
    entries = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(s).alias("stat"), F.col(f"{t}|{s}").alias("value")) for t, s in stats))
    return wide.select(shard, F.explode(entries).alias("e")).select(shard, "e.tag", "e.stat", "e.value")
