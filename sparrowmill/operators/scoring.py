"""Corpus scores over (reference, hypothesis) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, wer
from .sampling import bootstrap_means, error_bars

#: References that mark a stretch that is not scored (fixed value).
IGNORED = "ignore time segment in scoring"


def valid_references(pairs: DataFrame, ref: str = "ref", long_form: bool = False) -> DataFrame:
    """Pairs whose normalised reference has text; short ones also leave out what is marked as not scored."""
    fine = F.col(ref) != ""
    return pairs.where(fine if long_form else fine & (F.col(ref) != IGNORED))


def pair_scores(pairs: DataFrame, ref: Column, hyp: Column, kinds: bool = True) -> DataFrame:
    """``pairs`` with ref_words, ref_chars, edits and wer of each pair; with ``kinds`` also subs, dels and ins, by alignment, else edits by the native distance."""
    r, h = T.words(ref), T.words(hyp)
    rows = pairs.withColumns({"ref_words": F.size(r).cast("long"), "ref_chars": F.length(ref).cast("long")})
    if kinds:
        rows = rows.withColumn("counts", wer.alignment(r, h)).select("*", "counts.*").drop("counts").withColumn("edits", F.col("subs") + F.col("dels") + F.col("ins"))
    else:
        rows = rows.withColumn("edits", wer.word_edits(r, h))
    return rows.withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).when(F.col("edits") == 0, 0.0))


def corpus_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Word error rate in percent from summed edits, the totals of each kind of edit, and the mean rate weighted by words and by characters."""
    total = lambda c: F.sum(c).alias(c)
    weighted = lambda c: F.try_divide(F.sum(F.col("wer") * F.col(c)), F.sum(c))
    found = [c for c in ("ref_words", "edits", "subs", "dels", "ins") if c in scored.columns]
    return scored.groupBy(*by).agg(
        F.count("*").alias("pairs"), *map(total, found), F.try_divide(F.sum("edits") * 100, F.sum("ref_words")).alias("wer"),
        weighted("ref_words").alias("by_words"), weighted("ref_chars").alias("by_chars"))


def over_sets(corpus: DataFrame, value: str = "wer") -> DataFrame:
    """Plain mean and best of the sets' rates."""
    return corpus.agg(F.count(value).alias("sets"), F.avg(value).alias("mean"), F.min(value).alias("best"))


def overall_bars(scored: DataFrame, by: str, key: list[str], replicates: int = 1000) -> DataFrame:
    """Error bars over several sets: every set is resampled for itself, all in one pass, and the means of all sets are taken together."""
    return error_bars(bootstrap_means(scored, key, "wer", "ref_words", replicates, by))


def unweighted_bars(scored: DataFrame, key: list[str], replicates: int = 1000) -> DataFrame:
    """mean and std_dev of plain resample means; the error is by the number of pairs, not of resamples."""
    n = scored.where("wer is not null").count()
    means = bootstrap_means(scored.withColumn("one", F.lit(1)), key, "wer", "one", replicates)
    bars = error_bars(means)
    return bars.withColumn("std_err", F.round(F.try_divide(F.col("std_dev"), F.sqrt(F.lit(n))), 6))
