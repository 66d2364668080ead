"""Lookups, positional pairing and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def lookup(rows: DataFrame, mapping: DataFrame, key: str, value: str, default) -> DataFrame:
    """``rows`` with the mapping's value, ``default`` where it has none; rows without a key get null. Spark picks the join."""
    joined = rows.join(mapping.select(key, value), key, "left")
    return joined.withColumn(value, F.when(F.col(key).isNotNull(), F.coalesce(value, F.lit(default))))


def missing(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(mapping, key, "left_anti")


def majority(votes: DataFrame, key: str, value: str, order: str, content: str | None = None) -> DataFrame:
    """The commonest value of each key, the first met among equals; with ``content``, votes on null or empty content don't count."""
    counts = (votes.where(F.col(content) != "") if content else votes).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first")).alias("f"), value))
    return counts.groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", "b.n")


def pair_positions(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The n-th row of ``left`` with the n-th of ``right`` in each key; a short right side gives an empty text, and a key
    with more right than left rows is dropped whole."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda df, name: df.select(key, F.row_number().over(w).alias("n"), F.col(value).alias(name))
    pairs = number(left, "ref").join(number(right, "hyp"), [key, "n"], "full")
    bad = pairs.where(F.col("ref").isNull()).select(key).distinct()
    return pairs.join(bad, key, "left_anti").withColumn("hyp", F.coalesce("hyp", F.lit("")))


def merge_maps(entries: DataFrame) -> DataFrame:
    """(id, lang) of map entries (id, lang, f); of an id in several maps that of the last map name counts."""
    return entries.groupBy("id").agg(F.max_by("lang", "f").alias("lang"))
