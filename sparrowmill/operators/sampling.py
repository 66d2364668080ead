"""Deterministic samples by hash order, and exact percentiles without a single-task sort."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def per_shard(rows: DataFrame, shard: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows of each shard, all if it has fewer; the window keeps k rows a task before the shuffle."""
    order = Window.partitionBy(shard).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def overall(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """An exact sample of ``k`` rows of the whole table (a top-k by hash, not a global sort)."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(k)


def percentiles(rows: DataFrame, value: str, partitions: int) -> DataFrame:
    """(percentile, value) for 0..99 at rank min(round-half-even(p * n / 100), n - 1), and 100, the maximum.

    Equal values are counted first, so that ties are one row; distinct values are dealt to ranges between approximate
    quantiles, and ranks come from the counts of the ranges and a running count within each. Nulls are left out.
    """
    own = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return percentiles_of_counts(own, partitions)


def percentiles_of_counts(own: DataFrame, partitions: int) -> DataFrame:
    """``percentiles`` of values that were counted before: (v, n), each value once."""
    cuts = own.agg(F.percentile_approx("v", [k / partitions for k in range(1, partitions)])).first()[0] if partitions > 1 else None
    # a value's range by binary search over the cuts, told as the runs between them
    span = search(F.col("v"), sorted(set(cuts))) if cuts else F.lit(0)
    dealt = own.withColumn("p", span)
    counts = dealt.groupBy("p").agg(F.sum("n").alias("held"))
    starts = counts.select("p", (F.sum("held").over(Window.orderBy("p")) - F.col("held")).alias("start"), F.sum("held").over(Window.partitionBy(F.lit(0))).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(starts), "p").select("v", "total", (F.col("start") + F.col("upto") - F.col("n")).alias("low"), (F.col("start") + F.col("upto")).alias("high"))
    at = lambda i: F.least(F.bround(i * F.col("total") / 100.0).cast("long"), F.col("total") - 1)
    # only percentiles around a value's ranks are looked at
    near = F.sequence(F.greatest(F.floor(F.col("low") * 100 / F.col("total")) - 1, F.lit(0)), F.least(F.ceil(F.col("high") * 100 / F.col("total")) + 1, F.lit(99)))
    held = F.filter(near, lambda i: (at(i) >= F.col("low")) & (at(i) < F.col("high")))
    last = F.when(F.col("high") == F.col("total"), F.array(F.lit(100).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return ranked.select("v", F.explode(F.concat(held, last)).alias("i")).select(F.col("i").cast("int").alias("percentile"), F.col("v").alias("value"))


def search(value: Column, cuts: list) -> Column:
    """How many of ``cuts`` (sorted) lie below ``value``: a tree of comparisons, as deep as the logarithm of their number."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(value > cuts[mid], search(value, cuts[mid + 1 :]) + (mid + 1)).otherwise(search(value, cuts[:mid]))


def poisson(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) draws, a row for each key and a column for each replicate, fixed by key and replicate number."""
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(25)])
    z = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(chances, (z >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap_means(df: DataFrame, key: list[str], value: str, weight: str, replicates: int = 1000, by: str | None = None) -> DataFrame:
    """b and the weighted mean of each Poisson resample of ``df``, or of each of its groups ``by``; a resample without weight has a null mean.

    Rows are folded into a pair of sums for each replicate (and group of the batch) inside the tasks. Rows without value
    or weight are left out.
    """
    arrow = pa.schema([("s", pa.string()), ("b", pa.int32()), ("total", pa.float64()), ("weight", pa.float64())])

    def sums_of(group, total, weights):
        return pa.RecordBatch.from_arrays([pa.array([group] * replicates, pa.string()), pa.array(range(replicates), pa.int32()), pa.array(total), pa.array(weights)], schema=arrow)

    def fold(batches):
        held: dict[str | None, list] = {}
        for b in batches:
            groups, (k, v, w) = np.array(b.column(0).to_pylist(), object), (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            for g in dict.fromkeys(groups.tolist()):
                mine = np.flatnonzero(groups == g) if g is not None else np.flatnonzero([x is None for x in groups])
                total, weights = held.setdefault(g, [np.zeros(replicates), np.zeros(replicates)])
                for at in range(0, len(mine), 1024):
                    own = mine[at : at + 1024]
                    drawn = poisson(k[own], replicates)
                    total += (v[own] * w[own]) @ drawn
                    weights += w[own] @ drawn
                if len(held) > 64:
                    yield from (sums_of(x, *pair) for x, pair in held.items())
                    held.clear()
        yield from (sums_of(x, *pair) for x, pair in held.items())

    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(F.col(by).cast("string") if by else F.lit(""), F.xxhash64(*key), F.col(value).cast("double"), F.col(weight).cast("double"))
    sums = rows.mapInArrow(fold, "s string, b int, total double, weight double").groupBy("s", "b").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    return sums.select("b", F.try_divide("total", "weight").alias("mean"))


def error_bars(means: DataFrame) -> DataFrame:
    """n_bootstrap, mean, population std_dev and std_err of the means that are not null."""
    spread = F.stddev_pop("mean")
    return means.agg(F.count("mean").alias("n_bootstrap"), F.round(F.avg("mean"), 6).alias("mean"), F.round(spread, 6).alias("std_dev"), F.round(F.try_divide(spread, F.sqrt(F.count("mean"))), 6).alias("std_err"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with a seeded ``position`` key; sort by it for a reproducible order."""
    return rows.withColumn("position", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))


def reader_share(rows: DataFrame, key: str, rank: int, world: int, seed: int = 42) -> DataFrame:
    """The rows that reader ``rank`` of ``world`` takes: every row has one reader, whatever the partitions."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(world)) == rank)


def drawn(key: Column, seed: int = 42) -> Column:
    """A fair draw, fixed by the key."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 1) < "8"
