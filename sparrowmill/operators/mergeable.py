"""Samples and percentiles from states of shards that add up, so that a run only reads the shards that are new.

A shard's state is a small table: its rows of the least hashes for a sample, its values with their numbers for
percentiles. States of a shard that is read again replace the older ones; merged states give what one pass over all
shards gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import sampling


def sample_state(rows: DataFrame, shard: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows of each shard with the least hashes (``_h``), all if it has fewer. Tasks keep k rows a shard before the shuffle."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    order = Window.partitionBy(shard).orderBy("_h", key)
    return hashed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def merged_sample(state: DataFrame, key: str, k: int) -> DataFrame:
    """The sample of ``k`` rows of all shards, by a top-k of hashes; ``k`` may be smaller than that of the states."""
    return state.orderBy("_h", key).limit(k).drop("_h")


def value_state(rows: DataFrame, shard: str, value: str) -> DataFrame:
    """(shard, v, n): the values of each shard with their numbers; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(shard, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def merged_percentiles(state: DataFrame, partitions: int) -> DataFrame:
    return sampling.percentiles_of_counts(state.groupBy("v").agg(F.sum("n").alias("n")), partitions)


def keep(state: DataFrame, path: str, shard: str) -> None:
    """Adds the states of new shards to those in ``path``; a shard that is there already is replaced, others stay."""
    state.repartition(shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
