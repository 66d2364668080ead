"""What a run leaves behind: shards under their own names with their statistics, reports, dead letters and maps, all moved into place together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators import segments
from . import committed


def part(rows: DataFrame, name: Column | str, line: Column, order: Column | None = None) -> DataFrame:
    """Lines of named files: (name, order, line); ``order`` sorts within a file, as text."""
    named = F.lit(name) if isinstance(name, str) else name
    return rows.select(named.cast("string").alias("name"), (F.lit("") if order is None else order.cast("string")).alias("order"), line.cast("string").alias("line"))


def routed(rows: DataFrame, *routes: tuple) -> DataFrame:
    """As ``part``, for several files from one pass over ``rows``: each route is (name, line, order), and a row goes wherever the name is not null."""
    text = lambda c: (F.lit(c) if isinstance(c, str) else F.lit("") if c is None else c).cast("string")
    ways = F.array(*(F.when(text(n).isNotNull(), F.struct(text(n).alias("name"), text(o).alias("order"), text(line).alias("line"))) for n, line, o in routes))
    return rows.select(F.explode(F.array_compact(ways)).alias("r")).select("r.*")


def letter(key: Column | str, stage: str, reason: Column | str, n: Column | int = 1) -> Column:
    """A dead letter (id, stage, reason, n) as a line."""
    named = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.to_json(F.struct((F.col(key) if isinstance(key, str) else key).cast("string").alias("id"), F.lit(stage).alias("stage"), named(reason).alias("reason"), named(n).alias("n")))


class Report:
    """Counters of a run's stages, taken while the rows pass on their way to the sinks: no stage is scanned again for them."""

    def __init__(self):
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """``rows``, with sums of ``counters`` (numbers or conditions) and the number of rows; to be used in one action."""
        seen = Observation(f"{stage}-{len(self.seen)}")
        self.seen.append((stage, seen))
        sums = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in counters.items()]
        return rows.observe(seen, F.count(F.lit(1)).cast("double").alias("rows"), *sums)

    def rows(self) -> list[tuple[str, str, float]]:
        """(stage, counter, value), for when the action is over."""
        return [(stage, k, v) for stage, seen in self.seen for k, v in seen.get.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "stage string, counter string, value double")

    def text(self) -> str:
        return "".join(f"{stage} {k}: {v:g}\n" for stage, k, v in self.rows())


def numbered(name: Column, number: Column) -> Column:
    """``kept.jsonl.gz`` and 3 as ``kept-00003.jsonl.gz``."""
    return F.regexp_replace(name, r"^((?:.*/)?[^./]+)", F.concat(F.lit("$1-"), F.format_string("%05d", number)))


def file_of(name: Column) -> Column:
    """What ``numbered`` numbered."""
    return F.regexp_replace(name, r"-\d{5,}(\.[^/]*)?$", "$1")


def write_parts(path: str, *parts: DataFrame, overwrite: bool = False, split: bool = False) -> None:
    """All lines of all parts in one job; files whose names end in .gz are gzipped.

    A file is written by one task. ``split``, for files that grow with the input: every task writes its own rows of a file
    as a numbered part (``file_of`` gives the file), in order within the part, and nothing is shuffled.
    """
    lines = reduce(DataFrame.unionByName, parts)
    if split:
        own = lines.select(numbered(F.col("name"), F.spark_partition_id()).alias("name"), "order", "line")
        committed.save(own.sortWithinPartitions("name", "order").select("name", "line"), path, "lines", overwrite)
        return
    committed.save(lines.repartition("name").sortWithinPartitions("name", "order").select("name", "line"), path, "lines", overwrite)


def record(rows: DataFrame, *but: str) -> Column:
    return F.to_json(F.struct(*(c for c in rows.columns if c not in but)))


def shard_name(shard: str, pattern: str) -> Column:
    """``pattern`` with the shard's number; rows without one go to a file of their own."""
    return F.when(F.col(shard).isNull(), F.lit(pattern.replace("%05d", "none"))).otherwise(F.format_string(pattern, shard))


def write_tagged(tagged: DataFrame, stats: DataFrame, path: str, shard: str = "shard", key: str = "id", overwrite: bool = False) -> None:
    """Tagged records as ``shard_NNNNN.jsonl.gz`` in order of ``key``, with the shard's statistics (shard, tag, stat, value) as ``shard_NNNNN_stats.json``."""
    lines = part(tagged, shard_name(shard, "shard_%05d.jsonl.gz"), record(tagged, shard), F.col(key))
    write_parts(path, lines, part(stats, shard_name(shard, "shard_%05d_stats.json"), record(stats, shard), F.concat_ws("|", "tag", "stat")), overwrite=overwrite)


def write_segments(table: DataFrame, path: str, shard: str = "shard", overwrite: bool = False) -> None:
    """Segments of a written ``segment_table`` with its shards: ``shard_seg_NNNNN.jsonl.gz`` in order of document and segment,
    ``shard_seg_NNNNN_stats.json`` with the counters, ``segment_stats.log`` with their sums, ``dead_letters.jsonl.gz``."""
    kept = table.where("seg_no IS NOT NULL").drop(*segments.COUNTERS, "reason")
    letters = segments.dead_letters(table)
    by_shard, whole = segments.counters(table, shard), segments.counters(table)
    log = whole.select(F.posexplode(F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in whole.columns))).alias("i", "said"))
    write_parts(
        path, part(kept, shard_name(shard, "shard_seg_%05d.jsonl.gz"), record(kept, shard), F.format_string("%s|%08d", "id", "seg_no")),
        part(by_shard, shard_name(shard, "shard_seg_%05d_stats.json"), record(by_shard, shard)),
        part(log, "segment_stats.log", F.col("said"), F.lpad(F.col("i").cast("string"), 3, "0")), part(letters, "dead_letters.jsonl.gz", record(letters), F.concat_ws("|", "id", "reason")), overwrite=overwrite)


def write_map(rows: DataFrame, path: str, key: str = "id", value: str = "lang", per_file: int = 100_000, overwrite: bool = False) -> None:
    """``{key: value}`` objects, about ``per_file`` entries a file: maps that the map reader merges. Keys have to differ."""
    files = max(1, -(-rows.count() // per_file))
    entries = rows.where(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value).cast("string")))))).alias("m"))
    write_parts(path, part(entries, F.format_string("map_%05d.json.gz", "n"), F.col("m")), overwrite=overwrite)
