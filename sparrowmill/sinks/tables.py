"""Sinks: shards of JSON lines, tag maps, scores, and short text reports made of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_shards(rows: DataFrame, path: str, shard: str | None = None) -> bool:
    """JSON lines, gzipped, a folder for each shard; nothing is written where there are no rows (False)."""
    if rows.isEmpty():
        return False
    out = rows.write.option("compression", "gzip")
    (out.partitionBy(shard) if shard else out).json(path)
    return True


def tag_map(rows: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """(key, tags as one JSON object): what is appended beside shards that stay as they are."""
    return rows.select(key, F.to_json(F.struct(*tags)).alias("tags"))


def write_scores(scored: DataFrame, path: str) -> None:
    """wer and ref_length of each pair, as CSV with a header; the error-bar reader takes them."""
    scored.select("wer", F.col("ref_words").alias("ref_length")).write.option("header", True).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """JSON lines of a small or large table (statistics, error bars, resegmented utterances)."""
    rows.write.json(path)


def report(title: str, *tables: tuple[str, DataFrame]) -> str:
    """Text of small result tables (statistics, hit lists, survival): a heading and one line a row each."""
    lines = [title, "=" * len(title)]
    for name, table in tables:
        lines += ["", name]
        for r in table.collect():
            lines.append("  " + ", ".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()))
    return "\n".join(lines) + "\n"


def report_name(config: str | None, only_subsample: bool = False) -> str:
    """File name of a run's report: by its configuration's file, or what stands in for one."""
    if only_subsample:
        return "subsampled_stats.log"
    return f"{config.rsplit('/', 1)[-1].removesuffix('.yaml')}.log" if config else "processing_stats.log"


#: Columns that a row needs for training; all that a plain subsample keeps.
ESSENTIAL = ("id", "seg_id", "subtitle_file", "audio_file", "seg_content", "ts_mode", "only_no_ts_mode", "norm_end")


def essential(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in ESSENTIAL if c in rows.columns))
