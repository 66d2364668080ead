"""Transcript files and record shards as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import machine_text, plain_text
from ..functions.timecode import to_ms
from ..operators.joins import merge_maps


def captions(content: Column) -> Column:
    """Captions (start, end, text) of WebVTT or SRT text, in file order; blocks without a time line are skipped."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), "^﻿", ""), r"\n[ \t]*\n")
    timed = F.filter(blocks, lambda b: b.contains("-->"))
    line = r"(?s)^(?:.*?\n)?[ \t]*([0-9:.,]+)[ \t]+-->[ \t]+([0-9:.,]+)[^\n]*\n?(.*)$"
    # each block is searched once for each part, however often a part is looked at
    parts = F.transform(timed, lambda b: F.struct(F.regexp_extract(b, line, 1).alias("a"), F.regexp_extract(b, line, 2).alias("b"), F.regexp_extract(b, line, 3).alias("t")))
    parsed = F.transform(parts, lambda p: F.struct(
        to_ms(p.a).alias("start"), to_ms(p.b).alias("end"), F.regexp_replace(F.rtrim(F.regexp_replace(p.t, r"\n+$", "")), r"<[^<>\n]*>", "").alias("text")))
    return F.filter(parsed, lambda c: c.start.isNotNull() & c.end.isNotNull())


def segment_text(content: Column, machine: bool = False) -> Column:
    """Text of a segment's subtitles; null or unreadable content is empty. ``machine``: of rolling machine captions."""
    texts = F.transform(captions(F.coalesce(content, F.lit(""))), lambda c: c.text)
    return F.trim(machine_text(texts, True)) if machine else plain_text(texts)


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Document records of transcript files below ``path``: id (the name up to its first dot), subtitle_file, content, captions, length (s), failed."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{vtt,srt}").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    docs = raw.select(F.substring_index(name, ".", 1).alias("id"), F.col("_metadata.file_path").alias("subtitle_file"), F.col("value").alias("content"), captions(F.col("value")).alias("captions"))
    span = F.element_at("captions.end", -1) - F.element_at("captions.start", 1)
    return docs.withColumn("length", F.when((F.size("captions") > 0) & (span > 0), span / 1000).otherwise(0.0)).withColumn("failed", F.size("captions") == 0)


def write_subtitles(segment_captions: Column, begin: Column, kind: str = "vtt") -> Column:
    """Text of a subtitle file with times from ``begin`` on."""
    from ..functions.timecode import from_ms

    stamp = lambda t: F.replace(from_ms(t - begin), F.lit("."), F.lit(",")) if kind == "srt" else from_ms(t - begin)
    number = lambda i: F.concat((i + 1).cast("string"), F.lit("\n")) if kind == "srt" else F.lit("")
    body = F.array_join(F.transform(segment_captions, lambda c, i: F.concat(number(i), stamp(c.start), F.lit(" --> "), stamp(c.end), F.lit("\n"), c.text, F.lit("\n\n"))), "")
    return F.concat(F.lit("WEBVTT\n\n" if kind == "vtt" else ""), body)


def flatten_samples(rows: DataFrame, nested: str = "sample_dicts") -> DataFrame:
    """Records that hold an array of records become those; null entries go."""
    return rows.select(F.explode(nested).alias("r")).where("r is not null").select("r.*")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Record shards (plain, gzip, zstd), with the shard's number from its name; the schema is given, never inferred."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.jsonl", 1).cast("int"))


def read_language_maps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, lang) of ``{id: lang}`` files; of an id in several files the last file by name wins."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.col("_metadata.file_path").alias("f"), F.explode(F.from_json("value", "map<string,string>")).alias("id", "lang"))
    return merge_maps(pairs)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "gzip").json(path)
