"""Evaluation sets as (audio, text) rows, one reader for each transcript layout; ``load`` picks one by name.

Empty files give no rows; lines with too few fields have null texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import clean_dialect
from ..operators.align import join_all


def load(spark: SparkSession, layout: str, path: str | list[str], root: str = "") -> DataFrame:
    if layout not in READERS:
        raise ValueError(f"unknown layout {layout!r}; there are {sorted(READERS)}")
    return READERS[layout](spark, path, root)


def _under(root: str, *parts: Column) -> Column:
    return F.concat_ws("/", *([F.lit(root)] if root else []), *parts)


def _fields(spark: SparkSession, path, sep: str, header: bool, quote: str = "") -> DataFrame:
    """The fields of each line by position: ``c0``, ``c1`` and so on."""
    rows = spark.read.csv(path, sep=sep, header=header, quote=quote, escape='"')
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))


def chapters(spark: SparkSession, path, root: str) -> DataFrame:
    """Lines ``<reader>-<chapter>-<n> text``; audio lies below reader and chapter."""
    line = F.split("value", " ", 2)
    part = F.split(line[0], "-")
    rows = spark.read.text(path).where("value <> ''").withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    found = rows.select(_under(root, part[0], part[1], F.concat(line[0], F.lit(".flac"))).alias("audio"), F.get(line, F.lit(1)).alias("text"), "at")
    # of several lines of one path the last one counts
    return found.groupBy("audio").agg(F.max_by("text", "at").alias("text"))


def table(header: bool, audio: int, text: int, sep: str = "\t", quote: str = "", ext: str = "") -> Callable:
    """A reader of delimited files by the positions of its two columns."""

    def read(spark: SparkSession, path, root: str) -> DataFrame:
        rows = _fields(spark, path, sep, header, quote)
        return rows.select(_under(root, F.concat(f"c{audio}", F.lit(ext))).alias("audio"), F.col(f"c{text}").alias("text"))

    return read


def json_lines(spark: SparkSession, path, root: str) -> DataFrame:
    rows = spark.read.schema("audio string, text string").json(path)
    return rows.select(_under(root, F.col("audio")).alias("audio"), "text")


def dialect(spark: SparkSession, path, root: str) -> DataFrame:
    """Quoted CSV of dialect transcripts: file name, folder in column 4, text in column 7, cleaned for scoring."""
    rows = _fields(spark, path, ",", True, '"')
    return rows.select(_under(root, F.lower("c4"), F.col("c0")).alias("audio"), clean_dialect(F.col("c7")).alias("text"))


def meetings(spark: SparkSession, path, root: str) -> DataFrame:
    """Lines ``id text``; audio lies below the id's second part, in lower case."""
    line = F.split("value", " ", 2)
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(_under(root, F.get(F.split(line[0], "_"), F.lit(1)), F.concat(F.lit("eval_"), F.lower(line[0]), F.lit(".wav"))).alias("audio"), F.get(line, F.lit(1)).alias("text"))


def json_arrays(spark: SparkSession, path, root: str) -> DataFrame:
    """Files that hold one array of records with ``audio_seg_file`` and ``words``."""
    rows = spark.read.schema("audio_seg_file string, words string").json(path, multiLine=True)
    return rows.select(_under(root, F.lit("segments"), F.col("audio_seg_file")).alias("audio"), F.col("words").alias("text"))


def keyed(spark: SparkSession, path, root: str) -> DataFrame:
    """Two files of lines ``id rest`` in one folder: ``text``, and ``wav.scp``, whose rest up to " |" is a command; an id without text is an error."""
    first, rest = F.substring_index(F.trim("value"), " ", 1), F.trim(F.regexp_replace(F.trim("value"), r"^\S+ ?", ""))
    read = lambda name, as_: spark.read.text(f"{path}/{name}").where("trim(value) <> ''").select(first.alias("utt_id"), rest.alias(as_))
    both = join_all(read("wav.scp", "command"), read("text", "text"), "utt_id")
    return both.select(F.substring_index("command", " |", 1).alias("audio"), "text")


def numbered(spark: SparkSession, path, root: str) -> DataFrame:
    """CSV with a header; the n-th row's audio is named by n in two digits, its text is column 5. One file, so one task numbers it."""
    rows = _fields(spark, path, ",", True, '"').withColumn("n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    return rows.select(_under(root, F.lit("audio"), F.format_string("%02d.m4a", "n")).alias("audio"), F.col("c5").alias("text"))


#: Which column of a published set holds the reference text (fixed values); the first that is there is taken.
TEXT_FIELDS = ("normalized_text", "raw_text", "text", "sentence", "transcription", "transcript")


def published(spark: SparkSession, path, root: str) -> DataFrame:
    """Parquet of a published set; the text's column goes by its name."""
    rows = spark.read.parquet(path)
    names = [c for c in TEXT_FIELDS if c in rows.columns]
    if not names:
        raise ValueError(f"no text among {rows.columns}")
    audio = F.col("audio.path") if isinstance(rows.schema["audio"].dataType, T.StructType) else F.col("audio")
    return rows.select(_under(root, audio).alias("audio"), F.coalesce(*names).alias("text"))


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(wer, ref_length) of each pair, as the scoring sink writes them."""
    return spark.read.schema("wer double, ref_length long").option("header", True).csv(path)


def stm(spark: SparkSession, path, root: str, prefix: str = "") -> DataFrame:
    """Scoring files: ``;;`` lines are comments, others count if they begin with ``prefix``; also start and end in seconds,
    text is what follows the last ``<tag>``."""
    part = F.split("value", " ")
    end = F.coalesce(*(F.nullif(F.get(part, F.lit(i)), F.lit("")) for i in (4, 5, 6)))
    rows = spark.read.text(path).where("value <> '' and not startswith(value, ';;')").where(F.col("value").startswith(prefix))
    return rows.select(
        _under(root, part[0]).alias("audio"), F.trim(F.element_at(F.split("value", "<[^>]+>"), -1)).alias("text"),
        F.get(part, F.lit(3)).try_cast("double").alias("start"), end.try_cast("double").alias("end"))


READERS: dict[str, Callable] = {
    "chapters": chapters,
    "tsv_header": table(True, 1, 2),
    "tsv_plain": table(False, 1, 2),
    "tsv_wav": table(True, 0, 1, ext=".wav"),
    "csv_dialect": dialect,
    "meetings": meetings,
    "json_arrays": json_arrays,
    "keyed": keyed,
    "numbered": numbered,
    "published": published,
    "json_lines": json_lines,
    "stm": stm,
}
