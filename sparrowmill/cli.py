"""Command line: ``python -m sparrowmill.cli COMMAND ...`` (or through spark-submit); the commands are in ``run``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import filters, joins, language, sampling, scoring, segments, tags
from .session import scratch, session
from .sinks import outputs, tables
from .sources import evalsets, transcripts

DOCUMENT = "id string, subtitle_file string, audio_file string, content string, mach_content string, length double, audio_lang string, text_lang string, casing string, repeating_lines boolean, edit_dist double, seg_edit_dist double, seg_id string, seg_content string, mach_seg_content string"


def documents(spark: SparkSession, path: str, level: str = "document") -> DataFrame:
    """Records with their captions and machine captions, of the whole document or of the segment that a record is."""
    rows = transcripts.read_jsonl(spark, path, DOCUMENT)
    content, machine = ("seg_content", "mach_seg_content") if level == "segment" else ("content", "mach_content")
    timed = rows.withColumn("timed", transcripts.captions(F.coalesce(content, F.lit(""))))
    said = F.transform(transcripts.captions(F.coalesce(machine, F.lit(""))), lambda c: c.text)
    return timed.select(*rows.columns, "timed", F.col("timed.text").alias("captions"), said.alias("mach_captions"))


def tagged_shards(rows: DataFrame, config: str, path: str, profiles: dict | None = None) -> None:
    """Tags of a configuration with each shard's statistics; ``profiles``: learned text languages."""
    steps = filters.load_config(config)
    tagged = tags.from_config(rows, steps, profiles).drop(*PARTS)
    own = {s["tag"]: tagged.schema[s["tag"]].dataType.simpleString() for s in steps if s["tag"] in tagged.columns}
    stats = {f"{t}_count": (t, F.col(t).cast("long")) for t, kind in own.items() if kind == "boolean"} | {f"{t}_sum": (t, F.col(t)) for t, kind in own.items() if kind in ("bigint", "double", "int")}
    stats |= {f"{t}_{v}_count": (t, (F.col(t) == v).cast("long")) for t, kind in own.items() if kind == "string" for v in VALUES.get(t, ())}
    rolled = tags.rolled_up(tags.stat_rows(tagged, stats, "shard"), "shard") if stats else None
    if rolled is None:
        tables.write_shards(tagged, path, "shard")
    else:
        outputs.write_tagged(tagged, rolled, path)


def segment(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """Segments are made once and written, counted as they pass, then sorted into their files."""
    report, kept = outputs.Report(), scratch(spark, "segments")
    table = segments.segment_table(rows.select("id", F.col("timed").alias("captions")))
    watched = report.watch(table, "segment", **{c: F.col(c) for c in segments.COUNTERS})
    watched.join(rows.select("id", "shard").dropDuplicates(["id"]), "id", "left").write.parquet(kept)
    outputs.write_segments(spark.read.parquet(kept), path)
    return report.text()


def score(spark: SparkSession, source: str, path: str) -> str:
    report = outputs.Report()
    pairs = spark.read.schema("eval_set string, ref string, hyp string").json(source)
    ref, hyp = T.normalise_english(F.col("ref")), T.normalise_english(F.col("hyp"))
    watched = report.watch(pairs.withColumns({"ref": ref, "hyp": hyp}), "score", without_reference=F.coalesce(F.col("ref"), F.lit("")) == "", not_scored=F.col("ref") == scoring.IGNORED)
    scored = scoring.pair_scores(scoring.valid_references(watched), F.col("ref"), F.col("hyp"))
    tables.write_table(scoring.corpus_scores(scored, ["eval_set"]), path)
    return report.text()


def ingest(spark: SparkSession, source: str, path: str) -> str:
    """Records by shard, and dead letters of transcripts without captions, in one pass."""
    report = outputs.Report()
    found = transcripts.read_transcripts(spark, source).drop("captions")
    watched = report.watch(found, "ingest", failed=F.col("failed"), seconds=F.col("length"), characters=F.length("content"))
    sharded = watched.withColumn("shard", F.regexp_extract("subtitle_file", r"shard_(\d+)/", 1).try_cast("int"))
    name = outputs.shard_name("shard", "shard_%05d.jsonl.gz")
    bad = F.when(F.col("failed"), "failed_transcripts.jsonl.gz")
    outputs.write_parts(path, outputs.routed(sharded, (name, outputs.record(found), F.col("id")), (bad, outputs.letter("id", "ingest", "no captions"), F.col("id"))))
    return report.text()


def assign(spark: SparkSession, rows: DataFrame, maps: str, path: str) -> str:
    """Records with the languages of the maps, ``en`` where they say nothing; those are dead letters too."""
    report = outputs.Report()
    held = transcripts.read_language_maps(spark, maps).select("id", F.col("lang").alias("said"))
    own = rows.drop("audio_lang", *PARTS).join(held, "id", "left")
    missing = F.col("id").isNotNull() & F.col("said").isNull()
    watched = report.watch(own, "language", missing=missing).withColumn("audio_lang", F.when(F.col("id").isNotNull(), F.coalesce("said", F.lit("en"))))
    name = outputs.shard_name("shard", "shard_%05d.jsonl.gz")
    bad = F.when(missing, "missing_audio_lang.jsonl.gz")
    outputs.write_parts(path, outputs.routed(watched, (name, outputs.record(watched, "shard", "said"), F.col("id")), (bad, outputs.letter("id", "language", "missing"), F.col("id"))))
    return report.text()


#: Columns of ``documents`` that are parsed from the record, and values that statistics count.
PARTS = ("timed", "captions", "mach_captions")
VALUES = {"casing": ("upper", "lower", "mixed"), "text_lang": ("en",)}
#: Command -> its arguments besides --input, --output, --size and --seed.
COMMANDS = {
    "ingest": (), "learn": (), "tag": ("--config",), "filter": ("--config",), "segment": (), "sample": (), "score": (), "assign": ("--maps",), "vote": (), "reseg": (), "percentiles": ("--column",), "bars": (),
}


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> str | None:
    """ingest: transcripts to records. learn: language profiles of records (text, lang). tag (of --level document or segment, with
    learned --languages if given), filter, segment, sample: records by shard. assign: languages of maps. vote: a map
    from (id, lang) votes. reseg: utterances (utt_id, text) to segments. score: word error rates. percentiles: of a column of
    an overall sample of --size rows. bars: error bars of score files (wer, ref_length). ingest, assign, segment and score
    return their counters as text."""
    parser = argparse.ArgumentParser(prog="sparrowmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, texts in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag in ("--input", "--output", *texts):
            sub.add_argument(flag, required=True)
        sub.add_argument("--size", type=int, default=1000)
        sub.add_argument("--seed", type=int, default=42)
        sub.add_argument("--level", choices=("document", "segment"), default="document")
        sub.add_argument("--languages")
    args = parser.parse_args(argv)
    spark = spark or session()
    if args.command == "score":
        return score(spark, args.input, args.output)
    if args.command == "ingest":
        return ingest(spark, args.input, args.output)
    if args.command == "learn":
        return language.as_table(spark, language.learn(spark.read.schema("text string, lang string").json(args.input))).write.parquet(args.output)
    if args.command == "vote":
        votes = spark.read.schema("id string, seg_no long, content string, lang string").json(args.input)
        voted = joins.majority(votes, "id", "lang", "seg_no", "content")
        return outputs.write_map(voted, args.output)
    if args.command == "reseg":
        return tables.write_table(segments.pack_utterances(spark.read.schema("utt_id string, text string").json(args.input)), args.output)
    if args.command == "percentiles":
        rows = spark.read.schema(f"id string, {args.column} double").json(args.input)
        held = sampling.overall(rows, "id", args.size, args.seed)
        return tables.write_table(sampling.percentiles(held, args.column, int(spark.conf.get("spark.sql.shuffle.partitions"))), args.output)
    if args.command == "bars":
        scores = evalsets.read_scores(spark, args.input).withColumn("n", F.monotonically_increasing_id())
        return tables.write_table(sampling.error_bars(sampling.bootstrap_means(scores, ["n"], "wer", "ref_length")), args.output)
    rows = documents(spark, args.input, args.level)
    if args.command == "tag":
        tagged_shards(rows, args.config, args.output, language.from_table(spark.read.parquet(args.languages)) if args.languages else None)
    elif args.command == "assign":
        return assign(spark, rows, args.maps, args.output)
    elif args.command == "filter":
        kept = filters.with_hit(rows, filters.load_config(args.config)).where("hit = 'pass'").drop("hit", *PARTS)
        tables.write_shards(kept, args.output, "shard")
    elif args.command == "segment":
        return segment(spark, rows, args.output)
    else:
        tables.write_shards(sampling.per_shard(rows.drop(*PARTS), "shard", "id", args.size, args.seed), args.output, "shard")


if __name__ == "__main__":
    print(run() or "", end="")
