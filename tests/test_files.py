"""Archives, lines and named files: damage, size, dealing, commits and failed tasks."""

import gzip
import hashlib
import io
import json
import os
import pickle
import tarfile

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparrowmill.sinks import committed
from sparrowmill.sources import archives


def make_tar(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, raw in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


def everything(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if not f.startswith("."))


def test_members_in_parts(spark, tmp_path):
    members = {"a.bin": bytes(range(256)) * 40, "e.bin": b"", "b.bin": b"x" * 1000, "c.bin": b"y" * 1001}
    make_tar(tmp_path / "t.tar.gz", members, "w:gz")
    rows = archives.read_tar(spark, str(tmp_path), ("",), part=1000)
    assert {(r["member"], r["part"]) for r in rows.collect()} == {("a.bin", k) for k in range(11)} | {("e.bin", 0), ("b.bin", 0), ("c.bin", 0), ("c.bin", 1)}
    assert {r["member"]: bytes(r["content"]) for r in archives.whole_members(rows, 1000).collect()} == members
    assert [r["member"] for r in archives.read_members(spark, str(tmp_path), ["b.bin"]).collect()] == ["b.bin"]


def test_samples_of_neighbouring_members(spark, tmp_path):
    make_tar(tmp_path / "a.tar", {"d.x/1.txt": b"t", "d.x/1.seg.json": b"{}", "2.txt": b"", "noend": b"n", "3.txt": b"u"})
    make_tar(tmp_path / "b.tar", {"3.txt": b"v", "3.cls": b"w", "4.txt": b"z" * 3000, "4.cls": b"y" * 3000})
    (tmp_path / "b.tar").write_bytes((tmp_path / "b.tar").read_bytes()[:5500])
    for parts in (None, 3):
        got = {(os.path.basename(r["archive"]), r["key"]): {k: bytes(v) for k, v in r["parts"].items()} for r in archives.tar_samples(spark, str(tmp_path), parts).collect()}
        assert got == {("a.tar", "d.x/1"): {"txt": b"t", "seg.json": b"{}"}, ("a.tar", "2"): {"txt": b""}, ("a.tar", "noend"): {"": b"n"}, ("a.tar", "3"): {"txt": b"u"}, ("b.tar", "3"): {"txt": b"v", "cls": b"w"}}


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A member of more bytes than a row can have, read in parts."""
    n, block = 2_200_000_000, bytes(1 << 20)
    info = tarfile.TarInfo("long.wav")
    info.size = n
    with gzip.open(tmp_path / "big.tar.gz", "wb", compresslevel=1) as out:
        out.write(info.tobuf())
        for at in range(0, n, len(block)):
            out.write(block[: n - at])
        out.write(bytes(-n % 512 + 1024))
    rows = archives.read_tar(spark, str(tmp_path), (".wav",), part=16 << 20)
    told = rows.agg(F.sum(F.octet_length("content")), F.max(F.octet_length("content")), F.max("size"), F.count("error")).first()
    assert tuple(told) == (n, 16 << 20, n, 0)


def test_damage_is_a_dead_letter(spark, tmp_path):
    make_tar(tmp_path / "good.tar", {"1.srt": b"one", "2.srt": b"two"})
    make_tar(tmp_path / "cut.tar", {"1.srt": b"one", "2.srt": b"z" * 5000})
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:4000])
    (tmp_path / "none.tar").write_bytes(b"no archive")
    make_tar(tmp_path / "gone.tar.gz", {"1.srt": b"one", "2.srt": os.urandom(100_000)}, "w:gz")
    packed = (tmp_path / "gone.tar.gz").read_bytes()
    (tmp_path / "gone.tar.gz").write_bytes(packed[: len(packed) // 2])
    rows = archives.read_tar(spark, str(tmp_path))
    letters = {os.path.basename(r["id"]): (r["stage"], r["n"]) for r in archives.damage(rows).collect()}
    assert letters == {"cut.tar": ("archive", 1), "none.tar": ("archive", 0), "gone.tar.gz": ("archive", 1)}
    kept = sorted((os.path.basename(r["archive"]), r["member"]) for r in archives.whole_members(rows).collect())
    assert kept == [("cut.tar", "1.srt"), ("gone.tar.gz", "1.srt"), ("good.tar", "1.srt"), ("good.tar", "2.srt")]


def test_archives_are_dealt_in_turn(spark, tmp_path):
    for i in range(7):
        make_tar(tmp_path / f"{i}.tar", {"m.srt": b"x"})
    mine = [{os.path.basename(r["archive"]) for r in archives.read_tar(spark, str(tmp_path), rank=k, world=3).collect()} for k in range(3)]
    assert mine == [{"0.tar", "3.tar", "6.tar"}, {"1.tar", "4.tar"}, {"2.tar", "5.tar"}]
    uris = archives.listed(spark, str(tmp_path), "*.tar")
    rows = archives.records(spark, uris, "tar", archives.MEMBERS, tasks=2)
    by = {}
    for r in rows.select(F.spark_partition_id().alias("p"), "archive").collect():
        by.setdefault(r["p"], []).append(os.path.basename(r["archive"]))
    assert sorted(by.values()) == [["0.tar", "2.tar", "4.tar", "6.tar"], ["1.tar", "3.tar", "5.tar"]]
    assert archives.read_tar(spark, str(tmp_path), glob="*.zip").count() == 0


def test_lines_up_to_damage(spark, tmp_path):
    line = lambda k: json.dumps({"a": k}).encode() + b"\n"
    (tmp_path / "two_frames.jsonl.zst").write_bytes(zstandard.compress(line(1)) + zstandard.compress(b"\n" + line(2)))
    (tmp_path / "bad.jsonl.zst").write_bytes(zstandard.compress(line(3) + b"{no\n" + line(4)))
    cut = zstandard.compress(b"".join(json.dumps({"a": os.urandom(20).hex()}).encode() + b"\n" for _ in range(9000)))
    (tmp_path / "cut.jsonl.zst").write_bytes(cut[: len(cut) // 2])
    rows = archives.read_lines(spark, str(tmp_path))
    got = {os.path.basename(r["id"]): r["n"] for r in archives.damage(rows).collect()}
    assert set(got) == {"bad.jsonl.zst", "cut.jsonl.zst"} and got["bad.jsonl.zst"] == 1 and 0 < got["cut.jsonl.zst"] < 9000
    assert sorted(r["line_no"] for r in rows.where("file LIKE '%two_frames%'").collect()) == [1, 3]
    (tmp_path / "p.jsonl.gz").write_bytes(gzip.compress(line(7)))
    assert [r["a"] for r in archives.read_until_damage(spark, str(tmp_path), "a long", "*.gz").collect()] == [7]


def test_arrow_files_are_split(spark, tmp_path):
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("n", pa.int64()), ("x", pa.string())])) as w:
        for i in range(40):
            w.write_batch(pa.record_batch({"n": [i, i + 100], "x": ["a", "b"]}))
    rows = archives.read_arrow(spark, str(tmp_path), "n long")
    assert sorted(r["n"] for r in rows.collect()) == [*range(40), *range(100, 140)] and rows.rdd.getNumPartitions() == 3


def test_segment_files_round_trip(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 7, F.lit("/"), "id", F.lit(".srt")).alias("name"), F.repeat(F.concat("id", F.lit(" é\n")), 3).alias("text")).repartition(5)
    out = str(tmp_path / "out")
    committed.write_files(rows, out, F.col("name"), F.col("text"))
    assert everything(out) == sorted(f"v{i % 7}/{i}.srt" for i in range(500))
    back = spark.read.text(out, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.srt").select(F.regexp_extract(F.input_file_name(), r"(v\d/\d+\.srt)$", 1), "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    told = {r["name"]: (r["rows"], r["bytes"]) for r in committed.manifest(rows, out).collect()}
    assert told["v3/3.srt"] == (1, len("3 é\n".encode()) * 3) and len(told) == 500
    committed.write_files(rows.limit(2), out, F.col("name"), F.col("text"), overwrite=True)
    assert len(everything(out)) == 2
    committed.write_files(rows.limit(0), f"{out}2", F.col("name"), F.col("text"))
    assert everything(f"{out}2") == []


def test_shards_keep_their_names(spark, tmp_path):
    rows = spark.range(300).select("id", (F.col("id") % 4).alias("shard"), F.when(F.col("id") % 2 == 0, "even").alias("kind"))
    out = str(tmp_path / "out")
    committed.write_shards(rows, out, F.format_string("shard_seg_%05d.jsonl.gz", "shard"), [F.desc("id")], ["id", "kind"])
    assert everything(out) == [f"shard_seg_0000{k}.jsonl.gz" for k in range(4)]
    with gzip.open(f"{out}/shard_seg_00002.jsonl.gz", "rt") as f:
        lines = [json.loads(x) for x in f]
    assert lines == [{"id": i, "kind": "even"} for i in range(299, -1, -1) if i % 4 == 2]


def test_archives_round_trip(spark, tmp_path):
    rows = spark.range(90).select(F.col("id"), F.format_string("%05d.tar", F.col("id") % 3).alias("shard"), F.format_string("%04d.txt", "id").alias("member"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    out = str(tmp_path / "out")
    committed.write_archives(rows, out, F.col("shard"), F.col("member"), F.col("text"))
    back = archives.whole_members(archives.read_tar(spark, out, (".txt",))).select(F.element_at(F.split("archive", "/"), -1), "member", F.decode("content", "UTF-8"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select("shard", "member", "text").collect()))


def test_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    broken = F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise("x")
    with pytest.raises(Exception, match="stop"):
        committed.write_files(spark.range(0, 100, 1, 4), out, F.concat("id", F.lit(".txt")), broken)
    assert everything(out) == [] and not [d for d in (os.listdir(out) if os.path.exists(out) else []) if d.startswith("_staged")]
    committed.write_files(spark.range(3), out, F.concat("id", F.lit(".txt")), F.lit("old"))
    with pytest.raises(Exception, match="one name"):
        committed.write_files(spark.range(0, 2, 1, 2), out, F.lit("same.txt"), F.lit("x"))
    with pytest.raises(Exception, match="no name"):
        committed.write_files(spark.range(1), out, F.lit("../up.txt"), F.lit("x"))
    assert everything(out) == ["0.txt", "1.txt", "2.txt"] and not os.path.exists(tmp_path / "up.txt")


def test_the_driver_handles_lists_not_files(spark, tmp_path):
    """What a task tells the driver is as short for many files as for few."""
    told = []
    for n in (1, 1000):
        writer = committed.FileSink({"path": str(tmp_path / "out"), "kind": "files", "job": str(n)}).writer(None, False)
        told.append(len(pickle.dumps(writer.write(iter([(f"{n}/{i}.txt", "x") for i in range(n)])))))
    assert max(told) < min(told) + 20


def test_moves_are_repeatable(spark, tmp_path):
    """A second attempt of a task finds what the first has moved; a file that is nowhere is an error."""
    uri, staged = str(tmp_path / "out"), tmp_path / "out" / "_staged-j" / "t"
    staged.mkdir(parents=True)
    for i in range(3):
        (staged / str(i)).write_text("x" * i)
    held = pa.RecordBatch.from_pylist([{"name": f"d/{i}.txt", "rows": 1, "bytes": i, "staged": f"t/{i}"} for i in range(3)])
    for _ in range(2):
        assert [b.to_pydict() for b in committed.mover(uri, "j")(iter([held]))] == [{"name": ["d/0.txt", "d/1.txt", "d/2.txt"], "rows": [1] * 3, "bytes": [0, 1, 2]}]
        assert everything(uri) == ["d/0.txt", "d/1.txt", "d/2.txt"]
    lost = pa.RecordBatch.from_pylist([{"name": "d/2.txt", "rows": 1, "bytes": 5, "staged": "t/5"}])
    with pytest.raises(OSError):
        list(committed.mover(uri, "j")(iter([lost])))


def test_failed_move_leaves_no_staged_file(spark, tmp_path):
    out = str(tmp_path / "out")
    committed.write_files(spark.range(1), out, F.lit("a/x.txt"), F.lit("old"))
    with pytest.raises(Exception, match="[Dd]irectory"):
        committed.write_files(spark.range(1), out, F.lit("a"), F.lit("new"))
    assert everything(out) == ["a/x.txt"] and os.listdir(out) == ["a"]


def test_many_files_in_few_tasks(spark, tmp_path):
    """As many tasks read files as there are cores, however many files there are; nothing is lost and none is another's."""
    from sparrowmill.plans import registry

    turns = spark.range(2000).select(F.expr("id div 7").alias("conv_id"), (F.col("id") % 7).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 11 > 0, F.repeat(F.concat("id", F.lit(" é\n")), 2)).alias("text"))
    turns.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["q_segment_files"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    text = lambda i: f"{i} é\n" * 2 if i % 11 else ""
    assert {(r["name"], r["content_md5"]) for r in found.collect()} == {(f"{i // 7}/{i % 7}.srt", hashlib.md5(f"1\n00:00:00,000 --> 00:00:02,000\n{text(i)}\n\n".encode()).hexdigest()) for i in range(2000)}


def test_outputs_of_a_segment_run(spark, tmp_path):
    from sparrowmill.operators import segments
    from sparrowmill.sinks import outputs

    cap = lambda a, b, t: {"start": a, "end": b, "text": t}
    docs = [("a", 1, [cap(0, 4000, "one two"), cap(4000, 9000, "x")]), ("b", 1, [cap(0, 40000, "too long")]), ("c", 2, [cap(5000, 6000, "back"), cap(0, 100, "wards")]), ("d", 2, [cap(0, 1000, "y"), cap(60000, 61000, "z")])]
    rows = spark.createDataFrame(docs, "id string, shard int, captions array<struct<start:long,end:long,text:string>>")
    table = segments.segment_table(rows).join(rows.select("id", "shard"), "id")
    out = str(tmp_path / "out")
    outputs.write_segments(table, out)
    assert everything(out) == ["dead_letters.jsonl.gz", "segment_stats.log", *(f"shard_seg_0000{k}{e}" for k in (1, 2) for e in (".jsonl.gz", "_stats.json"))]
    read = lambda name: [json.loads(x) for x in (gzip.open if name.endswith("gz") else open)(f"{out}/{name}", "rt")]
    assert [s["seg_id"] for s in read("shard_seg_00001.jsonl.gz")] == ["a_0"] and [s["id"] for s in read("shard_seg_00002.jsonl.gz")] == ["d"] * 3
    assert {(x["id"], x["reason"]) for x in read("dead_letters.jsonl.gz")} == {("b", "over_30_line"), ("c", "failed")}
    assert read("shard_seg_00001_stats.json")[0]["segment_count"] == 1 and read("shard_seg_00001_stats.json")[0]["over_30_line_segment_count"] == 1
    log = open(f"{out}/segment_stats.log").read().splitlines()
    assert log[0] == "segment_count: 4" and "failed_transcript_count: 1" in log


def test_maps_are_read_again(spark, tmp_path):
    from sparrowmill.sinks import outputs
    from sparrowmill.sources import transcripts

    rows = spark.createDataFrame([(f"v{i}", "de" if i % 3 else "en") for i in range(50)] + [(None, "fr")], "id string, lang string")
    outputs.write_map(rows, str(tmp_path / "m"), per_file=10)
    assert len(everything(tmp_path / "m")) >= 4
    back = transcripts.read_language_maps(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.where("id is not null").collect()))


def test_commands(spark, tmp_path):
    from sparrowmill import cli

    (tmp_path / "raw" / "shard_00002").mkdir(parents=True)
    (tmp_path / "raw" / "shard_00002" / "v1.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:04.000\nHello there.\n\n")
    (tmp_path / "raw" / "shard_00002" / "v2.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nyes\n\n")
    (tmp_path / "raw" / "shard_00002" / "v3.srt").write_text("nothing")
    told = cli.run(["ingest", "--input", f"{tmp_path}/raw", "--output", f"{tmp_path}/docs"], spark).splitlines()
    assert {"ingest rows: 3", "ingest failed: 1", "ingest seconds: 5"} <= set(told)
    assert everything(tmp_path / "docs") == ["failed_transcripts.jsonl.gz", "shard_00002.jsonl.gz"]
    assert spark.read.json(f"{tmp_path}/docs/failed_transcripts.jsonl.gz").first().asDict() == {"id": "v3", "stage": "ingest", "reason": "no captions", "n": 1}
    (tmp_path / "docs" / "failed_transcripts.jsonl.gz").unlink()
    (tmp_path / "votes.jsonl").write_text("".join(json.dumps({"id": "v1", "seg_no": k, "content": c, "lang": v}) + "\n" for k, (v, c) in enumerate([("fr", "a"), ("de", "b"), ("de", "c"), ("fr", ""), ("fr", None)])))
    cli.run(["vote", "--input", f"{tmp_path}/votes.jsonl", "--output", f"{tmp_path}/maps"], spark)
    cli.run(["assign", "--input", f"{tmp_path}/docs", "--output", f"{tmp_path}/known", "--maps", f"{tmp_path}/maps"], spark)
    assert everything(tmp_path / "known") == ["missing_audio_lang.jsonl.gz", "shard_00002.jsonl.gz"]
    got = {r["id"]: r["audio_lang"] for r in spark.read.json(f"{tmp_path}/known/shard_00002.jsonl.gz").collect()}
    assert got == {"v1": "de", "v2": "en", "v3": "en"} and {r["id"] for r in spark.read.json(f"{tmp_path}/known/missing_audio_lang.jsonl.gz").collect()} == {"v2", "v3"}
    (tmp_path / "t.yaml").write_text("pipeline:\n  - tag: casing\n  - tag: num_words\n  - tag: repeating_lines\n")
    cli.run(["tag", "--input", f"{tmp_path}/docs", "--output", f"{tmp_path}/tagged", "--config", f"{tmp_path}/t.yaml"], spark)
    with open(f"{tmp_path}/tagged/shard_00002_stats.json") as f:
        stats = {(s["tag"], s["stat"]): s["value"] for s in map(json.loads, f)}
    assert stats == {("casing", "casing_upper_avg"): 0.0, ("casing", "casing_lower_avg"): 1 / 3, ("casing", "casing_mixed_avg"): 2 / 3, ("num_words", "num_words_sum"): 3.0, ("repeating_lines", "repeating_lines_avg"): 0.0}
    vtt = lambda t: f"WEBVTT\n\n00:00:00.000 --> 00:00:04.000\n{t}\n\n"
    (tmp_path / "segs").mkdir()
    record = {"id": "v1", "seg_id": "v1_0", "content": vtt("whole"), "seg_content": vtt("der Hund und die Katze"), "mach_seg_content": vtt("der Hund oder die Katze")}
    (tmp_path / "segs" / "shard_00001.jsonl").write_text(json.dumps(record) + "\n")
    (tmp_path / "seg.yaml").write_text("pipeline:\n  - tag: edit_dist\n  - tag: text_lang\n")
    (tmp_path / "known.jsonl").write_text(json.dumps({"text": "der die und", "lang": "xx"}) + "\n" + json.dumps({"text": "the and of", "lang": "yy"}) + "\n")
    cli.run(["learn", "--input", f"{tmp_path}/known.jsonl", "--output", f"{tmp_path}/profiles"], spark)
    cli.run(["tag", "--input", f"{tmp_path}/segs", "--output", f"{tmp_path}/segtags", "--config", f"{tmp_path}/seg.yaml", "--level", "segment", "--languages", f"{tmp_path}/profiles"], spark)
    got = spark.read.json(f"{tmp_path}/segtags/shard_00001.jsonl.gz").first()
    assert (got["edit_dist"], got["text_lang"]) == (0.2, "xx")
    (tmp_path / "u.jsonl").write_text("".join(json.dumps({"utt_id": f"r-0000{k}-{k * 1000:08d}-{k * 1000 + 900:08d}", "text": "w"}) + "\n" for k in range(5)))
    cli.run(["reseg", "--input", f"{tmp_path}/u.jsonl", "--output", f"{tmp_path}/reseg"], spark)
    assert [len(r["text"]) for r in spark.read.json(f"{tmp_path}/reseg").orderBy("utt_id").collect()] == [3, 2]
    (tmp_path / "n.jsonl").write_text("".join(json.dumps({"id": f"{k}", "dur": k}) + "\n" for k in range(200)))
    cli.run(["percentiles", "--input", f"{tmp_path}/n.jsonl", "--output", f"{tmp_path}/p", "--column", "dur", "--size", "500"], spark)
    assert {r["percentile"]: r["value"] for r in spark.read.json(f"{tmp_path}/p").collect()}[100] == 199.0
    (tmp_path / "s.csv").write_text("wer,ref_length\n0.5,10\n0.5,30\n")
    cli.run(["bars", "--input", f"{tmp_path}/s.csv", "--output", f"{tmp_path}/bars"], spark)
    assert spark.read.json(f"{tmp_path}/bars").first()["mean"] == 0.5


def test_one_pass_for_counters_and_files(spark, tmp_path):
    """Several files and the counters of two stages come from one scan of the input."""
    from sparrowmill.sinks import outputs

    spark.range(100).write.parquet(f"{tmp_path}/in")
    report = outputs.Report()
    rows = report.watch(spark.read.parquet(f"{tmp_path}/in"), "read", odd=F.col("id") % 2 == 1)
    lines = report.watch(outputs.routed(rows, ("all.jsonl", F.to_json(F.struct("id")), F.col("id")), (F.when(F.col("id") % 10 == 3, "bad.jsonl"), outputs.letter("id", "read", "three"), None)), "lines")
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    outputs.write_parts(f"{tmp_path}/out", lines)
    assert sorted(report.rows()) == [("lines", "rows", 110.0), ("read", "odd", 50.0), ("read", "rows", 100.0)] and "read odd: 50\n" in report.text()
    assert everything(tmp_path / "out") == ["all.jsonl", "bad.jsonl"] and len(open(f"{tmp_path}/out/bad.jsonl").readlines()) == 10
