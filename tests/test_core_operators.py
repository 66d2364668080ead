"""Core operators on worked cases, brute force and round trips."""

import io
import json
import random
import tarfile

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparrowmill import cli
from sparrowmill.functions import decode, text as T, tokens, wer
from sparrowmill.operators import align, filters, sampling, scoring, segments, tags
from sparrowmill.sinks import tables
from sparrowmill.sources import archives, evalsets, transcripts
from sparrowmill.streaming import sessions


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_cleaning_cases(spark):
    cases = {"a &nbsp; &amp;  b": "a  b", "x = y": "x y", "so... well": "so well", r"a \h b": "a b", "&quot; &copy;": "&quot; &copy;", "JOHN SMITH : hello": " hello", "John: hello": "John: hello"}
    assert {k: one(spark, k, T.clean_caption) for k in cases} == cases
    cases = {"We(BR) aksed for [unintelligible] busses": "We asked for buses", "a /unintelligible/ b": "a  b", "x /RD-NAME-1/ y": "x  y", "q /??/ r": "q  r", "one <breath> two (laughs) {x}": "one two", "aks busses": "ask buses"}
    assert {k: one(spark, k, T.clean_dialect) for k in cases} == cases


def test_texts(spark):
    captions = lambda *c: spark.createDataFrame([(list(c),)], "c array<string>")
    said = lambda df, keep: df.select(T.machine_text(F.col("c"), keep)).first()[0]
    assert said(captions("a", "a", "a\nb", "c", "c\nd"), False) == "c d" and said(captions("a", "a", "a\nb", "c", "c\nd"), True) == "a c d"
    assert said(captions("x\ny"), False) == "y" and said(captions(), True) == "" and said(captions("a", "b"), False) == "a b"
    assert captions("Done.", "élan").select(T.capital_after_stop(F.col("c"))).first()[0] is False and captions("Done.", "Élan").select(T.capital_after_stop(F.col("c"))).first()[0] is True
    assert [one(spark, t, T.text_language) for t in ("the cat and the dog", "la vie et les gens", "der Hund und das Haus", "el perro y los gatos", "xyz", None)] == ["en", "fr", "de", "es", "en", "en"]
    assert one(spark, "Um, I won't pay Mr. Smith $1,000 [laughs] (ok)", T.normalise_english) == "i will not pay mister smith $1000"
    assert one(spark, "a\nb\n1.0 --> 2.0", T.join_lines) == "ab\n1.0 --> 2.0"


def test_ladder(spark):
    rows = [("a b", "a", "a b", "a"), ("", "x y", "", "x y"), ("", "?", "", ""), ("", "", "", ""), ("?? !", "a", "", "a")]
    got = spark.createDataFrame(rows, "m string, k string, nm string, nk string").select(F.round(wer.distance_ladder(*map(F.col, ("m", "k", "nm", "nk"))), 6)).collect()
    assert [g[0] for g in got] == [0.5, 1.0, 1.0, 0.0, 1.0]


def test_edit_counts(spark):
    def least(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(6)
    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randint(0, 14)) for _ in range(2))
        s, d, i = wer.edit_counts([(a, b)])[0]
        assert s + d + i == least(a, b) and d - i == len(a) - len(b)
    pairs = spark.createDataFrame([("s", "the cat sat on the mat", "the cat sat on mat now"), ("s", "a b c", ""), ("t", "é à ü", "é à x")], "eval_set string, ref string, hyp string")
    scored = scoring.pair_scores(pairs, F.col("ref"), F.col("hyp"))
    assert [(g["edits"], g["ref_words"]) for g in scored.collect()] == [(2, 6), (3, 3), (1, 3)]
    assert {g["eval_set"]: round(g["wer"], 3) for g in scoring.corpus_scores(scored, ["eval_set"]).collect()} == {"s": 55.556, "t": 33.333}


def test_checked_segments():
    captions = [(0, 4000, "one two"), (4000, 9000, "w " * 460), (9000, 29000, "three")]
    found, n, reason = segments.checked(captions, segments.word_count)
    assert not found and n["over_ctx_len_segment_count"] == 1 and reason is None
    found, n, _ = segments.checked([(1000, 4500, "hi"), (4500, 4000 + 26000, "there")], segments.word_count, "srt")
    assert found[0]["seg_content"] == "1\n00:00:00,000 --> 00:00:03,500\nhi\n\n2\n00:00:03,500 --> 00:00:29,000\nthere\n\n" and n["segment_count"] == 1
    assert (found[0]["num_tokens_ts_mode"], found[0]["num_tokens_no_ts_mode"], found[0]["only_no_ts_mode"]) == (8, 5, False)
    assert segments.checked([(0, 10, "x")], segments.word_count)[1]["faulty_audio_segment_count"] == 1
    assert segments.checked([(10000, 12000, "x"), (1000, 2000, "y")], segments.word_count)[1]["failed_transcript_count"] == 1
    assert segments.checked([(0, 9000, "a"), (3000, 5000, "b")], segments.word_count)[1]["bad_text_segment_count"] == 1
    silent, n, _ = segments.checked([(0, 5000, "a"), (65000, 70000, "b")], segments.word_count)
    assert [(s["start_ms"], s["length_ms"], s["silent"]) for s in silent] == [(0, 5000, False), (5000, 30000, True), (35000, 30000, True), (65000, 5000, False)]
    assert len(segments.checked([(i * 29000, i * 29000 + 29000, "a") for i in range(200)], segments.word_count)[0]) == segments.MOST


def test_nearest(spark):
    captions = [(0, 900), (1000, 1900), (2100, 2900), (3000, 4100), (9000, 9900)]
    assert align.nearest([(0, 2000), (2000, 4000), (8800, 9000)], captions) == [(0, 2), (2, 4), (4, 5)]
    assert align.nearest([(5000, 6000)], []) == [] and align.nearest([], captions) == []
    df = spark.createDataFrame([("a", [(0, 2000)], [(0, 900, "x"), (1000, 1900, "y")]), ("b", None, None)], "id string, segments array<struct<start:long,end:long>>, captions array<struct<start:long,end:long,text:string>>")
    assert [(r["id"], r["first"], r["last"], r["texts"]) for r in align.nearest_align(df).collect()] == [("a", 0, 1, ["x", "y"])]
    left, right = spark.createDataFrame([("b",), ("a",)], "p string"), spark.createDataFrame([("y",), ("x",)], "q string")
    assert sorted((r["p"], r["q"]) for r in align.pair_sorted(left, right, "p", "q").collect()) == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        align.pair_sorted(left, right.limit(1), "p", "q")


def test_utterances(spark):
    ids = ["abc-00001-00000150-00000420", "abc-00002-00000420-00003150", "abc-00003-00003150-00003200", "xyz-00001-00000000-00004000", "bad"]
    got = sorted(segments.pack_utterances(spark.createDataFrame([(i, "w") for i in ids], "utt_id string, text string")).collect())
    assert [(g["utt_id"], len(g["text"]), g["dur"]) for g in got] == [("abc-00000-00000150-00003150", 2, 30.0), ("abc-00001-00003150-00003200", 1, 0.5), ("xyz-00000-00000000-00004000", 1, 40.0)]
    assert [tuple(t) for t in got[0]["ts"]] == [(0.0, 2.7), (2.7, 30.0)]


def test_sequences(spark):
    kind = "n int, only boolean, timed boolean, c array<struct<start:int,end:int,ids:array<int>>>"
    rows = [(30000, False, True, []), (1000, False, True, []), (1000, True, True, []), (2000, False, True, [(0, 1000, [7, 8])]), (2000, False, False, [(0, 1000, [7])]), (31000, False, True, [(0, 20000, [5]), (20000, 31000, [6])])]
    df = spark.createDataFrame(rows, kind).select(tokens.sequence(F.col("c"), F.col("n"), F.lit(True), F.col("only"), F.col("timed")).alias("t"))
    assert [r["t"] for r in df.collect()] == [[50257, 50362, 50361, 50256], [50257, 50363, 50413, 50413, 50256], [50257, 50362, 50256], [50257, 50363, 7, 8, 50413, 50463, 50256], [50257, 50362, 7, 50256], [50257, 50362, 5, 50256]]
    x, y = df.select(*tokens.teacher_forcing(F.col("t"))).collect()[3]
    assert len(x) == len(y) == 448 and x[:7] == [50257, 50363, 7, 8, 50413, 50463, 51864] and y[:7] == [50363, 7, 8, 50413, 50463, 50256, 51864]


def test_decoding(spark):
    words = spark.createDataFrame([([("a", 0.0, 0.05, 0.1)] * 3,), ([("a", 0.0, 0.5, 0.9)] * 3,), ([],)], "w array<struct<word:string,start:double,end:double,probability:double>>")
    assert [r[0] for r in words.select(decode.segment_odd(F.col("w"))).collect()] == [True, False, False]
    chunks = spark.createDataFrame([([(0.0, 1.0, "hi"), (1.0, 2.0, " "), (2.0, 3.0, "so foreign"), (3.0, 4.0, "you"), (4.0, 5.0, "lost")],)], "c array<struct<start:double,end:double,text:string>>")
    assert [c["text"] for c in chunks.select(decode.spoken(F.col("c")).alias("c")).first()["c"]] == ["hi", "so"]
    t = spark.createDataFrame([([50363, 1, 50400, 50400, 2, 50420],), ([1, 2],)], "t array<int>").select(decode.time_slices(F.col("t")).alias("s")).collect()
    assert [tuple(x)[:2] for x in t[0]["s"]] == [(0, 37), (37, 57)] and [tuple(x)[:2] for x in t[1]["s"]] == [(0, None)]
    seg = spark.createDataFrame([((1.0, 1.0, "x", [1], ["w"]),)], "s struct<start:double,end:double,text:string,tokens:array<int>,words:array<string>>").select(decode.cleared(F.col("s")).alias("s")).first()["s"]
    assert (seg["text"], seg["tokens"], seg["words"]) == ("", [], [])


def test_shipped_configurations(spark, tmp_path):
    (tmp_path / "final.yaml").write_text("name: x\npipeline:\n  - tag: text_lang\n    ref_value: en\n  - tag: casing\n    ref_value:\n      - mixed\n      - lower\n  - tag: repeating_lines\n    ref_value: False\n  - tag: edit_dist\n    upper_bound: 0.5\n    inclusive: true\n  - tag: seg_content")
    docs = spark.createDataFrame([("1", ["Hello the World"], ["Hello the World"], "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\na = b\n\n"), ("2", ["AAA BBB"], None, "plain = text")], "id string, captions array<string>, mach_captions array<string>, seg_content string")
    tagged = tags.from_config(docs, [{"tag": t} for t in ("casing", "repeating_lines", "text_lang", "edit_dist")])
    got = {r["id"]: r for r in filters.with_hit(tagged, filters.load_config(str(tmp_path / "final.yaml"))).collect()}
    assert got["1"]["hit"] == "pass" and got["1"]["seg_content"].endswith("\na b\n\n") and got["2"]["hit"] == "casing" and got["2"]["seg_content"] == "plain = text"


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, raw in {"x/1.vtt": b"WEBVTT\n", "x/1.m4a": b"\0", "x/2.srt": b"1\n"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    (tmp_path / "b.tar").write_bytes(b"no archive")
    assert sorted((r["subtitle_file"], r["content"]) for r in archives.tar_transcripts(spark, str(tmp_path)).collect()) == [("x/1.vtt", "WEBVTT\n"), ("x/2.srt", "1\n")]
    got = {r["key"]: sorted(r["parts"]) for r in archives.tar_samples(spark, str(tmp_path), 2).collect()}
    assert got == {"x/1": ["m4a", "vtt"], "x/2": ["srt"]}
    table = pa.table({"utt_id": ["a", "b"], "n": [1, 2]})
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert sorted(tuple(r) for r in archives.read_arrow(spark, str(tmp_path), "utt_id string, n long").collect()) == [("a", 1), ("a", 1), ("b", 2), ("b", 2)]
    (tmp_path / "z.jsonl.zst").write_bytes(zstandard.compress(b'{"a": 1}\n{"a": 2}\n{bad\n{"a": 3}\n'))
    assert [r["a"] for r in archives.read_until_damage(spark, str(tmp_path), "a long").collect()] == [1, 2]


def test_more_layouts(spark, tmp_path):
    def rows(layout, path):
        return sorted(tuple(r) for r in evalsets.load(spark, layout, str(path), "r").collect())

    (tmp_path / "m.txt").write_text("S_EN2_X well yes\n")
    assert rows("meetings", tmp_path / "m.txt") == [("r/EN2/eval_s_en2_x.wav", "well yes")]
    (tmp_path / "j.json").write_text(json.dumps([{"audio_seg_file": "a.wav", "words": "one"}, {"audio_seg_file": "b.wav", "words": "two"}]))
    assert rows("json_arrays", tmp_path / "j.json") == [("r/segments/a.wav", "one"), ("r/segments/b.wav", "two")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "text").write_text("u1 one  two\nu2 x\n")
    (tmp_path / "k" / "wav.scp").write_text("u1 sph2pipe a.wv1 | more\n")
    assert rows("keyed", tmp_path / "k") == [("sph2pipe a.wv1", "one  two")]
    (tmp_path / "k" / "wav.scp").write_text("u9 cmd |\n")
    with pytest.raises(ValueError):
        rows("keyed", tmp_path / "k")
    (tmp_path / "n.csv").write_text('a,b,c,d,e,f\n1,2,3,4,5,"x, y"\n1,2,3,4,5,z\n')
    assert rows("numbered", tmp_path / "n.csv") == [("r/audio/00.m4a", "x, y"), ("r/audio/01.m4a", "z")]
    spark.createDataFrame([("p.wav", "t")], "audio string, raw_text string").write.parquet(f"{tmp_path}/p")
    assert rows("published", tmp_path / "p") == [("r/p.wav", "t")]
    (tmp_path / "c.txt").write_text("1-2-3 old\n1-2-3 new\n")
    assert rows("chapters", tmp_path / "c.txt") == [("r/1/2/1-2-3.flac", "new")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5, 4), (2, "b", 0.25, 8)], "id long, shard string, wer double, ref_words long")
    assert tables.write_shards(df, f"{tmp_path}/o", "shard") and not tables.write_shards(df.limit(0), f"{tmp_path}/none")
    assert spark.read.json(f"{tmp_path}/o").count() == 2
    tables.write_scores(df, f"{tmp_path}/s")
    assert sorted(tuple(r) for r in evalsets.read_scores(spark, f"{tmp_path}/s").collect()) == [(0.25, 8), (0.5, 4)]
    assert "id: 1, wer: 0.5000" in tables.report("Run", ("Rows", df.select("id", "wer"))) and tables.report_name("a/b.yaml") == "b.log"
    assert sum(sampling.reader_share(df, "id", k, 3).count() for k in range(3)) == 2


def test_new_files_only(spark, tmp_path):
    def add(i):
        spark.createDataFrame([(i,)], "i long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda: sessions.new_files_only(spark.readStream.schema("i long").parquet(f"{tmp_path}/in"), lambda d: d.withColumn("j", F.col("i") * 2), f"{tmp_path}/out", f"{tmp_path}/check")
    add(1)
    run()
    add(2)
    run()
    run()
    assert sorted((r["i"], r["j"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 2), (2, 4)]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = {"id": "v1", "content": "WEBVTT\n\n00:00:00.000 --> 00:00:04.000\nHello the world.\n\n00:00:04.000 --> 00:00:09.000\nAnd so.\n\n", "length": 9.0}
    (tmp_path / "in" / "shard_00003.jsonl").write_text(json.dumps(record) + "\n")
    (tmp_path / "t.yaml").write_text("pipeline:\n  - tag: casing\n  - tag: text_lang\n")
    cli.run(["tag", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/tagged", "--config", f"{tmp_path}/t.yaml"], spark)
    got = spark.read.json(f"{tmp_path}/tagged/shard_00003.jsonl.gz").first()
    assert (got["casing"], got["text_lang"]) == ("mixed", "en")
    cli.run(["segment", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/seg"], spark)
    assert spark.read.json(f"{tmp_path}/seg/shard_seg_00003.jsonl.gz").first()["seg_id"] == "v1_0"


@pytest.mark.parametrize("values", [[], [None], [3.0], [5.0] * 400 + [1.0, 9.0, None], [float(i * i % 97) for i in range(1000)], [7.0] * 50])
def test_percentiles_with_ties(spark, values):
    own = sorted(v for v in values if v is not None)
    n = len(own)
    want = [(p, own[min(round(p * n / 100), n - 1)] if p < 100 else own[-1]) for p in range(101) if n]
    for parts in (1, 8):
        found = sampling.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", parts)
        assert sorted(map(tuple, found.collect())) == want


def test_token_seq_keeps_long_texts(spark, tmp_path):
    from sparrowmill.plans import registry

    spark.createDataFrame([(1, "ab c"), (2, "w " * 600), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in registry.QUERIES["q_token_seq"](spark, str(tmp_path)).collect()}
    assert [(got[i]["n_ids"], got[i]["over_length"]) for i in (1, 2, 3)] == [(4, False), (602, True), (2, False)]
    assert got[2]["text_input"].split(",") == ["50257", *["1"] * 600, "50256"] and got[2]["text_y"].split(",") == ["1"] * 600 + ["50256"]
    assert got[1]["text_input"].split(",") == ["50257", "2", "1", "50256", *["51864"] * 444] and len(got[1]["text_y"].split(",")) == 448


def test_session_text_is_whole(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, "x" * 1000) for i in range(150)], "session string, seq long, chunk string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sessions.drain(sessions.buffered(stream, timeout_ms=None), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update")
    assert spark.read.parquet(str(tmp_path / "out")).first()["n_chars"] == 150_000
