"""The reference's operators against DuckDB and worked cases."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import text as T, timecode, wer
from sparrowmill.operators import filters, sampling, segments
from sparrowmill.plans import registry
from sparrowmill.sources import transcripts

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("counts, want", [((0, 0, 0), "mixed"), ((3, 1, 0), "upper"), ((0, 10, 7), "mixed"), ((0, 10, 6), "lower"), ((7, 0, 10), "mixed"), ((2, 2, 0), "upper"), ((2, 0, 2), "mixed")])
def test_casing(spark, counts, want):
    c = F.struct(*(F.lit(n).alias(k) for n, k in zip(counts, ("upper", "lower", "mixed"))))
    assert spark.range(1).select(T.casing(c)).first()[0] == want


def test_word_edits(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    pairs = [(" ".join(r.choices("a b c dé é x".split(), k=r.randint(1, 9))), " ".join(r.choices("a b c dé é x".split(), k=r.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [x[0] for x in df.select(wer.word_edits(T.words(F.col("a")), T.words(F.col("b")))).collect()]
    assert got == [distance(a.split(), b.split()) for a, b in pairs]


def test_token_windows(spark, tmp_path):
    lengths = {1: [1 + i % 9 for i in range(1000)], 2: [3] * 446, 3: [], 4: [2] * 447}
    spark.createDataFrame([(i, " ".join("x" * n for n in v)) for i, v in lengths.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in registry.QUERIES["q_token_windows"](spark, str(tmp_path)).orderBy("doc_id", "window_no").collect():
        x, y = ([int(i) for i in r[k].split(",")] for k in ("text_input", "text_y"))
        own = x[1 : x.index(50256)]
        assert len(x) == len(y) == 448 and x[0] == 50257 and y == [*x[1:], 51864] and len(own) <= 446
        got.setdefault(r["doc_id"], []).append(own)
    assert {i: sum(v, []) for i, v in got.items()} == lengths and [len(got[i]) for i in (1, 2, 3, 4)] == [3, 1, 1, 2]


def test_word_edits_beyond_alphabet(spark):
    many = [f"w{i}" for i in range(wer.SYMBOLS + 1000)]
    hyp = ["new", *many[:50], "x", *many[51:6000], *many[6003:]]
    pairs = [(many, hyp, 5), (many, [], len(many)), (many[: wer.SYMBOLS], many[1 : wer.SYMBOLS], 1), (["a", "b"], ["b"], 1)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b, _ in pairs], "a string, b string")
    got = df.select(wer.word_edits(T.words(F.col("a")), T.words(F.col("b"))).alias("e"), wer.wer(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(g["e"], round(g["r"], 9)) for g in got] == [(e, round(e / len(a), 9)) for a, _, e in pairs]
    r = random.Random(2)
    pairs = [(r.choices("abcde", k=r.randint(0, 12)), r.choices("abcde", k=r.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([("".join(a), "".join(b)) for a, b in pairs], "a string, b string")
    assert [wer.distance(a, b) for a, b in pairs] == [x[0] for x in df.select(F.levenshtein("a", "b")).collect()]


def test_bootstrap(spark):
    drawn = sampling.poisson(np.arange(4000) * 7919, 1000)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.01 and drawn.max() > 7
    r = np.random.default_rng(1)
    rows = [(i, float(v), int(w)) for i, (v, w) in enumerate(zip(r.random(400), r.integers(1, 30, 400)))]
    df = spark.createDataFrame([*rows, (400, None, 0)], "id long, v double, w long").repartition(3)
    keys = [x["k"] for x in df.where("v is not null").orderBy("id").select(F.xxhash64("id").alias("k")).collect()]
    k = sampling.poisson(np.array(keys), 1000)
    v, w = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    want = (v * w) @ k / (w @ k)
    got = sampling.bootstrap_means(df, ["id"], "v", "w").orderBy("b").toPandas()["mean"].to_numpy()
    assert len(got) == 1000 and np.allclose(got, want)
    bars = sampling.error_bars(sampling.bootstrap_means(df, ["id"], "v", "w")).first()
    assert bars["n_bootstrap"] == 1000 and np.allclose(bars[1:], [want.mean(), want.std(), want.std() / 1000**0.5], atol=1e-6)
    analytic = (((v - (v @ w) / w.sum()) * w) ** 2).sum() ** 0.5 / w.sum()
    assert abs(bars["std_dev"] / analytic - 1) < 0.1
    assert registry.QUERIES["q_bootstrap"](spark, SF).first()["n_bootstrap"] == 1000


def test_timecode(spark):
    rows = spark.createDataFrame([("00:00:01.5",), ("01:02:03,004",), ("02:03",), ("27:00:00.000",), ("x",)], "c string")
    assert [r[0] for r in rows.select(timecode.to_ms(F.col("c"))).collect()] == [1500, 3723004, 123000, 97200000, None]


S = 1000


@pytest.mark.parametrize("captions, want, long, reason", [
    ([(0, 4), (4, 9), (9, 12.5)], [(0, 12.5, 3)], 0, None),
    ([(8 * i, 8 * i + 7) for i in range(8)], [(0, 23, 3), (23, 24, 3), (47, 16, 2)], 0, None),
    ([(0, 25), (45, 60)], [(0, 25, 1), (25, 20, 0), (45, 15, 1)], 0, None),
    ([(0, 5), (65, 70)], [(0, 5, 1), (5, 30, 0), (35, 30, 0), (65, 5, 1)], 0, None),
    ([(0, 5), (80, 85), (86, 90)], [(0, 5, 1), (5, 30, 0), (35, 30, 0), (65, 25, 2)], 0, None),
    ([(0, 45), (45, 50), (51, 58)], [(45, 13, 2)], 1, None),
    ([(0, 40)], [], 1, None),
    ([(10, 12), (1, 2)], [], 0, "backwards"),
])
def test_segments(captions, want, long, reason):
    got, n, why = segments.segment([(int(a * S), int(b * S), f"c{i}") for i, (a, b) in enumerate(captions)])
    assert [(s / S, d / S, k) for s, d, k, _, _ in got] == want and (n, why) == (long, reason)


def test_filters(spark):
    df = spark.createDataFrame([(1, True, "en", 0.5), (2, None, None, None), (3, False, "fr", 0.1), (4, True, "en", float("nan"))], "id long, b boolean, s string, x double")
    steps = [{"tag": "b", "ref_value": True}, {"tag": "s", "reference_value": ["en"]}, {"tag": "x", "upper_bound": 0.5}, {"tag": "absent", "ref_value": 1}]
    assert {r["id"]: r["hit"] for r in filters.with_hit(df, steps).collect()} == {1: "pass", 2: "pass", 3: "b", 4: "x"}
    with pytest.raises(ValueError):
        filters.with_hit(df, [{"tag": "b", "value": 1}])


def test_transcripts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "v1.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:04.000\nHello <b>there</b>.\n\nid\n00:04.000 --> 00:09.500 align:left\ntwo\nlines\n")
    (tmp_path / "v2.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nx\n\n2\n00:00:03,000 --> 00:00:04,000\ny\n")
    (tmp_path / "v3.vtt").write_text("WEBVTT\n")
    got = {r["id"]: ([tuple(c) for c in r["captions"]], r["length"], r["failed"]) for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got["v1"] == ([(0, 4000, "Hello there."), (4000, 9500, "two\nlines")], 9.5, False)
    assert got["v2"] == ([(1000, 2500, "x"), (3000, 4000, "y")], 3.0, False)
    assert got["v3"] == ([], 0.0, True)


def test_evaluation_sets(spark, tmp_path):
    from sparrowmill.sources import evalsets

    def rows(layout, body, root="r"):
        path = tmp_path / f"{layout}.txt"
        path.write_text(body, encoding="utf-8")
        return [tuple(r) for r in evalsets.load(spark, layout, str(path), root).collect()]

    assert rows("chapters", "1-2-03 HE SAID SO\n\n1-2-04\n") == [("r/1/2/1-2-03.flac", "HE SAID SO"), ("r/1/2/1-2-04.flac", None)]
    assert rows("tsv_header", 'id\tpath\ttext\nx\ta.wav\t"so\n') == [("r/a.wav", '"so')]
    assert rows("tsv_plain", "x\ta.wav\tone\nx\tb.wav\ttwo\n", "") == [("a.wav", "one"), ("b.wav", "two")]
    assert rows("tsv_wav", "id\ttext\nu1\tone\n") == [("r/u1.wav", "one")]
    assert rows("csv_dialect", 'a,b,c,d,e,f,g,h\n1,2,3,4,x.wav,6,7,"yes, ""so"""\n') == [("r/x.wav/1", 'yes, "so"')]
    assert rows("json_lines", '{"audio": "a", "text": "t"}\n{"audio": "b"}\n') == [("r/a", "t"), ("r/b", None)]
    assert rows("stm", ";; note\nf 1 s 0.5  2.25 <o,f0> well yes\n") == [("r/f", "well yes", 0.5, 2.25)]
    with pytest.raises(ValueError):
        evalsets.load(spark, "none", "x")
