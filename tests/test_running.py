"""What carries along a key's rows, and alignments, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import decode, wer
from sparrowmill.operators import running, sampling, scoring, segments


def walked(a, b):
    """The table of costs and the way back: across before up before left."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    t[:, 0], t[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = min(t[i - 1, j - 1] + (a[i - 1] != b[j - 1]), t[i - 1, j] + 1, t[i, j - 1] + 1)
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and t[i, j] == t[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and t[i, j] == t[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
    return s, d, n


@pytest.mark.parametrize("cells", [1, 40, 1 << 18])
def test_alignments_equal_the_table(monkeypatch, cells):
    monkeypatch.setattr(wer, "CELLS", cells)
    r = random.Random(cells)
    pairs = [(r.choices("abcd", k=r.randint(0, 12)), r.choices("abcd", k=r.randint(0, 12))) for _ in range(400)] + [([], []), (["x"] * 60, ["y"]), (["y"], ["x"] * 60)]
    assert [tuple(x) for x in wer.edit_counts(pairs)] == [walked(a, b) for a, b in pairs]
    assert wer.edit_counts([]).shape == (0, 3)


def test_long_alignment():
    a, b = ["w"] * 5000, ["w"] * 2500 + ["x"] * 2500
    assert tuple(wer.edit_counts([(a, b)])[0]) == (2500, 0, 0)


def test_scan_carries_over_batches(spark):
    """A key with most of the rows, more than a batch holds, a null key, several parts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, None).otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("k"), "id").repartition(5)
    got = running.scan(rows, "k", ["id"], ["id"], "seen long", lambda: 0, lambda s, x: (s + x, s + x)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = {}, {}
    for i in range(3000):
        k = "hot" if i % 10 < 7 else None if i % 10 == 8 else f"k{i % 30}"
        sums[k] = want[i] = sums.get(k, 0) + i
    assert len(got) == 3000 and all(want[g["id"]] == g["seen"] for g in got)
    assert running.scan(rows.limit(0), "k", ["id"], ["id"], "seen long", lambda: 0, lambda s, x: (s, s)).count() == 0


def test_slices_equal_those_of_arrays(spark):
    r = random.Random(9)
    lists = [[r.choice([1, 2, 50363, 50364, 50400]) for _ in range(r.randint(1, 9))] for _ in range(300)]
    arrays = spark.createDataFrame(list(enumerate(lists)), "key long, t array<int>")
    want = arrays.select("key", F.posexplode(decode.time_slices(F.col("t"))).alias("k", "s")).select("key", "k", "s.start", "s.end", F.size("s.tokens").alias("n_tokens"))
    rows = arrays.select("key", F.posexplode("t").alias("at", "t"))
    got = running.time_slices(rows, "key", "at", "t")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want.collect())


def test_spoken_and_times(spark):
    rows = spark.createDataFrame([("a", 1, " hi "), ("a", 2, ""), ("a", 3, "so foreign"), ("a", 4, "you"), ("a", 5, "late"), ("b", 1, "x"), ("c", 1, "foreign you")], "k string, i long, text string")
    assert sorted(tuple(r) for r in running.spoken(rows, "k", "i", decode.FILLER).collect()) == [("a", 1, "hi"), ("a", 3, "so"), ("b", 1, "x")]
    times = spark.createDataFrame([("a", i, s, s + 1.0) for i, s in enumerate([2.0, 5.0, 0.0, 3.0, 1.0])], "k string, i long, start double, end double")
    assert [r["start"] for r in running.running_times(times, "k", "i").orderBy("i").collect()] == [2.0, 5.0, 4.0, 7.0, 7.0]


def test_packs_of_a_long_recording(spark):
    """One recording with more utterances than others have together; packs equal a plain loop."""
    r = random.Random(3)
    at, ids, want, first = 0, [], [], None
    for i in range(2000):
        a, at = at, at + r.randint(10, 900)
        ids.append((f"rec-{i:05d}-{a:08d}-{at:08d}", "w"))
        if first is None or at - first > 3000:
            first = a
            want.append(0)
        want[-1] += 1
    got = segments.pack_utterances(spark.createDataFrame(ids, "utt_id string, text string")).orderBy("utt_id").collect()
    assert [len(g["text"]) for g in got] == want


def test_bars_of_sets_in_one_pass(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", i % 7 / 7, 1 + i % 5) for i in range(300)], "i long, s string, wer double, ref_words long")
    whole = {(r["b"], round(r["mean"], 9)) for r in sampling.bootstrap_means(rows, ["i"], "wer", "ref_words", 50, "s").collect()}
    parts = {(r["b"], round(r["mean"], 9)) for k in range(3) for r in sampling.bootstrap_means(rows.where(F.col("s") == f"s{k}"), ["i"], "wer", "ref_words", 50).collect()}
    assert whole == parts and len(whole) == 150
    assert scoring.overall_bars(rows, "s", ["i"], 50).first()["n_bootstrap"] == 150


def test_session_lists(spark, tmp_path):
    """Chunks of several batches, a cleared session, one that a timer clears; the state holds the whole texts."""
    import time

    from sparrowmill.streaming import sessions

    def put(*rows):
        spark.createDataFrame(list(rows), "session string, seq long, chunk string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(name, timeout):
        stream = spark.readStream.schema("session string, seq long, chunk string").parquet(f"{tmp_path}/in")
        sessions.drain(sessions.appended(stream, timeout), f"{tmp_path}/{name}", f"{tmp_path}/c{name}", "update", sessions.ROCKSDB)
        return {r["session"]: (r["text"], r["n_chars"]) for r in sessions.session_texts(spark, f"{tmp_path}/c{name}").collect()}

    put(("a", 2, "y"), ("a", 1, "x"), ("b", 1, "q"))
    assert run("out", None) == {"a": ("xy", 2), "b": ("q", 1)}
    put(("a", 3, "z" * 100_000), ("b", 2, None), ("b", 3, "r"), ("c", 1, None))
    assert run("out", None) == {"a": ("xy" + "z" * 100_000, 100_002), "b": ("r", 1)}
    told = [(r["session"], r["n_chars"], len(r["text"])) for r in spark.read.parquet(f"{tmp_path}/out").where("batch_no = 1").orderBy("session").collect()]
    assert told == [("a", 100_002, 100_002), ("b", 1, 1), ("c", 0, 0)]


def test_silent_sessions_are_cleared(spark, tmp_path):
    """By timers, which keep a stream going: it is stopped from outside."""
    import os
    import time

    from sparrowmill.streaming import sessions

    spark.createDataFrame([("a", 1, "x")], "session string, seq long, chunk string").coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sessions.ROCKSDB)
    seen = []
    stream = spark.readStream.schema("session string, seq long, chunk string").parquet(f"{tmp_path}/in")
    query = sessions.appended(stream, 1000).writeStream.outputMode("update").foreachBatch(lambda rows, n: seen.extend(map(tuple, rows.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
        spark.conf.set(name, before)
    assert seen[:2] == [("a", "x", 1), ("a", "", 0)] and os.path.exists(f"{tmp_path}/c/state")


def test_merged_states_equal_one_pass(spark, tmp_path):
    from sparrowmill.operators import mergeable

    rows = spark.createDataFrame([(i, i % 5, float(i * i % 101) if i % 9 else None) for i in range(700)], "id long, shard long, v double")
    for k, some in enumerate(("shard < 2", "shard >= 2", "shard = 1")):
        mergeable.keep(mergeable.sample_state(rows.where(some), "shard", "id", 60), f"{tmp_path}/s", "shard")
        mergeable.keep(mergeable.value_state(rows.where(some), "shard", "v"), f"{tmp_path}/v", "shard")
    state = mergeable.kept(spark, f"{tmp_path}/s")
    for k in (1, 60):
        assert sorted(r["id"] for r in mergeable.merged_sample(state, "id", k).collect()) == sorted(r["id"] for r in sampling.overall(rows, "id", k).collect())
    assert state.count() == 300
    one = sorted(map(tuple, sampling.percentiles(rows, "v", 8).collect()))
    assert sorted(map(tuple, mergeable.merged_percentiles(mergeable.kept(spark, f"{tmp_path}/v"), 8).collect())) == one and len(one) == 101
    found = spark.range(50).select("id", sampling.search(F.col("id"), [3, 7, 7, 20, 41]).alias("n")).collect()
    assert [r["n"] for r in found] == [sum(c < i for c in (3, 7, 7, 20, 41)) for i in range(50)]
