"""Machine captions against manual segments, compared with a plain walk over lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import machine


def plain(segments, captions):
    if any(e < s for s, e, _ in captions):
        return [(None, "failed_transcript")]
    out, k, at, n = [], 0, 0, len(captions)
    while k < min(len(segments), machine.MOST) and at < n:
        start, end = segments[k]
        a = at
        while a + 1 < n and abs(captions[a + 1][0] - start) < abs(captions[a][0] - start):
            a += 1
        if captions[a][1] - captions[a][0] > 30_000:
            out.append((None, "over_30_line", a, a))
            at = a + 1
            continue
        b = a
        while b + 1 < n and captions[b + 1][1] - captions[b + 1][0] <= 30_000 and abs(captions[b + 1][1] - end) <= abs(captions[b][1] - end):
            b += 1
        words = sum(len(t.split()) for _, _, t in captions[a : b + 1])
        if words + 2 * (b - a + 1) + (b + 1 < n) + 2 > 448 and words + 3 > 448:
            out.append((None, "over_ctx_len", a, b))
        elif captions[b][1] - captions[a][0] < 15:
            out.append((None, "faulty_audio", a, b))
        else:
            out.append((k, "segment", a, b))
            k += 1
        at = b + 1
    return out


def made_up(r):
    segments, at = [], 0
    for _ in range(r.randint(0, 8)):
        segments.append((at, at := at + r.randint(1000, 30000)))
    captions, at = [], r.randint(0, 3000)
    for _ in range(r.randint(0, 20)):
        end = at + r.choice([3, 900, 4000, 9000, 31000])
        captions.append((at, end, "w " * r.choice([1, 5, 200, 500])))
        at = end + r.choice([0, 0, 500, 20000])
    return segments, captions


@pytest.fixture(scope="module")
def videos(spark):
    r = random.Random(7)
    made = {f"v{i}": made_up(r) for i in range(150)}
    made["long"] = ([(i * 1000, i * 1000 + 1000) for i in range(300)], [(i * 1000 + 50, i * 1000 + 1050, "x y") for i in range(400)])
    made["back"] = ([(0, 5000)], [(0, 900, "a"), (2000, 1000, "b"), (3000, 4000, "c")])
    made[None] = ([(0, 1000)], [(0, 1000, None)])
    segments = spark.createDataFrame([(v, n, *s) for v, (own, _) in made.items() for n, s in enumerate(own)], "id string, n long, start long, end long").repartition(4)
    captions = spark.createDataFrame([(v, n, *c) for v, (_, own) in made.items() for n, c in enumerate(own)], "id string, n long, start long, end long, text string").repartition(4)
    return made, segments, captions


def test_machine_segments(videos):
    made, segments, captions = videos
    got = {}
    for g in machine.machine_segments(segments, captions).collect():
        got.setdefault(g["id"], []).append(g)
    for v, (own, told) in made.items():
        told = [(s, e, t or "") for s, e, t in told]
        want = plain(own, told)
        rows = got.get(v, [])
        if want and want[0][1] == "failed_transcript":
            assert [(g["seg_no"], g["kind"]) for g in rows] == want
        else:
            shown = lambda x: str(x)
            assert sorted(((g["seg_no"], g["kind"], g["start"], g["end"], len(g["texts"])) for g in rows), key=shown) == sorted(((k, kind, told[a][0], told[b][1], b - a + 1) for k, kind, a, b in want), key=shown)
    assert len(got["long"]) == machine.MOST


def test_counters_and_merging(spark, videos):
    made, segments, captions = videos
    found = machine.machine_segments(segments, captions)
    kinds = Counter(kind for v, (own, told) in made.items() for _, kind, *_ in plain(own, [(s, e, t or "") for s, e, t in told]))
    assert machine.counters(found).first().asDict() == {"segment_count": kinds["segment"], "over_30_line_segment_count": kinds["over_30_line"], "over_ctx_len_segment_count": kinds["over_ctx_len"], "faulty_audio_segment_count": kinds["faulty_audio"], "failed_transcript_count": 1}
    manual = spark.createDataFrame([("m", 0, 0, 4000, "Hello there."), ("m", 1, 4000, 8000, "two dollars"), ("m", 2, 8000, 9000, "more")], "id string, n long, start long, end long, text string")
    heard = spark.createDataFrame([("m", 0, 100, 4100, "hello where"), ("m", 1, 4100, 8100, "$2")], "id string, n long, start long, end long, text string")
    got = {r["n"]: (r["seg_text"], r["mach_seg_text"], r["seg_edit_dist"]) for r in machine.merged(manual, machine.machine_segments(manual, heard)).collect()}
    assert got == {0: ("hello there", "hello where", 0.5), 1: ("$2", "$2", 0.0), 2: ("more", "", 1.0)}
    assert machine.machine_segments(segments.limit(0), captions).where("kind <> 'failed_transcript'").count() == 0 and machine.machine_segments(segments, captions.limit(0)).count() == 0
    assert found.where(F.col("kind") == "segment").select("id").distinct().count() > 50
