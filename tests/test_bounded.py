"""What a task holds or reads doesn't grow with the rows it gets."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import align, segments
from sparrowmill.sinks import committed, outputs


class Tasks:
    """Stands for a table: gives the function that tasks run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("operator", [segments.segment_table, segments.segments, align.nearest_align])
def test_documents_leave_a_few_at_a_time(spark, operator):
    captions = [{"start": i * 9000, "end": i * 9000 + 8000, "text": f"t{i}"} for i in range(9)]
    spans = [{k: c[k] for k in ("start", "end")} for c in captions]
    docs = [{"id": str(i), "captions": None if i == 7 else captions, "segments": spans} for i in range(1000)]
    names = ("id", "segments", "captions") if operator is align.nearest_align else ("id", "captions")
    held = pa.RecordBatch.from_pylist([{n: d[n] for n in names} for d in docs])
    out = [b.to_pydict() for b in operator(Tasks())(iter([held]))]
    assert max(len(set(b["id"])) for b in out) <= segments.AT_ONCE
    assert {i for b in out for i in b["id"]} == {d["id"] for d in docs if d["id"] != "7" or operator is not align.nearest_align}


def test_a_file_in_parts_by_task(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 2 == 0, "a.b/kept.jsonl.gz").otherwise("odd"), F.col("id").cast("string"), F.col("id").cast("string")).toDF("name", "line", "order")
    outputs.write_parts(path, rows, split=True)
    parts = committed.manifest(rows, path)
    assert parts.agg(F.max("rows")).first()[0] <= 250 and parts.count() == 16
    files = parts.groupBy(outputs.file_of(F.col("name")).alias("f")).agg(F.sum("rows").alias("n"))
    assert {tuple(r) for r in files.collect()} == {("a.b/kept.jsonl.gz", 2000), ("odd", 2000)}
    assert spark.read.text(f"{path}/a.b/kept-*.jsonl.gz").distinct().count() == 2000


def test_tasks_of_the_run_report(spark, tmp_path, monkeypatch):
    """With more input files there are more parts; the counters stay those of the files."""
    from sparrowmill.plans import registry

    texts = [(i, f"text {i}", "en", "s", 6) for i in range(80)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 80, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    save = committed.save
    monkeypatch.setattr(committed, "save", lambda rows, path, *more: (seen.append(path), save(rows, path, *more)))
    got = {(r["stage"], r["counter"]): r["value"] for r in registry.QUERIES["q_run_report"](spark, str(tmp_path)).collect()}
    assert got["files", "kept.jsonl.gz"] == 80 and got["files", "missing.jsonl.gz"] == 40
    most = committed.manifest(spark.range(1), seen[0]).where("name LIKE 'kept%'").agg(F.max("rows")).first()[0]
    assert most < 80


def test_tokens_by_the_library_and_without():
    """Short texts go to the library if it is there; results are those of the own merging."""
    from sparrowmill.functions import bpe
    from sparrowmill.plans import registry

    fast, plain = bpe.Vocabulary(registry.vocabulary_path()), bpe.Vocabulary(registry.vocabulary_path())
    assert fast.library
    plain.library = None
    r = random.Random(4)
    made = ["".join(r.choices("the ingéßá日本 \n\t\r'sll0 1.,!?_-🙂 　", k=r.randint(0, 60))) for _ in range(2000)]
    for t in ["", " ", "'s 'll I'm", "a" * 5000, "é" * 3000, " " * 150_000 + "x", "<|endoftext|>", *made]:
        assert fast.encode(t) == plain.encode(t) and fast.count(t) == plain.count(t) == len(plain.encode(t))


def test_captions_are_found_once(spark):
    """Cleaning splits a content once, and looks for times once in each of its blocks."""
    from sparrowmill.operators import filters

    rows = spark.createDataFrame([("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\na  =b\n\n",), ("none",), (None,)], "x string").select(filters.clean_content(F.col("x")).alias("y"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("-->[ ") == 3
    assert [r["y"] for r in rows.collect()] == ["WEBVTT\n\n00:00:01.000 --> 00:00:02.000\na b\n\n", "none", None]
