"""Queries against their SQL on inputs that the given tables don't have."""

import os

import duckdb
import pytest

from sparrowmill.operators import align
from sparrowmill.plans import registry


def rows_of(frame):
    return sorted(repr(r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


def same(spark, path, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(path):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{path}/{t}/*.parquet'")
    got, want = registry.QUERIES[name](spark, path).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert len(want) and rows_of(got) == rows_of(want)


@pytest.fixture(scope="module")
def odd_lines(spark, tmp_path_factory):
    """Lines that end in their own number, or are surrounded by spaces of several scripts."""
    path = str(tmp_path_factory.mktemp("odd-lines"))
    texts = ["a 0\nb 1\nc 22\n3 d 3", " A b　\n   \nc  ", "\t x \t\n ", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["q_extract_text", "q_seg_text", "q_casing", "q_casing_stats"])
def test_trimmed_lines(spark, odd_lines, name):
    same(spark, odd_lines, name)


@pytest.fixture(scope="module")
def long_users(spark, tmp_path_factory):
    """Users of up to 900 events, far more than 120 segments; late ones are of too many words or too long for a window."""
    path = str(tmp_path_factory.mktemp("long-users"))
    said = lambda u, i: "w " * 460 if u == 1 and i in (3, 390, 391) else "view"
    took = lambda u, i: 200.0 if i % 100 == 99 else (7 * i + u) % 90
    rows = [(1000 * u + i, u, said(u, i), float(took(u, i))) for u, n in ((1, 400), (2, 900), (3, 5)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["q_dead_letters", "q_nearest_align", "q_segment_table", "q_segment_counters"])
def test_all_segments_of_long_documents(spark, long_users, name):
    same(spark, long_users, name)


def test_nearest_of_many_segments():
    spans = [(i * 1000, i * 1000 + 900) for i in range(500)]
    assert align.nearest(spans, spans) == [(i, i + 1) for i in range(500)]
