"""Declarative filters: an ordered list of steps; the first failing one names the row's hit, else ``pass``.

A missing tag or a null passes; NaN fails every bound. Steps take ``ref_value`` or ``reference_value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import clean_caption
from ..sources.transcripts import captions, write_subtitles

KEYS = {"tag", "ref_value", "reference_value", "comparison", "lower_bound", "upper_bound", "inclusive"}


def clean_content(content: Column) -> Column:
    """Subtitle text with every caption cleaned; text without captions is passed through."""
    own = F.transform(captions(content), lambda c: c.withField("text", clean_caption(c.text)))
    zero = F.lit(0).cast("long")

    def made(c: Column) -> Column:
        return F.when(F.size(c) == 0, content).when(content.startswith("WEBVTT"), write_subtitles(c, zero)).otherwise(write_subtitles(c, zero, "srt"))

    # as a lambda's variable the captions are found once, not in each branch
    return F.transform(F.array(own), lambda c: made(c))[0]


def load_config(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)["pipeline"]


def predicate(step: dict, schema: T.StructType) -> Column | None:
    """The step's test by the type of its tag: boolean, then string, then number; None if the tag is missing."""
    if odd := set(step) - KEYS:
        raise ValueError(f"unknown keys: {sorted(odd)}")
    name, value = step["tag"], step.get("ref_value", step.get("reference_value"))
    if name not in schema.fieldNames():
        return None
    kind, col = schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return col == F.lit(value)
    if isinstance(kind, T.StringType):
        within = col.isin(*(value if isinstance(value, list) else [value]))
        return ~within if step.get("comparison", "in") == "not_in" else within
    tests, closed = [~F.isnan(col.cast("double"))], step.get("inclusive", True)
    if step.get("lower_bound") is not None:
        tests.append(col >= step["lower_bound"] if closed else col > step["lower_bound"])
    if step.get("upper_bound") is not None:
        tests.append(col <= step["upper_bound"] if closed else col < step["upper_bound"])
    out = tests[0] if len(tests) > 1 else F.lit(True)
    for t in tests[1:]:
        out = out & t
    return out


#: Steps that rewrite their column and reject nothing.
MUTATIONS = {"seg_content": clean_content}


def with_hit(rows: DataFrame, steps: list[dict]) -> DataFrame:
    """``rows`` with ``hit``; the order of cases keeps the attribution to the first failing step.

    A step that only names a column of ``MUTATIONS`` cleans it; later steps see the cleaned text.
    """
    out, tests = rows, []
    for k, s in enumerate(steps):
        if s["tag"] in MUTATIONS and set(s) == {"tag"}:
            if s["tag"] in out.columns:
                out = out.withColumn(s["tag"], MUTATIONS[s["tag"]](F.col(s["tag"])))
        elif (p := predicate(s, out.schema)) is not None:
            name = f"__step_{k}"
            out = out.withColumn(name, ~F.coalesce(p, F.lit(True)))
            tests.append((s["tag"], name))
    hit = F.coalesce(*(F.when(F.col(name), t) for t, name in tests), F.lit("pass"))
    return out.withColumn("hit", hit).drop(*(name for _, name in tests))


def hit_list(hits: DataFrame) -> DataFrame:
    return hits.groupBy("hit").agg(F.count("*").alias("n"))


def step_report(hits: DataFrame, steps: list[dict]) -> DataFrame:
    """Hits of each step, their share of all rows and of the rows that reached the step."""
    order = F.create_map(*(x for i, s in enumerate(steps) for x in (F.lit(s["tag"]), F.lit(i))))
    counts = hit_list(hits).withColumn("step", F.coalesce(order[F.col("hit")], F.lit(len(steps))))
    every = Window.partitionBy(F.lit(0))  # one row a step
    before = every.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(every)
    left = total - F.coalesce(F.sum("n").over(before), F.lit(0))
    return counts.select("step", "hit", "n", F.round(F.col("n") / total, 6).alias("of_all"), F.round(F.col("n") / left, 6).alias("of_rest"))


def survival(hits: DataFrame) -> DataFrame:
    """Rows, characters and hours (30 s a row) before and after."""
    kept = F.col("hit") == "pass"
    return hits.agg(
        F.count("*").alias("rows_in"), F.coalesce(F.sum(kept.cast("long")), F.lit(0)).alias("rows_kept"), F.sum(F.length("text").cast("long")).alias("chars_in"),
        F.coalesce(F.sum(F.when(kept, F.length("text").cast("long"))), F.lit(0)).alias("chars_kept")
    ).withColumns({"hours_kept": F.round(F.col("rows_kept") * 30 / 3600, 6), "share_kept": F.round(F.col("rows_kept") / F.col("rows_in"), 6)})
