"""Rows of a key in order, with what carries from one to the next, without gathering a key into one row.

Where a window function says it, windows do it; ``scan`` carries any state through a key's rows as they stream past in
Arrow batches, so that a key may have any number of them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X


def scan(rows: DataFrame, key: str, order: list[str], inputs: list[str], added: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """``rows`` with the column ``added`` ("name type"): ``step(state, *inputs)`` gives the next state and the row's value.

    States begin anew with each value of ``key`` (null is one); a key's rows are in one task, in ``order``. Rows are sorted
    by Spark, which spills, and streamed; only the state is held.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(added).fields])
    name, kind = schema.fieldNames()[-1], to_arrow_schema(schema)[-1].type

    def run(batches):
        state, last, begun = None, None, False
        for b in batches:
            keys, columns, out = b.column(key).to_pylist(), [b.column(c).to_pylist() for c in inputs], []
            for k, *values in zip(keys, *columns):
                if not begun or k != last:
                    state, last, begun = start(), k, True
                state, value = step(state, *values)
                out.append(value)
            yield b.append_column(name, pa.array(out, kind))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def pack_numbers(rows: DataFrame, key: str, order: list[str], start: str, end: str, most: float) -> DataFrame:
    """``rows`` with ``pack``: a pack closes when the next end lies more than ``most`` after its start."""

    def step(state, a, b):
        first, pack = state
        if first is None or round(b - first, 6) > most:
            first, pack = a, pack + 1
        return (first, pack), pack

    return scan(rows, key, order, [start, end], "pack int", lambda: (None, -1), step)


def running_times(rows: DataFrame, key: str, order: str, start: str = "start", end: str = "end") -> DataFrame:
    """``rows`` whose times start anew now and then, on one time line: each fresh start adds the span so far."""
    own = Window.partitionBy(key).orderBy(order)
    before, zero = F.lag(end).over(own), F.first(start).over(own)
    held = rows.withColumn("_reset", F.when(F.col(start) < before, before - zero).otherwise(0.0))
    offset = F.sum("_reset").over(own)
    return held.withColumns({start: F.col(start) + offset, end: F.col(end) + offset}).drop("_reset")


def spoken(rows: DataFrame, key: str, order: str, filler: str, text: str = "text") -> DataFrame:
    """The rows of each key before its first filler, trimmed, without blank ones; a last row's closing "foreign" goes."""
    own = Window.partitionBy(key)
    tidy = F.trim(F.col(text))
    stop = F.min(F.when(tidy.rlike(filler), F.col(order))).over(own)
    kept = rows.withColumn("_stop", stop).where((F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))) & (tidy != ""))
    clean = kept.withColumns({text: F.trim(X.join_lines(tidy)), "_last": F.max(order).over(own) == F.col(order)})
    return clean.withColumn(text, F.when(F.col("_last"), X.strip_foreign(F.col(text))).otherwise(F.col(text))).drop("_stop", "_last")


def time_slices(rows: DataFrame, key: str, order: str, token: str, first_time: int = 50363) -> DataFrame:
    """(key, k, start, end, n_tokens) of decoder output, a row a token, cut between neighbouring time tokens.

    A single time token at the end closes the last slice; tokens after the last cut are left for the next window. Without
    a cut all tokens are one slice from 0 to the last time token, or to null if there is none but the first.
    """
    own, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    is_time = F.col(token) >= first_time
    marked = rows.select(key, F.col(order).alias("o"), F.col(token).alias("t"), is_time.alias("timed"), F.lag(is_time).over(own).alias("before"), F.lead(F.lit(True)).over(own).isNull().alias("final"))
    cut = marked.withColumn("k", F.sum((F.col("timed") & F.coalesce("before", F.lit(False))).cast("int")).over(Window.partitionBy(key).orderBy("o")))
    closes = F.max(F.when(F.col("final"), F.col("timed") & ~F.coalesce("before", F.lit(True)))).over(whole)
    kept = cut.withColumns({"cuts": F.max("k").over(whole), "closes": closes}).where((F.col("cuts") == 0) | (F.col("k") < F.col("cuts")) | F.col("closes"))
    found = kept.groupBy(key, "cuts", "k").agg(
        F.min_by("t", "o").alias("a"), F.max_by("t", "o").alias("b"), F.max_by("t", F.when(F.col("timed"), F.col("o"))).alias("z"), F.max("timed").alias("any"), F.count("*").alias("n"))
    none = F.col("cuts") == 0
    end = F.when(none, F.when(F.col("any"), F.nullif(F.col("z") - first_time, F.lit(0)))).otherwise(F.col("b") - first_time)
    return found.select(key, F.col("k").cast("int").alias("k"), F.when(none, 0).otherwise(F.col("a") - first_time).alias("start"), end.cast("int").alias("end"), F.col("n").cast("int").alias("n_tokens"))


