"""Operators as SQL table functions: ``SELECT * FROM segment(TABLE(captions))``."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import segments

CAPTIONS = ("id", "n", "start", "end", "text")


def schema_of(columns: str) -> T.StructType:
    """The schema of "name type, ..."; made without a session, as functions are analyzed beside it."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def checked_columns(table: AnalyzeArgument, wanted: tuple[str, ...]) -> None:
    if not table.isTable:
        raise ValueError("the first argument has to be a table: segment(TABLE(...))")
    if lost := [c for c in wanted if c not in table.dataType.fieldNames()]:
        raise ValueError(f"the table lacks the columns {lost}")


class Segment:
    """Segments of captions (id, n, start, end, text), rows as of ``segments.segment_table``. Documents are put together and
    captions put in order by what ``analyze`` asks for; a query needs no clauses of its own."""

    @staticmethod
    def analyze(captions: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        checked_columns(captions, CAPTIONS)
        if kind is not None and kind.value not in ("vtt", "srt"):
            raise ValueError("kind is vtt or srt")
        return AnalyzeResult(schema=schema_of(segments.TABLE), partitionBy=[PartitioningColumn("id")], orderBy=[OrderingColumn("n")])

    def __init__(self):
        self.id, self.captions, self.kind = None, [], "vtt"

    def eval(self, captions, kind="vtt"):
        self.id, self.kind = captions["id"], kind
        self.captions.append((captions["start"], captions["end"], captions["text"] or ""))

    def terminate(self):
        if self.captions:
            names = [f.split()[0] for f in segments.TABLE.split(", ")]
            for row in segments.rows_of(None if self.id is None else str(self.id), self.captions, segments.word_count, self.kind):
                yield tuple(row.get(c) for c in names)


def register(spark: SparkSession) -> None:
    """Makes ``segment`` known to the session's SQL."""
    spark.udtf.register("segment", F.udtf(Segment))
