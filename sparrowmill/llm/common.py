"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparrowmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What the operators wrote in this process, in order: (path, table or None), None once it is gone.
_MADE: list[tuple[str, str | None] | None] = []


def made(spark: SparkSession) -> int:
    """How many intermediate tables have been written so far."""
    return len(_MADE)


def sweep(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Deletes the intermediate tables written from ``start`` to ``end``; for when the results made of them are written."""
    for i in range(start, len(_MADE) if end is None else end):
        if _MADE[i]:
            path, table = _MADE[i]
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            _MADE[i] = None


def stash(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _MADE.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str, parts: int, codec: str = "none") -> DataFrame:
    """Write ``df`` bucketed by ``key`` in the shared folder: later joins on ``key`` shuffle the other side only."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df.repartition(parts, key).write.bucketBy(parts, key).option("compression", codec).option("path", path).saveAsTable(name))
    _MADE.append((path, name))
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches, rows: int = 256):
    """The batches in parts of at most ``rows`` rows, so that what a part makes in Python stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before each as make it differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def tokenizer_path(name: str) -> str:
    """A public tokenizer file: a path is used as it stands, a bare name is looked up."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
