"""Named files as a sink of its own: one file a row, one file of lines a shard, or one archive a shard.

Tasks write into a staging folder of their attempt, with a list of their files beside it. When all have succeeded, a second
job compares the names and moves the files to their places, in as many tasks as the session has cores: the driver handles
one list a task, never the files. The staging folder goes when the job ends or fails, so a failed or repeated task
leaves nothing, and no file is in its place before all are written. A manifest beside the folder lists each file with its
rows and bytes; it is there once all files are in their places.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import posixpath
import tarfile
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST, STAGED = ".manifest.jsonl", "_staged-"
FILES = "name string, rows long, bytes long"
#: Moves that a task has under way.
MOVES = 4


@dataclass
class Written(WriterCommitMessage):
    """Of one task: its attempt, which names its list."""

    attempt: str


def place(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


class FileWriter(DataSourceWriter):
    """Rows (name, content), (name, line) or (name, member, content), by ``kind``: files, lines, tar."""

    def __init__(self, options: dict):
        self.uri, self.kind, self.job = options["path"].rstrip("/"), options["kind"], options["job"]
        fs, root = place(self.uri)
        fs.create_dir(f"{root}/{STAGED}{self.job}/lists", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        fs, root = place(self.uri)
        attempt = uuid.uuid4().hex
        staged = f"{root}/{STAGED}{self.job}/{attempt}"
        # not with its parents: a task that outlives its job has nowhere to write
        fs.create_dir(staged, recursive=False)
        try:
            make = {"files": self.files, "lines": self.lines, "tar": self.archives}[self.kind]
            with fs.open_output_stream(f"{staged}.jsonl", compression=None, buffer_size=1 << 20) as told:
                for path, name, rows, size in make(fs, staged, iterator):
                    told.write((json.dumps({"name": name, "rows": rows, "bytes": size, "staged": f"{attempt}/{posixpath.basename(path)}"}) + "\n").encode())
            return Written(attempt)
        except BaseException:
            if fs.get_file_info(staged).type == pyarrow.fs.FileType.Directory:
                fs.delete_dir(staged)
            raise

    def start(self, fs, staged: str, name: str, seen: set[str]):
        if not name or name in seen or name.startswith(("/", "_")) or ".." in name.split("/"):
            raise ValueError(f"no name for a file of its own: {name!r}")
        seen.add(name)
        path = f"{staged}/{len(seen)}"
        return path, fs.open_output_stream(path, compression=None)

    def files(self, fs, staged, rows):
        seen: set[str] = set()
        for name, content in rows:
            raw = content.encode() if isinstance(content, str) else bytes(content or b"")
            path, out = self.start(fs, staged, name, seen)
            with out:
                out.write(raw)
            yield path, name, 1, len(raw)

    def runs(self, fs, staged, rows, begin, add, end):
        """One file for each run of rows with the same name."""
        seen, now, held, n = set(), None, None, 0
        for row in rows:
            if now is None or row[0] != now[1]:
                if now:
                    end(held)
                    now[2].close()
                    yield now[0], now[1], n, fs.get_file_info(now[0]).size
                path, out = self.start(fs, staged, row[0], seen)
                now, held, n = (path, row[0], out), begin(row[0], out), 0
            add(held, row)
            n += 1
        if now:
            end(held)
            now[2].close()
            yield now[0], now[1], n, fs.get_file_info(now[0]).size

    def lines(self, fs, staged, rows):
        begin = lambda name, out: gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if name.endswith(".gz") else out
        return self.runs(fs, staged, rows, begin, lambda f, row: f.write((row[1] + "\n").encode()), lambda f: f.flush() if not isinstance(f, gzip.GzipFile) else f.close())

    def archives(self, fs, staged, rows):
        def add(tar, row):
            info, raw = tarfile.TarInfo(row[1]), row[2].encode() if isinstance(row[2], str) else bytes(row[2] or b"")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))

        return self.runs(fs, staged, rows, lambda name, out: tarfile.open(fileobj=out, mode="w|gz" if name.endswith(".gz") else "w|"), add, lambda tar: tar.close())

    def commit(self, messages: list[Written | None]) -> None:
        """Only lists of attempts that count are left for ``publish``."""
        fs, root = place(self.uri)
        for m in messages:
            if m:
                fs.move(f"{root}/{STAGED}{self.job}/{m.attempt}.jsonl", f"{root}/{STAGED}{self.job}/lists/{m.attempt}.jsonl")

    def abort(self, messages: list[Written | None]) -> None:
        clear(self.uri, self.job)


def clear(uri: str, job: str) -> None:
    """Tasks that are being stopped may still write; what they leave goes too."""
    fs, root = place(uri)
    for _ in range(50):
        if fs.get_file_info(f"{root}/{STAGED}{job}").type != pyarrow.fs.FileType.Directory:
            return
        try:
            fs.delete_dir(f"{root}/{STAGED}{job}")
        except OSError:
            time.sleep(0.1)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparrowmill_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def mover(uri: str, job: str):
    """Moves staged files to their places, batch by batch. What an earlier attempt of the task has moved is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(uri)
        made: set[str] = set()

        def move(files):
            for name, size, staged in files:
                try:
                    fs.move(f"{root}/{STAGED}{job}/{staged}", f"{root}/{name}")
                except OSError:
                    info = fs.get_file_info(f"{root}/{name}")
                    if fs.get_file_info(f"{root}/{STAGED}{job}/{staged}").is_file or not info.is_file or info.size != size:
                        raise

        with ThreadPoolExecutor(MOVES) as pool:
            for b in batches:
                files = list(zip(*(b.column(c).to_pylist() for c in ("name", "bytes", "staged"))))
                for folder in {posixpath.dirname(f"{root}/{name}") for name, _, _ in files} - made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                list(pool.map(move, itertools.batched(files, 256)))
                yield b.select(["name", "rows", "bytes"])

    return run


def publish(spark: SparkSession, uri: str, job: str, overwrite: bool) -> None:
    """Tasks move what has been staged, each a run of neighbouring names, and write the manifest of it."""
    fs, root = place(uri)
    staged = spark.read.schema(f"{FILES}, staged string").json(f"{uri}/{STAGED}{job}/lists")
    if staged.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two tasks wrote files of one name")
    if overwrite:
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(info.path) != f"{STAGED}{job}":
                (fs.delete_dir if info.type == pyarrow.fs.FileType.Directory else fs.delete_file)(info.path)
    tasks = 2 * max(spark.sparkContext.defaultParallelism, 1)
    staged.repartitionByRange(tasks, "name").mapInArrow(mover(uri, job), FILES).write.mode("overwrite").json(uri + MANIFEST)


def save(rows: DataFrame, path: str, kind: str, overwrite: bool = False) -> None:
    spark, uri, job = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    rows.write.format(FileSink.name()).mode("overwrite" if overwrite else "append").option("kind", kind).option("job", job).save(path)
    try:
        publish(spark, uri, job, overwrite)
    finally:
        clear(uri, job)


def manifest(rows_of: DataFrame, path: str) -> DataFrame:
    """(name, rows, bytes) of the last job's files."""
    return rows_of.sparkSession.read.schema(FILES).json(path.rstrip("/") + MANIFEST)


def write_files(rows: DataFrame, path: str, name: Column, content: Column, overwrite: bool = False) -> None:
    """One file a row, by tasks as they hold the rows; names have to differ."""
    save(rows.select(name.cast("string").alias("name"), content.alias("content")), path, "files", overwrite)


def write_shards(rows: DataFrame, path: str, name: Column, order: list, columns: list[str] | None = None, overwrite: bool = False) -> None:
    """JSON lines (without null fields), gzipped where the name ends so: one file a shard, its rows in ``order``. A shard is written by one task, as a stream."""
    held = rows.withColumn("_name", name.cast("string"))
    lines = held.repartition("_name").sortWithinPartitions("_name", *order)
    save(lines.select("_name", F.to_json(F.struct(*(columns or rows.columns))).alias("line")), path, "lines", overwrite)


def write_archives(rows: DataFrame, path: str, shard: Column, member: Column, content: Column, overwrite: bool = False) -> None:
    """Archives of members in order of their names, one a shard."""
    held = rows.select(shard.cast("string").alias("name"), member.cast("string").alias("member"), content.alias("content"))
    save(held.repartition("name").sortWithinPartitions("name", "member"), path, "tar", overwrite)
