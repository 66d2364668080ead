"""Members of tar archives, Arrow files, and compressed JSON lines that may end in damage, as a data source of its own.

Files are dealt to the tasks in turn: each task streams its files one after another and holds one part of a member, one
record batch or one block of lines, however large a file is. What cannot be read becomes a
dead letter with the place and the reason, beside all that could be read before it.
"""

from __future__ import annotations

import gzip
import io
import json
import lzma
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Schemes that tasks open themselves; files of others come through Spark, whole.
REACHABLE = ("file", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss", "hdfs")
#: Bytes of a member in one row, and of rows in one batch.
PART, BATCH = 32 << 20, 4 << 20
MEMBERS = "archive string, member string, part int, size long, content binary, error string"
LINES = "file string, line_no long, line string, error string"
DAMAGE = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, ValueError)


def opened(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("s3n://", "s3://"))
    return fs.open_input_file(path)


def tar_rows(uri: str, file, suffixes: tuple[str, ...], part: int) -> Iterator[tuple]:
    """(archive, member, part, size, content, error) of an archive in any compression, as a stream."""
    member = None
    try:
        with tarfile.open(fileobj=file, mode="r|*") as tar:
            for m in tar:
                member = m.name
                if not m.isfile() or not m.name.endswith(suffixes):
                    continue
                source, at = tar.extractfile(m), 0
                while True:
                    content = source.read(min(part, m.size - at))
                    if len(content) < min(part, m.size - at):
                        raise tarfile.ReadError("the archive ends within a member")
                    yield uri, m.name, at // part, m.size, content, None
                    at += len(content)
                    if at >= m.size:
                        break
    except DAMAGE as e:
        yield uri, member, None, None, None, f"{type(e).__name__}: {e}"


def line_rows(uri: str, file) -> Iterator[tuple]:
    """(file, line_no, line, error) up to the first line that is no JSON or cannot be unpacked; blank lines are left out."""
    n, known = 0, DAMAGE
    try:
        if uri.endswith(".zst"):
            import zstandard

            known = (*DAMAGE, zstandard.ZstdError)
            file = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
        elif uri.endswith(".gz"):
            file = gzip.GzipFile(fileobj=file)
        text = io.TextIOWrapper(file, encoding="utf-8")
        while True:
            n += 1
            if not (line := text.readline()):
                return
            if line.strip():
                json.loads(line)
                yield uri, n, line.rstrip("\n"), None
    except known as e:
        yield uri, n, None, f"{type(e).__name__}: {e}"


def arrow_batches(uri: str, names: list[str], first: int, last: int | None) -> Iterator[pa.RecordBatch]:
    """Record batches ``first`` to ``last`` of an Arrow file; of a stream, all."""
    with opened(uri) as file:
        if last is None:
            found = pa.ipc.open_stream(file)
        else:
            reader = pa.ipc.open_file(file)
            found = (reader.get_batch(i) for i in range(first, last))
        for b in found:
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names], names=names)


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(v) for v in row if isinstance(v, (str, bytes))) + 64
        if n >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


ARROW = {
    "tar": pa.schema([("archive", pa.string()), ("member", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]),
    "lines": pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("error", pa.string())]),
}


class FileReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.kind, self.names, self.tasks = options["kind"], names, int(options["tasks"])
        self.uris = json.loads(options["files"])
        self.suffixes, self.part = tuple(json.loads(options.get("suffixes", '[""]'))), int(options.get("part", PART))

    def partitions(self) -> list[InputPartition]:
        """Files dealt in turn; Arrow files, whose ends say where their batches lie, in runs of batches."""
        jobs = [(uri, 0, None) for uri in self.uris]
        if self.kind == "arrow":
            jobs = [job for uri in self.uris for job in self.runs(uri)]
        return [InputPartition(jobs[i :: self.tasks]) for i in range(min(self.tasks, len(jobs)))]

    def runs(self, uri: str, run: int = 16) -> list[tuple]:
        with opened(uri) as file:
            try:
                n = pa.ipc.open_file(file).num_record_batches
            except pa.ArrowInvalid:
                return [(uri, 0, None)]
        return [(uri, at, min(at + run, n)) for at in range(0, n, run)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for uri, first, last in partition.value:
            if self.kind == "arrow":
                yield from arrow_batches(uri, self.names, first, last)
            else:
                with opened(uri) as file:
                    rows = tar_rows(uri, file, self.suffixes, self.part) if self.kind == "tar" else line_rows(uri, file)
                    yield from batches(rows, ARROW[self.kind])


class FileSource(DataSource):
    """Options: kind (tar, lines, arrow), files (JSON list), tasks, suffixes (JSON list), part."""

    @classmethod
    def name(cls) -> str:
        return "sparrowmill_files"

    def schema(self) -> str:
        return MEMBERS if self.options["kind"] == "tar" else LINES

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(dict(self.options), schema.fieldNames())


def listed(spark: SparkSession, path: str | list[str], glob: str) -> list[str]:
    """Files under ``path`` in order; names only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return sorted(r["path"] for r in files.select("path").collect())


def records(spark: SparkSession, uris: list[str], kind: str, schema: str | T.StructType, tasks: int | None = None, **options) -> DataFrame:
    """Rows of ``uris``, dealt to ``tasks`` tasks (as many as the session's default if not said)."""
    if not uris:
        return spark.createDataFrame([], schema)
    if any(u.split(":", 1)[0] not in REACHABLE for u in uris):
        return through_spark(spark, uris, kind, schema, **options)
    spark.dataSource.register(FileSource)
    reader = spark.read.format(FileSource.name()).schema(schema).options(kind=kind, files=json.dumps(uris), tasks=tasks or max(spark.sparkContext.defaultParallelism, 1), **options)
    return reader.load()


def through_spark(spark: SparkSession, uris: list[str], kind: str, schema: str | T.StructType, suffixes: str = '[""]', part: int = PART) -> DataFrame:
    """As ``records``, for stores that only Spark reaches: a file is in its task's memory, at most 2 GB."""
    kind_of = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(found):
        for b in found:
            for uri, raw in zip(b.column(0).to_pylist(), b.column(1)):
                file = pa.BufferReader(raw.as_buffer())
                if kind != "arrow":
                    yield from batches(tar_rows(uri, file, tuple(json.loads(suffixes)), int(part)) if kind == "tar" else line_rows(uri, file), ARROW[kind])
                    continue
                try:
                    reader = pa.ipc.open_file(file)
                    own = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    file.seek(0)
                    own = pa.ipc.open_stream(file)
                for x in own:
                    yield pa.RecordBatch.from_arrays([x.column(n) for n in kind_of.fieldNames()], names=kind_of.fieldNames())

    return spark.read.format("binaryFile").load(uris).select("path", "content").mapInArrow(run, kind_of)


def read_files(names: DataFrame, path: str) -> DataFrame:
    """(name, content) of whole files below ``path``, opened by the tasks as ``names`` (a manifest of ``sinks.committed``) has them.

    No folder is searched, and a task takes a run of neighbouring names: their number is that of the cores, not of the files.
    """
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(found):
        fs, root = pyarrow.fs.FileSystem.from_uri(path.rstrip("/").replace("s3a://", "s3://").replace("s3n://", "s3://"))

        def rows():
            for b in found:
                for name in b.column(0).to_pylist():
                    with fs.open_input_file(f"{root}/{name}") as file:
                        yield name, file.read()

        yield from batches(rows(), schema)

    tasks = 2 * max(names.sparkSession.sparkContext.defaultParallelism, 1)
    return names.select("name").repartitionByRange(tasks, "name").mapInArrow(run, "name string, content binary")


def read_tar(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = (".srt", ".vtt"), glob: str = "*.tar*", rank: int = 0, world: int = 1, part: int = PART) -> DataFrame:
    """MEMBERS of the archives under ``path``: a row for each ``part`` bytes of a member with one of ``suffixes`` and, with ``error``, for each archive that is damaged.

    Members before the damage stay. Of ``world`` readers, each takes the archives dealt to its ``rank`` in turn.
    """
    return records(spark, listed(spark, path, glob)[rank::world], "tar", MEMBERS, suffixes=json.dumps(list(suffixes)), part=part)


def whole_members(members: DataFrame, part: int = PART) -> DataFrame:
    """(archive, member, content) of members that were read to their end; those in several parts are put together."""
    good = members.where("error IS NULL")
    single = good.where(F.col("size") <= part).select("archive", "member", "content")
    parts = good.where(F.col("size") > part).groupBy("archive", "member").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.content))
    return single.unionByName(parts.select("archive", "member", joined.alias("content"), "size").where(F.octet_length("content") == F.col("size")).drop("size"))


def damage(rows: DataFrame) -> DataFrame:
    """Dead letters (id, stage, reason, n) of ``read_tar`` or ``read_lines``: the file, what it broke off with, and how many members or lines before it are whole."""
    name, unit = ("archive", F.col("part") == 0) if "archive" in rows.columns else ("file", F.col("line").isNotNull())
    found = rows.groupBy(F.col(name).alias("id")).agg(F.max("error").alias("reason"), F.sum(F.coalesce(unit, F.lit(False)).cast("long")).alias("n"))
    return found.where("reason IS NOT NULL").select("id", F.lit(name).alias("stage"), "reason", "n")


def tar_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive, subtitle_file, content) of the transcripts in archives, as text."""
    return whole_members(read_tar(spark, path)).select("archive", F.col("member").alias("subtitle_file"), F.decode("content", "UTF-8").alias("content"))


def read_members(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """(archive, member, content) of the members called ``names``."""
    return whole_members(read_tar(spark, path, tuple(names)).where(F.col("member").isin(names)))


def tar_samples(spark: SparkSession, path: str | list[str], parts: int | None = None, rank: int = 0, world: int = 1, seed: int = 42) -> DataFrame:
    """Samples of archive shards: neighbouring members of one name but for the ending are one row (archive, key, parts: ending -> content).

    Shards are dealt to ``world`` readers in turn and grouped as they stream past; with ``parts``, samples are dealt to so
    many parts in the order of a hash with the seed. A sample that its archive's damage cuts off is left out.
    """
    schema = "archive string, key string, parts map<string,binary>"
    arrow = pa.schema([("archive", pa.string()), ("key", pa.string()), ("parts", pa.map_(pa.string(), pa.binary()))])
    name = re.compile(r"((?:.*/)?[^/.]+)\.?(.*)", re.S)

    def run(found):
        def samples():
            now, held = None, {}
            for b in found:
                for archive, member, content, error in zip(*(b.column(k).to_pylist() for k in range(4))):
                    named = name.fullmatch(member or "")
                    key, ending = named.groups() if named else (member, "")
                    if error is None and now == (archive, key):
                        held[ending] = held.get(ending, b"") + content
                        continue
                    if now and not (error is not None and now == (archive, key)):
                        yield *now, held
                    now, held = ((archive, key), {ending: content}) if error is None else (None, {})
            if now:
                yield *now, held

        out, n = [], 0
        for archive, key, held in samples():
            out.append((archive, key, list(held.items())))
            n += sum(map(len, held.values())) + 64
            if n >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    members = read_tar(spark, path, ("",), rank=rank, world=world).select("archive", "member", "content", "error")
    rows = members.mapInArrow(run, schema)
    return rows.repartition(parts, "key").sortWithinPartitions(F.md5(F.concat(F.lit(f"{seed}|"), "key"))) if parts else rows


def read_arrow(spark: SparkSession, path: str | list[str], schema: str | T.StructType, glob: str = "*.arrow") -> DataFrame:
    """Rows of Arrow stream or file formats with the columns of ``schema``; files of the latter are split between tasks."""
    return records(spark, listed(spark, path, glob), "arrow", schema)


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl.zst") -> DataFrame:
    """LINES of JSON files (zstd, gzip or plain) up to each file's damage, which is a row with ``error``."""
    return records(spark, listed(spark, path, glob), "lines", LINES)


def read_until_damage(spark: SparkSession, path: str | list[str], schema: str, glob: str = "*.jsonl.zst") -> DataFrame:
    """Records of compressed JSON lines up to the first line that is none; the rest of that file is left out."""
    lines = read_lines(spark, path, glob).where("error IS NULL")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")
