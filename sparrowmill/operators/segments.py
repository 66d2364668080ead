"""Greedy packing of captions into windows of at most 30 s, with silent windows, one document at a time.

Documents are rows, so no shuffle is needed; the loop over a document's captions carries state and runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timecode
from ..functions.tokens import context_modes
from .running import pack_numbers

WINDOW, MOST, CONTEXT, SHORTEST = 30_000, 120, 448, 15
#: Documents that a task turns to Python objects at once.
AT_ONCE = 32
#: Rows that leave a task at once.
ROWS = 1024
SCHEMA = "id string, seg_id long, start_ms long, length_ms long, n_captions long, text string, silent boolean, reason string"
#: What happened to a document's windows; columns of ``segment_table`` and of ``counters``.
COUNTERS = ("segment_count", "over_30_line_segment_count", "bad_text_segment_count", "over_ctx_len_segment_count", "faulty_audio_segment_count", "failed_transcript_count")
TABLE = (
    "id string, seg_no long, seg_id string, audio_timestamp string, text_timestamp string, start_ms long, length_ms long, norm_end_ms long, seg_content string, silent boolean, "
    "ts_mode boolean, no_ts_mode boolean, only_no_ts_mode boolean, num_tokens_ts_mode long, num_tokens_no_ts_mode long, audio_file string, reason string, "
    + ", ".join(f"{c} long" for c in COUNTERS)
)


def windows(captions: list[tuple[int, int, str]], window: int = WINDOW) -> tuple[list[tuple[int, int, list]], int, str | None]:
    """Windows (start, end, captions), captions longer than the window, and why the document failed.

    Equal (start, end) keys are one caption with the last text. A caption longer than the window is left out and counted.
    A gap before a caption that does not fit becomes silent windows, full ones and a remainder that the caption may share
    only after full ones. A caption that ends before its window starts fails the document.
    """
    own: dict[tuple[int, int], str] = {}
    for start, end, text in captions:
        own[start, end] = text
    out, long, held = [], 0, []
    at = None

    def flush() -> None:
        nonlocal held
        if held:
            out.append((at, held[-1][1], held))
        held = []

    for (start, end), text in own.items():
        if at is None:
            at = start
        if end < at or end < start:
            return [], long, "backwards"
        if end - start > window:
            flush()
            at, long = end, long + 1
            continue
        if held and end - at > window:
            last = held[-1][1]
            flush()
            at = last
        if not held and end - at > window:
            gap = start - at
            if gap >= window:
                for _ in range(gap // window):
                    out.append((at, at + window, []))
                    at += window
                if end - at > window:
                    out.append((at, start, []))
                    at = start
            elif gap > 0:
                out.append((at, start, []))
                at = start
            else:
                at = start
        held.append((start, end, text))
    flush()
    return out, long, None


def segment(captions: list[tuple[int, int, str]], window: int = WINDOW, most: int = MOST) -> tuple[list[tuple], int, str | None]:
    """The first ``most`` windows as (start, length, captions, text, silent), captions longer than the window, and why the document failed."""
    found, long, reason = windows(captions, window)
    return [(a, b - a, len(own), "\n".join(t for _, _, t in own), not own) for a, b, own in found[:most]], long, reason


def clock(ms: int, sign: str = ".") -> str:
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02}{sign}{ms % 1000:03}"


def subtitles(own: list[tuple[int, int, str]], begin: int, kind: str) -> str:
    """A subtitle file of captions with times from ``begin`` on; what lies before it counts from zero."""
    sign = "," if kind == "srt" else "."
    body = "".join(f"{f'{k}' + chr(10) if kind == 'srt' else ''}{clock(max(0, a - begin), sign)} --> {clock(max(0, b - begin), sign)}\n{t}\n\n" for k, (a, b, t) in enumerate(own, 1))
    return ("WEBVTT\n\n" if kind == "vtt" else "") + body


def usable(captions: list[tuple[int, int, str]], count: Callable[[str], int], most: int | None = None) -> tuple[list[tuple], dict[str, int], str | None]:
    """The document's usable windows (start, end, captions, whether it is the last, tokens with and without times), its counters,
    and why it failed.

    A window of speech needs captions in order within it (else bad_text), a number of tokens that fits with or without
    times (else over_ctx_len), and 15 ms of sound (else faulty_audio). All windows are looked at, unless ``most`` is given:
    then none after that many usable ones.
    """
    found, long, reason = windows(captions)
    n = dict.fromkeys(COUNTERS, 0) | {"over_30_line_segment_count": long, "failed_transcript_count": int(reason is not None)}
    out = []
    for k, (a, b, own) in enumerate(found):
        if len(out) == most:
            break
        tokens = sum(count(t.strip()) for _, _, t in own)
        last = k == len(found) - 1
        timed, plain = tokens + 2 * len(own) + (not last) + 2, tokens + 3
        if own and not all(own[0][0] <= x <= y <= own[-1][1] <= b for x, y, _ in own):
            n["bad_text_segment_count"] += 1
        elif own and timed > CONTEXT and plain > CONTEXT:
            n["over_ctx_len_segment_count"] += 1
        elif b - a < SHORTEST:
            n["faulty_audio_segment_count"] += 1
        else:
            out.append((a, b, own, last, timed, plain))
    n["segment_count"] = len(out)
    return out, n, reason


def described(seg_no: int, window: tuple, kind: str) -> dict:
    """A usable window as a segment."""
    a, b, own, last, timed, plain = window
    early = any(x < a for x, _, _ in own)
    return {
        "seg_no": seg_no, "audio_timestamp": f"{clock(a, ',')}_{clock(b if last or not own else a + WINDOW, ',')}", "text_timestamp": f"{clock(a, ',')}_{clock(b, ',')}", "start_ms": a, "length_ms": b - a,
        "norm_end_ms": b - a, "seg_content": subtitles(own, a, kind), "silent": not own, "ts_mode": timed <= CONTEXT, "no_ts_mode": plain <= CONTEXT, "only_no_ts_mode": early, "num_tokens_ts_mode": timed if own else 0, "num_tokens_no_ts_mode": plain if own else 0}


def checked(captions: list[tuple[int, int, str]], count: Callable[[str], int], kind: str = "vtt", most: int | None = MOST) -> tuple[list[dict], dict[str, int], str | None]:
    """The first ``most`` usable segments of one document (all with None), its counters up to there, and why it failed; tables
    have all segments (``rows_of``)."""
    found, n, reason = usable(captions, count, most)
    return [described(k, w, kind) for k, w in enumerate(found)], n, reason


def word_count(text: str) -> int:
    return len(text.split())


def rows_of(key: str | None, captions: list[tuple[int, int, str]], count: Callable[[str], int], kind: str) -> Iterator[dict]:
    """A document's rows of TABLE, one after another: all its segments."""
    found, n, reason = usable(captions, count)
    if not found:
        yield {"id": key, "reason": reason or "no segment"} | n
    for k, w in enumerate(found):
        s = described(k, w, kind)
        yield {"id": key} | s | {"seg_id": f"{key}_{k}", "audio_file": f"{key}/{s['audio_timestamp']}.npy"} | (n if k == 0 else {})


def tuples(lists: pa.ListArray, *fields: str) -> list[list[tuple]]:
    """Lists of structs as lists of tuples of ``fields``; null lists are empty."""
    flat = lists.flatten()
    own = dict(zip((f.name for f in flat.type), flat.flatten()))
    values, out, at = list(zip(*(own[f].to_pylist() for f in fields))), [], 0
    for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
        out.append(values[at : at + n])
        at += n
    return out


def by_document(docs: DataFrame, rows: Callable[..., Iterable[dict]], result: str, **arrays: tuple[str, ...]) -> DataFrame:
    """``rows(id, *lists)`` of each row of ``docs``, as ``result``; ``arrays`` names columns and the fields to take.

    A few documents at a time become Python objects, and what they give leaves a few rows at a time, so that a task's memory
    doesn't grow with the documents of an Arrow batch.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in result.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                lists = [tuples(some.column(c), *fields) for c, fields in arrays.items()]
                found = (r for own in zip(some.column("id").to_pylist(), *lists) for r in rows(*own))
                while piece := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_pylist(piece, schema=schema)

    return docs.select(F.col("id").cast("string").alias("id"), *arrays).mapInArrow(run, result)


def segment_table(docs: DataFrame, count: Callable[[str], int] = word_count, kind: str = "vtt") -> DataFrame:
    """Segments of ``docs`` (id, captions) that pass all checks, as TABLE. The counters stand on a document's first row;
    a document without a segment is one row that has only them and its reason."""
    return by_document(docs, lambda key, captions: rows_of(key, captions, count, kind), TABLE, captions=("start", "end", "text"))


def counters(table: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters, and the hours that the documents with segments stand for at 30 s each."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return table.groupBy(*by).agg(*sums, F.count_distinct(F.when(F.col("seg_no").isNotNull(), F.col("id"))).alias("video_id_count")).withColumn("dur_by_video_id_count", F.col("video_id_count") * 30 / 3600)


def dead_letters(table: DataFrame) -> DataFrame:
    """(id, stage, reason, n) of what segmentation left out."""
    kinds = {c: c.removesuffix("_segment_count").removesuffix("_transcript_count") for c in COUNTERS[1:]}
    entries = F.array(*(F.struct(F.lit(name).alias("reason"), F.col(c).alias("n")) for c, name in kinds.items()))
    return table.select("id", F.lit("segment").alias("stage"), F.explode(entries).alias("e")).select("id", "stage", "e.*").where("n > 0")


def segments(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (id, captions: array of start, end, text); a failed document gives one row with its reason."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(key: str | None, captions: list[tuple[int, int, str]]) -> list[dict]:
        found, long, reason = segment(captions)
        out = [dict(zip(names, (key, k, *s))) for k, s in enumerate(found)]
        return out if found and not reason else [*out, {"id": key, "reason": reason or f"no segment, {long} long captions"}]

    return by_document(docs, rows, SCHEMA, captions=("start", "end", "text"))


def pack_count(sizes: Column, most: int) -> Column:
    """Packs that a greedy fold of ``sizes`` makes: a pack closes when the next item would pass ``most``."""
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("packs"))
    fits = lambda s, x: (s.packs > 0) & (s.filled + x <= most)
    fold = F.aggregate(sizes, start, lambda s, x: F.struct(F.when(fits(s, x), s.filled + x).otherwise(x).alias("filled"), F.when(fits(s, x), s.packs).otherwise(s.packs + 1).alias("packs")))
    return fold.packs


def pack_utterances(utterances: DataFrame, most: float = WINDOW / 1000, limit: int = CONTEXT) -> DataFrame:
    """Utterances (utt_id ``<base>-<5 digits>-<start>-<end>``, text) joined to segments of one base and at most ``most`` seconds.

    Returns utt_id (base, running number, first start, last end), text, ts (from the segment's start), dur, ts_mode,
    no_ts_mode; a single utterance that is longer stands alone; ids of another form and segments over the context are
    left out. The utterances of a recording stream through one task in order; a row gathers those of one segment.
    """
    part = lambda k: F.regexp_extract("utt_id", r"^(.*)-\d{5}-(\d{3,})-(\d{3,})$", k)
    rows = utterances.where(part(2) != "").select(
        part(1).alias("base"), part(2).alias("from"), part(3).alias("to"), timecode.utterance_seconds(part(2)).alias("start"), timecode.utterance_seconds(part(3)).alias("end"), "utt_id", "text")
    numbered = pack_numbers(rows, "base", ["utt_id"], "start", "end", most)
    packs = numbered.groupBy("base", "pack").agg(F.array_sort(F.collect_list(F.struct("utt_id", "start", "end", "from", "to", "text"))).alias("u"), F.max("pack").alias("m"))
    last = F.col("pack") == F.max("pack").over(Window.partitionBy("base"))
    first = F.col("u")[0]
    tokens = context_modes(F.col("u.text"), last, limit=limit)
    found = packs.select(
        F.concat_ws("-", "base", F.lpad(F.col("pack").cast("string"), 5, "0"), first["from"], F.element_at("u.to", -1)).alias("utt_id"), F.col("u.text").alias("text"),
        F.transform("u", lambda x: F.struct(F.round(x.start - first["start"], 6).alias("start"), F.round(x.end - first["start"], 6).alias("end"))).alias("ts"),
        F.round(F.element_at("u.end", -1) - first["start"], 6).alias("dur"), tokens.alias("k"))
    return found.where(~F.col("k.over")).select("utt_id", "text", "ts", "dur", "k.ts_mode", "k.no_ts_mode")
