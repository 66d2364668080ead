"""Machine captions cut to fit manual segments, with the checks and counters of segments.

Both sides are tables of rows. A document's segments (at most MOST are used) and then its captions stream through one
task; the segments, the run of captions that is being made and one caption ahead are all that is held of a document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T, wer
from .running import scan
from .segments import CONTEXT, MOST, SHORTEST, WINDOW, word_count

MADE = "made array<struct<seg_no:int,kind:string,start:long,end:long,texts:array<string>>>"
#: What may become of captions: a segment, or a line, run or document that is left out.
KINDS = ("segment", "over_30_line", "over_ctx_len", "faulty_audio", "failed_transcript")


class Matcher:
    """A document's state. A run begins with the last caption before the distance of starts stops shrinking and goes on
    until the distance of ends grows; a caption longer than a window is left out and ends what it meets. A run that fails
    a check is left out too, and the segment waits for the next one."""

    def __init__(self, count: Callable[[str], int]):
        self.count, self.wanted, self.k, self.ahead, self.run, self.failed = count, [], 0, None, [], False

    def close(self, last: bool) -> list[tuple]:
        own, self.run = self.run, []
        tokens = sum(self.count(t) for _, _, t in own)
        start, end = own[0][0], own[-1][1]
        over = tokens + 2 * len(own) + (not last) + 2 > CONTEXT and tokens + 3 > CONTEXT
        kind = "over_ctx_len" if over else "faulty_audio" if end - start < SHORTEST else "segment"
        seg_no = self.k if kind == "segment" else None
        self.k += kind == "segment"
        return [(seg_no, kind, start, end, [t for _, _, t in own])]

    def done(self) -> bool:
        return self.failed or self.k >= len(self.wanted)

    def begin(self) -> list[tuple]:
        """The caption ahead starts a run, or is too long to."""
        (start, end, text), self.ahead = self.ahead, None
        if end - start > WINDOW:
            return [(None, "over_30_line", start, end, [text])]
        self.run = [(start, end, text)]
        return []

    def caption(self, start: int, end: int, text: str) -> list[tuple]:
        made = []
        if end < start:
            self.failed = True
            return [(None, "failed_transcript", start, end, [])]
        if self.done():
            return made
        if self.ahead:
            if abs(start - self.wanted[self.k][0]) < abs(self.ahead[0] - self.wanted[self.k][0]):
                self.ahead = (start, end, text)
                return made
            made += self.begin()
        if self.run:
            target = self.wanted[self.k][1]
            if end - start <= WINDOW and abs(end - target) <= abs(self.run[-1][1] - target):
                self.run.append((start, end, text))
                return made
            made += self.close(False)
        self.ahead = (start, end, text)
        return made

    def finish(self) -> list[tuple]:
        if self.failed or self.done():
            return []
        made = self.begin() if self.ahead else []
        return made + (self.close(True) if self.run else [])


def step(state: Matcher, side: int, start: int, end: int, text: str | None) -> tuple[Matcher, list]:
    if side == 0:
        if len(state.wanted) < MOST:
            state.wanted.append((start, end))
        return state, None
    found = state.caption(start, end, text or "") if side == 1 else state.finish()
    return state, [dict(zip(("seg_no", "kind", "start", "end", "texts"), f)) for f in found] or None


def machine_segments(segments: DataFrame, captions: DataFrame, count: Callable[[str], int] = word_count) -> DataFrame:
    """(id, seg_no, kind, start, end, texts) of ``segments`` (id, n, start, end) and ``captions`` (id, n, start, end, text), each in order of n.

    Rows of kind "segment" are numbered as the segments that they fit, without gaps; others are what was left out, with
    seg_no null. A document with a caption that ends before it starts has only that. Times are never null; null texts
    are empty; documents without segments or captions give nothing; repeated rows are captions of their own.
    """
    cast = lambda df, side, text: df.select(F.col("id"), F.lit(side).alias("side"), F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), text.alias("text"))
    nothing = F.lit(None).cast("string")
    ends = captions.select("id").distinct().select("id", F.lit(2).alias("side"), *(F.lit(0).cast("long").alias(c) for c in ("n", "start", "end")), nothing.alias("text"))
    rows = cast(segments, 0, nothing).unionByName(cast(captions, 1, F.col("text"))).unionByName(ends)
    made = scan(rows, "id", ["side", "n"], ["side", "start", "end", "text"], MADE, partial(Matcher, count), step)
    found = made.select("id", F.explode("made").alias("m")).select("id", "m.*")
    bad = F.max((F.col("kind") == "failed_transcript").cast("int")).over(Window.partitionBy("id"))
    return found.withColumn("_bad", bad).where((F.col("_bad") == 0) | (F.col("kind") == "failed_transcript")).drop("_bad")


def counters(made: DataFrame, *by: str) -> DataFrame:
    """How many of each kind, as segment_count, over_30_line_segment_count, ...; failed documents count once."""
    once = made.where("kind = 'failed_transcript'").dropDuplicates(["id"]).unionByName(made.where("kind <> 'failed_transcript'"))
    name = lambda k: "segment_count" if k == "segment" else f"{k}_count" if k == "failed_transcript" else f"{k}_segment_count"
    return once.groupBy(*by).agg(*(F.sum((F.col("kind") == k).cast("long")).alias(name(k)) for k in KINDS))


def merged(segments: DataFrame, made: DataFrame) -> DataFrame:
    """``segments`` (id, n, text, ...) with the machine text of the segment of the same number, "" without one, and seg_edit_dist."""
    own = Window.partitionBy("id").orderBy("n")
    held = segments.withColumn("seg_no", F.row_number().over(own) - 1)
    machine = made.where("kind = 'segment'").select("id", "seg_no", T.machine_text(F.col("texts"), True).alias("said"), F.col("start").alias("mach_start"), F.col("end").alias("mach_end"))
    both = held.join(machine, ["id", "seg_no"], "left")
    man, mach = F.coalesce("text", F.lit("")), F.trim(F.coalesce("said", F.lit("")))
    norm_man, norm_mach = T.normalise_english(man), T.normalise_english(mach)
    shown = lambda norm, raw: F.when(norm != "", norm).otherwise(raw)
    both = both.withColumns({"_nm": norm_man, "_nk": norm_mach, "_m": man, "_k": mach})
    return both.withColumns({
        "seg_text": shown(F.col("_nm"), F.col("_m")), "mach_seg_text": shown(F.col("_nk"), F.col("_k")),
        "seg_edit_dist": wer.distance_ladder(F.col("_m"), F.col("_k"), F.col("_nm"), F.col("_nk"))}).drop("_nm", "_nk", "_m", "_k", "said")
