"""Streams: per-session text buffers, event-time counts, and tagging of new files only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def buffered(stream: DataFrame, timeout_ms: int | None = 600_000, buffer: int | None = None) -> DataFrame:
    """For each session of (session, seq, chunk): its whole text after every batch (the last ``buffer`` characters if given),
    n_seen (characters since it was last cleared) and n_chars; a chunk null clears it, silence of ``timeout_ms`` too. A stream
    that only drains what is there takes no timeout (None), as one would keep it running."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, seen = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for chunk in rows["chunk"]:
            text, seen = ("", 0) if chunk is None else (text + chunk, seen + len(chunk))
        text = text[-buffer:] if buffer else text
        state.update((text, seen))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"session": [key[0]], "text": [text], "n_chars": [len(text)], "n_seen": [seen]})

    return stream.groupBy("session").applyInPandasWithState(step, "session string, text string, n_chars long, n_seen long", "text string, n_seen long", "update", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


#: The store that list state and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", provider: str | None = None) -> None:
    """Runs a stream over all input there is, appending each batch with its number (``batch_no``) to Parquet in ``path``; with a state store of its own if ``provider`` names one."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if provider:
        conf.set(name, provider)

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(path)

    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)


def new_files_only(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """``work`` on the rows of files that no earlier call with this checkpoint has seen; their results are added to ``path``."""
    drain(work(stream), path, checkpoint)


class Buffer(StatefulProcessor):
    """A session's chunks as a list that only grows at its end, and the number of characters that it has; a timer clears what is silent."""

    def __init__(self, timeout_ms: int | None, emit_text: bool):
        self.timeout_ms, self.emit_text = timeout_ms, emit_text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "chunk string")
        self.seen = handle.getValueState("seen", "n long")

    def clear(self) -> int:
        self.chunks.clear()
        self.seen.clear()
        return 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        new: list[tuple[str]] = []
        for chunk in pd.concat(list(rows)).sort_values("seq")["chunk"]:
            if chunk is None:
                n, new = self.clear(), []
            else:
                n += len(chunk)
                new.append((chunk,))
        if new:
            self.chunks.appendList(new)
            self.seen.update((n,))
        if self.timeout_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        text = "".join(c[0] for c in self.chunks.get()) if self.emit_text and n else ""
        yield pd.DataFrame({"session": [key[0]], "text": [text], "n_chars": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield pd.DataFrame({"session": [key[0]], "text": [""], "n_chars": [0]})

    def close(self) -> None:
        pass


def appended(stream: DataFrame, timeout_ms: int | None = 600_000, emit_text: bool = True) -> DataFrame:
    """As ``buffered`` for whole texts, with state that is only added to: a batch writes its new chunks, not the text so far.

    Returns session, text ("" without ``emit_text``, for those who read the state at the end) and n_chars after each batch.
    """
    return stream.groupBy("session").transformWithStateInPandas(Buffer(timeout_ms, emit_text), "session string, text string, n_chars long", "Update", "ProcessingTime" if timeout_ms else "None")


def session_texts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, text, n_chars) from the state that a stopped stream of ``appended`` left in its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "chunks").option("flattenCollectionTypes", False).load(checkpoint)
    text = F.array_join(F.transform(F.col("list_value"), lambda c: c["chunk"]), "")
    return held.select(F.col("key.session").alias("session"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
