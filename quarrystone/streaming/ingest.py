"""Incremental work as Structured Streaming: idempotent upserts, a visited set, and conversation histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import normalize_url
from ..sources.collections import Collections


def upsert_stream(stream: DataFrame, to_points: Callable[[DataFrame], DataFrame], store: Collections, collection: str, checkpoint: str) -> DataStreamWriter:
    """Every micro-batch is turned to points and upserted. A batch that is run again changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            store.upsert(collection, to_points(batch))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def first_visits(requests: DataFrame) -> DataFrame:
    """Requests (project, url) whose normalised url is new to the project, over the life of the stream."""
    return requests.withColumn("url", normalize_url("url")).dropDuplicates(["project", "url"])


def recent_visits(requests: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with state that ends: a url counts as new again once the watermark has passed it."""
    return requests.withColumn("url", normalize_url("url")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["project", "url"])


def histories(turns: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, n_turns, history) after each micro-batch, from turns (conv_id, turn, role, text); keyed state.

    keep: only so many last turns stay, for conversations without an end; all by default.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        rows = [list(r) for r in held]
        for f in frames:
            n += len(f)
            rows += [[int(t), f"{r}: {x}"] for t, r, x in zip(f["turn"], f["role"], f["text"], strict=True)]
        rows = sorted(rows)[-keep:] if keep else sorted(rows)
        state.update((n, [tuple(r) for r in rows]))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "history": ["\n".join(r[1] for r in rows)]})

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, n_turns long, history string", "n long, rows array<struct<turn:long,line:string>>", "update", "NoTimeout")


class Memory(StatefulProcessor):
    """Turns of one conversation as a list in the state store: a batch appends its own and rewrites none."""

    def __init__(self, ttl_ms: int | None, whole: bool):
        self.ttl_ms, self.whole = ttl_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, line string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = []
        for f in rows:
            lines = [None if pd.isna(r) or pd.isna(x) else f"{r}: {x}" for r, x in zip(f["role"], f["text"], strict=True)]
            got += [(None if pd.isna(t) else int(t), line) for t, line in zip(f["turn"], lines, strict=True)]
        if got:
            self.turns.appendList(got)
        held = list(self.turns.get()) if self.whole else got
        held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(held)], "history": ["\n".join(r[1] for r in held if r[1] is not None)]})

    def close(self) -> None:
        pass


def live_memory(turns: DataFrame, ttl_ms: int | None = None, whole: bool = True) -> DataFrame:
    """(conv_id, n_turns, history) of each conversation that a micro-batch touches, as thread_history would give it then.

    turns: (conv_id, turn, role, text), in any order and split; a turn that comes again counts again, as it does in a batch. Turns of
    equal number are ordered by their line; a null role or text is a turn without a line. ttl_ms: a turn is forgotten that long after
    it came, and is gone from what the conversation's next turn gives. whole=False: only the batch's own turns, and the list isn't
    read. With ttl_ms the engine runs batches without data too: a stream with the trigger availableNow wouldn't end. Needs the RocksDB state store (`use_rocksdb`), whose lists are appended to without being read.
    """
    mode = "ProcessingTime" if ttl_ms else "None"
    return turns.groupBy("conv_id").transformWithStateInPandas(Memory(ttl_ms, whole), "conv_id long, n_turns long, history string", "Update", mode)


def use_rocksdb(spark) -> None:
    """The state store that lists and expiry need, for streams started after; changelogs instead of whole snapshots a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def event_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, with a watermark for late ones."""
    w = F.window("ts", window)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
