"""Streams over event logs and page folders: change source, snapshots, windows, retention, transitions, packs, admission."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WEEK = "7 days"


def watch_pages(spark: SparkSession, root: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call `rebuild` with the changed page files of each trigger; without `every` what is there is handled once."""
    changed = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").format("text").option("wholetext", True).load(root)
    named = changed.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    writer = named.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def snapshot_sink(build: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that replaces a snapshot as a whole whenever something changed."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build().write.mode("overwrite").parquet(path)

    return write


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events of parquet files as they arrive, with a zoned time for watermarks."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_counts(events: DataFrame, offset: str = "0 days", late: str = "30 days") -> DataFrame:
    """Tumbling seven-day windows with a watermark of `late`; the same expression serves batch and stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    rows = marked.groupBy(F.window("ts", WEEK, WEEK, offset), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def retained(events: DataFrame, days: int = 30) -> DataFrame:
    """Drops events later than the watermark of `days` allows, and repeats of an event id within it."""
    return events.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["event_id"])


def transitions(events: DataFrame, key: str, bad: str) -> DataFrame:
    """(key, event_id, ts): events of type `bad` that do not follow one of the same key; state is one flag and time per key.

    Within a trigger events are taken in order of time; an event older than the last one
    seen of its key is passed over, as its place in the order is gone.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (False, pd.Timestamp.min.value // 1000)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            micros = r.ts.value // 1000
            if micros < at:
                continue
            now = r.event_type == bad
            if now and not last:
                out.append((k[0], r.event_id, r.ts))
            last, at = now, micros
        state.update((last, at))
        yield pd.DataFrame(out, columns=[key, "event_id", "ts"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts", "event_type").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, ts timestamp", "bad boolean, at long", "append", GroupStateTimeout.NoTimeout)


def pack_stream(chunks: DataFrame, most_lines: int) -> DataFrame:
    """(pack, chunks, lines) of each partition in its order, closed before it would outgrow `most_lines`; memory holds one pack."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, held, used = 1, 0, 0
        for b in batches:
            out = []
            for n in b["n_lines"]:
                if held and used + n > most_lines:
                    out.append((pack, held, used))
                    pack, held, used = pack + 1, 0, 0
                held, used = held + 1, used + int(n)
            yield pd.DataFrame(out, columns=["pack", "chunks", "lines"])
        if held:
            yield pd.DataFrame([(pack, held, used)], columns=["pack", "chunks", "lines"])

    return chunks.select("n_lines").mapInPandas(run, "pack int, chunks int, lines int")


class Admission:
    """Up to `readers` readers at once, or one writer; who waits longer than `timeout` seconds is refused. Waiting writers do not hold up readers."""

    def __init__(self, readers: int = 8, timeout: float = 120.0):
        self.most, self.timeout = readers, timeout
        self.reading, self.writing = 0, False
        self.changed = threading.Condition()

    def _enter(self, free: Callable[[], bool], take: Callable[[], None]) -> None:
        until = time.monotonic() + self.timeout
        with self.changed:
            while not free():
                left = until - time.monotonic()
                if left <= 0 or not self.changed.wait(left):
                    raise TimeoutError("waited too long for admission")
            take()

    @contextmanager
    def read(self) -> Iterator[None]:
        self._enter(lambda: not self.writing and self.reading < self.most, lambda: setattr(self, "reading", self.reading + 1))
        try:
            yield
        finally:
            with self.changed:
                self.reading -= 1
                self.changed.notify_all()

    @contextmanager
    def write(self) -> Iterator[None]:
        self._enter(lambda: not self.writing and self.reading == 0, lambda: setattr(self, "writing", True))
        try:
            yield
        finally:
            with self.changed:
                self.writing = False
                self.changed.notify_all()


def run_batch(operations: list[tuple[str, Callable[[], object]]], most: int = 50) -> list[dict]:
    """Results of up to `most` operations in order; one that fails gives its error and the rest goes on."""
    if len(operations) > most:
        raise ValueError(f"at most {most} operations in a batch")
    out = []
    for name, call in operations:
        try:
            out.append({"name": name, "ok": True, "result": call()})
        except Exception as e:  # noqa: BLE001 - each operation stands for itself
            out.append({"name": name, "ok": False, "error": f"{type(e).__name__}: {e}"})
    return out
