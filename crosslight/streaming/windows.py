"""Streaming: windows with watermarks, cycle detection and ring buffers with state, resumable appends, progress.

A stream is drained by `drain` (what is there, then stop) or kept running by `collect` (a flush every interval). State is
bounded: windows and repeats by their watermark, keyed state by a timeout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 24 * 3600 * 1000


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table as a stream with its time as a timestamp (a timestamp without zone cannot carry a watermark). It may be a
    file or a folder of files."""
    path = f"{sf_dir}/{table}.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema)
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = whole.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(whole).isDirectory()
    d = d.parquet(path) if folder else d.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def window_kpis(stream: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), start: str | None = None) -> DataFrame:
    """Count and sum of each tumbling or (with `slide`) sliding window; `start` shifts them, as behind a warm-up. Rows
    later than `late` are dropped and closed windows leave the state."""
    w = F.window("ts", length, slide or length, start)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *by, "n", "total")


def session_kpis(stream: DataFrame, gap: str, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), key, "n")


def _keep(state: GroupState, latest: pd.Timestamp, keep_ms: int) -> None:
    """Lets a key's state go when the watermark is `keep_ms` past its latest row. (A timeout by the clock would keep a
    drained stream running.)"""
    state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))


def boundaries(phase: np.ndarray, last: str, first_green: str, reset: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(is boundary, counts since the last reset) of a light's steps in order, `last` being the phase before them. A reset
    row forgets the phase before it, and counts begin anew."""
    before = np.concatenate([[last], phase[:-1]]).astype(object)
    if reset is not None and reset.any():
        before[reset] = ""
    hit = (before != "") & (before != first_green) & (phase == first_green)
    total = np.cumsum(hit)
    if reset is not None and reset.any():
        at = np.maximum.accumulate(np.where(reset, np.arange(len(phase)), -1))
        total = np.where(at >= 0, total - np.where(at > 0, total[np.maximum(at - 1, 0)], 0), total)
    return hit, total


def detect_cycles(stream: DataFrame, key: str, phase: str, first_green: str, reset: str | None = None, keep_ms: int = DAY_MS, late: str = "1 hour") -> DataFrame:
    """(key, event_id, cycle_count) at each step a light's phase becomes its first green one. State is the last phase and
    the count; steps of a batch are taken in order of time, as vectors. A row with `reset` true starts the light anew. A
    light that is silent for `keep_ms` leaves the state; steps later than `late` are dropped."""
    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else ("", 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        p = pdf[phase].fillna("").astype(str).to_numpy(object)
        again = pdf[reset].fillna(False).to_numpy(bool) if reset else None
        hit, total = boundaries(p, last, first_green, again)
        carried = n if again is None else np.where(np.maximum.accumulate(again), 0, n)
        counts = total + carried
        state.update((str(p[-1]), int(counts[-1])))
        _keep(state, pdf["ts"].iloc[-1], keep_ms)
        yield pd.DataFrame({key: int(k[0]), "event_id": pdf["event_id"].to_numpy()[hit], "cycle_count": counts[hit]})

    return stream.withWatermark("ts", late).groupBy(key).applyInPandasWithState(advance, f"{key} bigint, event_id bigint, cycle_count bigint", "last string, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def last_values(stream: DataFrame, key: str, k: int = 20, keep_ms: int = DAY_MS, late: str = "1 hour") -> DataFrame:
    """(key, event_ids): the last k events of each key in order of time, as far as it has come; state holds k numbers and
    leaves after `keep_ms` of silence. For update mode."""
    def push(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"]).tail(k)
        held = (state.get[0].split(",") if state.exists and state.get[0] else []) + [str(e) for e in pdf["event_id"]]
        state.update((",".join(held[-k:]),))
        _keep(state, pdf["ts"].iloc[-1], keep_ms)
        yield pd.DataFrame({key: [str(name[0])], "event_ids": [",".join(held[-k:])]})

    return stream.withWatermark("ts", late).groupBy(key).applyInPandasWithState(push, f"{key} string, event_ids string", "held string", "update", GroupStateTimeout.EventTimeTimeout)


def retained(stream: DataFrame, id_: str, hours: int = 24) -> DataFrame:
    """Each event once; what is remembered of ids leaves the state after `hours`, and events later than that are dropped."""
    return stream.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark([id_])


class Progress(StreamingQueryListener):
    """Counts batches and rows of the session's streams as they complete."""

    def __init__(self) -> None:
        self.batches, self.rows = 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there into parquet files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there, batch by batch through `each`."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def collect(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Keeps a stream of closed windows running into parquet files, flushed every interval; the caller stops it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def resume_append(batch: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """The rows of a batch whose id is not done yet: appending them twice changes nothing."""
    return batch.dropDuplicates([id_]).join(done.select(id_).distinct(), id_, "left_anti")


def resume_stream(stream: DataFrame, path: str, checkpoint: str, id_: str) -> None:
    """Drains a stream into line JSON so that each id is written once, whatever was written before by this or another
    run: every batch leaves out the ids that are there."""
    from ..sources.sinks import append_results

    drain_batches(stream, lambda batch, _: append_results(batch, path, id_), checkpoint, "append")
