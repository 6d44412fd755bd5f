"""Typed state forms of the log, gauge and progress streams, on transformWithStateInPandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(df: DataFrame) -> DataFrame:
    """Typed state lives in RocksDB only: queries that start from now on in this session use it; those that have a checkpoint keep what it names."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def last_of_partitions(logs: DataFrame, n: int) -> DataFrame:
    """(source, level, seq, message, ts): of each partition the last n logs of each source and level.

    What a key's state then gets of a batch is n rows a partition at most, however many logs the key has.
    """
    columns = ["source", "level", "seq", "message", "ts"]
    schema = pa.schema([("source", pa.string()), ("level", pa.string()), ("seq", pa.int64()), ("message", pa.string()), ("ts", pa.timestamp("us", "UTC"))])

    def trimmed(held: pd.DataFrame) -> pd.DataFrame:
        return held.sort_values(["seq", "message"], na_position="first").groupby(["source", "level"], dropna=False, sort=False).tail(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = trimmed(batch.to_pandas(types_mapper=pd.ArrowDtype))
            held = own if held is None else trimmed(pd.concat([held, own], ignore_index=True))
        if held is not None:
            yield from pa.Table.from_pandas(held[columns], schema=schema, preserve_index=False).to_batches()

    ts = F.col("ts") if "ts" in logs.columns else F.lit(None)
    own = logs.select("source", "level", F.col("seq").cast("long").alias("seq"), "message", ts.cast("timestamp").alias("ts"))
    return own.mapInArrow(run, "source string, level string, seq long, message string, ts timestamp")


class LastLogs(StatefulProcessor):
    """The last n logs of a key as a list that is trimmed each time; with ``idle_ms``, gone once no log came for so long in event time."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", "seq long, message string")
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, latest = [tuple(r) for r in self.tail.get()], (self.latest.get() or (0,))[0]
        for pdf in rows:
            held += zip(pdf["seq"].tolist(), pdf["message"].tolist(), strict=True)
            held = sorted(held, key=lambda r: (r[0], r[1] is not None, r[1] or ""))[-self.n :]
            if self.idle_ms is not None:
                latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
        self.tail.put(held)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.latest.update((latest,))
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame({"source": key[0], "level": key[1], "seq": [s for s, _ in held], "message": [m for _, m in held]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        self.latest.clear()
        yield pd.DataFrame({"source": [], "level": [], "seq": [], "message": []}).astype({"source": str, "level": str, "seq": "int64", "message": str})

    def close(self) -> None:
        pass


def last_n_logs(logs: DataFrame, n: int = 500, idle_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """(source, level, seq, message): after each batch the last n logs of the sources and levels that it touched.

    Each partition sends on its own last n of each first. With ``idle_ms``, which needs a
    column ts, a key without logs for so long starts anew, and logs older than the watermark are dropped.
    """
    own = with_rocksdb(logs)
    if idle_ms is not None:
        own = own.withWatermark("ts", delay)
    keyed = last_of_partitions(own, n) if idle_ms is None else own.select("source", "level", "seq", "message", "ts")
    return keyed.groupBy("source", "level").transformWithStateInPandas(LastLogs(n, idle_ms), "source string, level string, seq long, message string", "Update", "EventTime" if idle_ms is not None else "None")


class GaugeChanges(StatefulProcessor):
    """The last value of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "value"])
        before = own["value"].shift(1)
        if self.last.exists():
            before.iloc[0] = self.last.get()[0]
        self.last.update((float(own["value"].iloc[-1]),))
        yield own[before.notna() & (own["value"] != before)][["user_id", "ts", "value"]]

    def close(self) -> None:
        pass


def gauge_changes(samples: DataFrame) -> DataFrame:
    """samples(user_id, ts, value) that differ from the one before; rows of one batch are taken in order of ts and value."""
    return with_rocksdb(samples).groupBy("user_id").transformWithStateInPandas(GaugeChanges(), "user_id long, ts timestamp, value double", "Append", "None")


class MonotoneProgress(StatefulProcessor):
    """The largest value of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.most = handle.getValueState("most", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        most = self.most.get()[0] if self.most.exists() else 0.0
        own = pd.concat(list(rows)).sort_values("seq")
        before = own["value"].cummax().shift(1, fill_value=most).clip(lower=most)
        self.most.update((float(max(most, own["value"].max())),))
        yield own[own["value"] > before][["job_id", "seq", "value"]]

    def close(self) -> None:
        pass


def monotone_progress(values: DataFrame) -> DataFrame:
    """values(job_id, seq, value) strictly above every earlier one of their job, from 0; rows of one batch are taken in order of seq."""
    return with_rocksdb(values).groupBy("job_id").transformWithStateInPandas(MonotoneProgress(), "job_id string, seq long, value double", "Append", "None")
