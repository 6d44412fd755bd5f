"""Structured Streaming forms of the history, segment, progress, log, gauge and line operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeline.operators.frames import Lines, images, text_lines, whole_frame
from tapeline.operators.segments import END, START
from tapeline.sources.history import game_teams, history_nodes, page_window, read_pages


def stream_history(spark: SparkSession, path: str, out: str, checkpoint: str, season: int, skip: int = 0, n_pages: int = 20, first_page: int = 1) -> StreamingQuery:
    """Writes the flat games of pages as they arrive, each page once, until n pages or the last page.

    A page that arrives again, in this part or a later one, is known by its season and
    number, of which state has one for each page of the window. Pages of a batch count
    in order of their numbers. Once n have been taken, or one that calls itself the
    last, no more are. Games go to ``out``, a folder for each batch; beside them,
    in folders that readers skip, the pages taken and all games of the newest batch. A
    batch that is repeated replaces what it wrote. No page is held in memory beyond its own row.
    """
    pages = read_pages(spark, path, streaming=True).where("data.gameHistories.nodes is not null")
    once = page_window(pages, season, skip, n_pages, first_page).dropDuplicates(["season", "page"])

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # pages are large: they stream through to flat games on disk, and what to take is told from a few columns of these
        flat = game_teams(history_nodes(batch, empty=True))
        flat.write.mode("overwrite").parquet(f"{out}/_new")
        new = spark.read.schema(flat.schema).parquet(f"{out}/_new")
        first = new.where(F.coalesce("pos", F.lit(0)) == 0).select("season", "page", F.coalesce("last", F.lit(False)).alias("last"))
        before = taken_pages(spark, out).where(F.col("batch") != number)
        n, over = before.agg(F.count("*"), F.coalesce(F.bool_or("last"), F.lit(False))).first()
        left = 0 if over else n_pages - n
        end = first.agg(F.min(F.when(F.col("last"), F.col("page")))).first()[0]
        within = F.lit(True) if end is None else F.col("page") <= end
        if left <= 0:
            within = F.lit(False)
        elif left < first.where(within).count():
            # pages of one season, each once, so that a number parts them and nothing is joined; n_pages rows at most
            within = F.col("page") <= first.where(within).select("page").orderBy("page").limit(left).agg(F.max("page")).first()[0]
        new.where(within & F.col("pos").isNotNull()).drop("last").write.mode("overwrite").parquet(f"{out}/batch={number}")
        first.where(within).write.mode("overwrite").parquet(f"{out}/_pages/batch={number}")

    return once.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_pages(spark: SparkSession, out: str) -> DataFrame:
    """(season, page, last, batch): the pages that a stream_history has taken so far."""
    schema = "season int, page int, last boolean, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{out}/_pages")
    except AnalysisException:  # no batch has been written yet
        return spark.createDataFrame([], schema)


def history_is_done(spark: SparkSession, out: str, n_pages: int) -> bool:
    """Whether a stream_history with this folder takes no more pages; a caller that starts it again and again can stop."""
    n, last = taken_pages(spark, out).agg(F.count("*"), F.coalesce(F.bool_or("last"), F.lit(False))).first()
    return n >= n_pages or last


def stream_segments(classes: DataFrame, delay: str = "1 minute", idle_ms: int = 60_000, lead_in: float = 2, buckets: int = 1024) -> DataFrame:
    """(video_id, mode, start_s, end_s): games as they close. classes(video_id, ts, t, cls, mode).

    Markers wait, in order of time, until the watermark passes them. A start marker
    gives out the game whose end is held, with the start held before it; an end
    marker replaces the end held. Markers older than the watermark are dropped by
    Spark, which counts them in the query's progress (numRowsDroppedByWatermark). A
    video without markers for ``idle_ms`` of event time closes. Markers at t <= 0
    and other classes don't count; a null mode counts as 0.

    State is by ``buckets`` of videos, as a call for each video costs far more than its few
    markers; a checkpoint keeps to the number of buckets that it began with.
    """
    mode = F.when(F.col("cls") == "score", F.coalesce("mode", F.lit(0))).otherwise(1).cast("int")
    marked = classes.where(F.col("cls").isin(*END, *START) & (F.col("t") > 0)).withWatermark("ts", delay)
    marked = marked.select(F.pmod(F.xxhash64("video_id"), F.lit(buckets)).alias("bucket"), F.col("video_id").cast("string").alias("video_id"), "ts", F.col("t").cast("double").alias("t"), "cls", mode.alias("mode"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *videos, of, times, ts, classes, modes = state.get if state.exists else [[] for _ in range(10)]
        held = {v: own for v, *own in zip(*videos, strict=True)}  # start, end, its mode, when it closes
        waiting = list(zip(of, times, ts, classes, modes, strict=True))
        now, new = state.getCurrentWatermarkMs(), set()
        for pdf in [] if state.hasTimedOut else batches:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            waiting += zip(pdf["video_id"].tolist(), at.tolist(), pdf["t"].tolist(), pdf["cls"].tolist(), pdf["mode"].tolist(), strict=True)
            new.update(pdf["video_id"])
        for v in new:
            held.setdefault(v, [None, None, None, 0])
        idle = {v for v, own in held.items() if v not in new and own[3] < now}
        # at one time a start comes before an end, and "end" comes last: the reverse of the backward order
        waiting.sort(key=lambda r: (r[1], r[2], r[3] in END, r[3] == "end"))
        out, left = [], []

        def close(v: str | None) -> None:
            start, end, kind, _ = held[v]
            if end is not None:
                out.append((v, kind, None if start is None else start + lead_in, end))

        for r in waiting:
            v, at, t, cls, mode = r
            if at >= now and v not in idle:
                left.append(r)
            elif cls in END:
                held[v][1:3] = t, mode
            else:
                close(v)
                held[v][:2] = t, None
        for v in idle:
            close(v)
            del held[v]
        latest = {r[0]: r[1] for r in left}  # in order of time
        for v in new:
            held[v][3] = max(now, latest.get(v, now)) + idle_ms
        if held:
            state.update((list(held), *([own[i] for own in held.values()] for i in range(4)), *([r[i] for r in left] for i in range(5))))
            state.setTimeoutTimestamp(min(own[3] for own in held.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["video_id", "mode", "start_s", "end_s"])

    states = "videos array<string>, starts array<double>, ends array<double>, kinds array<int>, closes array<long>, waiting array<string>, times array<long>, ts array<double>, classes array<string>, modes array<int>"
    return marked.groupBy("bucket").applyInPandasWithState(run, "video_id string, mode int, start_s double, end_s double", states, "append", GroupStateTimeout.EventTimeTimeout)


def stream_monotone_progress(values: DataFrame) -> DataFrame:
    """values(job_id, seq, value) strictly above every earlier one of their job, from 0; rows of one batch are taken in order of seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0.0
        own = pd.concat(list(batches)).sort_values("seq")
        before = np.maximum(most, own["value"].cummax().shift(1, fill_value=most))
        state.update((float(max(most, own["value"].max())),))
        yield own[own["value"] > before][["job_id", "seq", "value"]]

    return values.groupBy("job_id").applyInPandasWithState(run, "job_id string, seq long, value double", "most double", "append", GroupStateTimeout.NoTimeout)


def stream_gauge_changes(samples: DataFrame) -> DataFrame:
    """samples(user_id, ts, value) that differ from the one before; rows of one batch are taken in order of ts and value."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values(["ts", "value"])
        before = own["value"].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(own["value"].iloc[-1]),))
        yield own[before.notna() & (own["value"] != before)][["user_id", "ts", "value"]]

    return samples.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout)


def stream_last_n_logs(logs: DataFrame, n: int = 500) -> DataFrame:
    """(source, level, seq, message): after each batch the last n logs of the sources and levels that it touched; state holds n at most."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held = sorted([*held, *zip(pdf["seq"].tolist(), pdf["message"].tolist(), strict=True)], key=lambda r: r[0])[-n:]
        state.update(([int(s) for s, _ in held], [m for _, m in held]))
        yield pd.DataFrame({"source": key[0], "level": key[1], "seq": [s for s, _ in held], "message": [m for _, m in held]})

    return logs.groupBy("source", "level").applyInPandasWithState(run, "source string, level string, seq long, message string", "seqs array<long>, messages array<string>", "update", GroupStateTimeout.NoTimeout)


def stream_kill_lines(frames: DataFrame, palette: list[tuple[str, tuple[int, int, int]]], region: tuple[int, int], tol: int = 40, height: int = 11, height_tol: int = 4) -> DataFrame:
    """(video_id, t, y, height): runs of text lines in the top right region (w, h) of each frame; without state.

    palette names white, orange, blue and red in order of precedence. Damaged frames are skipped; each
    batch's progress counts them (observedMetrics, damaged_frames.n).
    """
    lines = Lines(palette, tol, height, height_tol, region)
    schema = pa.schema([("video_id", pa.string()), ("t", pa.float64()), ("y", pa.int32()), ("height", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, line) for i, image in images(batch) for line in text_lines(image, lines)]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("video_id").take(at), batch.column("t").take(at), *(pa.array([line[c] for _, line in found], pa.int32()) for c in ("y", "height"))], schema=schema)

    seen = frames.observe("damaged_frames", F.count_if(~whole_frame()).alias("n")).where(whole_frame())
    return seen.select("video_id", "t", "width", "height", "rgb").mapInArrow(run, "video_id string, t double, y int, height int")
