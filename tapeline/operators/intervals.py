"""Cuts, kept chunks, retiming, and interval and as-of joins that deal their rows out by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the intervals [start, end) of their key that hold them.

    Levels of buckets of ``width``, twice that, and so on: an interval lies in the
    buckets that it touches on the first level where they are no shorter than itself,
    so two at most, however long it is; a point has one bucket on each level that
    intervals are on. The join is on (key, level, bucket) and never compares all
    pairs of a key. Intervals with a null bound, and empty ones, hold nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log2(length / F.lit(width))), F.lit(0)).cast("int")
    held = intervals.where(F.col(start) < F.col(end)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in held.select("_level").distinct().collect())  # logarithmic in the longest interval

    def bucket(c: Column) -> Column:
        return F.floor(c / (F.lit(width) * F.pow(F.lit(2.0), "_level"))).cast("long")

    spread = held.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    own = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("_b", bucket(F.col(t)))
    return own.join(spread, [key, "_level", "_b"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_level", "_b")


def frames_in_games(frames: DataFrame, games: DataFrame, width: float = 600.0) -> DataFrame:
    return interval_join(frames, games, "video_id", "t", "start_s", "end_s", width)


def split_at_cuts(durations: DataFrame, cuts: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, chunk_no, start, end, remove): [0, duration] split at every cut strictly inside; ordered by end, from 1."""
    inside = cuts.join(durations, key).where((F.col("t") > 0) & (F.col("t") < F.col("duration"))).select(key, F.col("t").cast("double").alias("p"))
    ends = durations.select(key, F.explode(F.array(F.lit(0.0), F.col("duration").cast("double"))).alias("p"))
    w = Window.partitionBy(key).orderBy("p")
    points = inside.unionByName(ends).distinct().withColumn("end", F.lead("p").over(w)).withColumn("chunk_no", F.row_number().over(w))
    return points.where("end is not null").select(key, "chunk_no", F.col("p").alias("start"), "end", F.lit(False).alias("remove"))


def timeline(kept: DataFrame, key: str = "video_id") -> DataFrame:
    """Kept chunks with ``shift``, the total length of those before them."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("shift", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)))


def retime(events: DataFrame, chunks: DataFrame, key: str = "video_id", width: float = 3600.0) -> DataFrame:
    """Events of kept chunks with new_t, their time once removed chunks are cut out; others vanish."""
    kept = timeline(chunks.where("not coalesce(remove, false)"), key).select(key, "start", "end", "shift")
    held = interval_join(events, kept, key, "t", "start", "end", width)
    return held.withColumn("new_t", F.col("t") - F.col("start") + F.col("shift")).drop("start", "end", "shift")


def concat_chunks(*chunks: DataFrame) -> DataFrame:
    """Chunk tables of the same videos, one after another, on a new timeline."""
    out = chunks[0].withColumn("source_no", F.lit(0))
    for i, c in enumerate(chunks[1:], 1):
        out = out.unionByName(c.withColumn("source_no", F.lit(i)))
    w = Window.partitionBy("video_id").orderBy("source_no", "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0))
    return out.withColumn("new_start", at).withColumn("new_end", F.col("new_start") + F.col("end") - F.col("start"))


#: Seconds of a key that one task looks through at once in an as-of lookup.
SLICE = 86_400.0


def as_of(requests: DataFrame, rows: DataFrame, key: str, t: str, value: str, forward: bool = True, slice_width: float = SLICE) -> DataFrame:
    """requests(key, id, t) with found_<value>: that of the nearest row at or after (forward) or at or before t.

    One union, and a window by key and slice of time, so that a key with most of the
    rows goes to many tasks. What a slice doesn't find comes from the slices that are
    nearer to its start: one value each, summed up before they are shuffled and carried
    over by a window of a row a slice. No pair of a request and a row is made before the answer is known.
    """
    sign = -1 if forward else 1
    asked = requests.withColumn("_v", F.lit(None)).withColumn("_ask", F.lit(True))
    given = rows.where(F.col(value).isNotNull()).select(F.col(key), F.col(t), F.col(value).alias("_v"), F.lit(False).alias("_ask"))
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("_slice", F.floor(F.col(t) / F.lit(slice_width)) * sign)
    order = [F.col(t).desc(), F.col("_ask")] if forward else [F.col(t), F.col("_ask")]
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.groupBy(F.col(key).alias("_of"), F.col("_slice").alias("_at")).agg(F.max_by("_v", F.when(~F.col("_ask"), F.col(t) * sign)).alias("_end"))
    earlier = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_of", "_at", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    own = both.withColumn("_found", F.last("_v", ignorenulls=True).over(inside)).where("_ask")
    met = own.join(carried, F.col(key).eqNullSafe(F.col("_of")) & F.col("_slice").eqNullSafe(F.col("_at")), "left")
    return met.withColumn(f"found_{value}", F.coalesce("_found", "_carried")).drop("_v", "_ask", "_slice", "_found", "_of", "_at", "_carried")


def _phase(c: Column, step: float) -> Column:
    """Where a time lies between grid points; equal for times that are whole steps apart."""
    return F.round(F.pmod(c.cast("double"), F.lit(step)), 6)


def playing_bounds(games: DataFrame, classes: DataFrame, step: float = 1.0) -> DataFrame:
    """Games with start and end moved inwards to playing frames on the grid that each bound anchors; games without either go.

    games(video_id, game_no, start_s, end_s), classes(video_id, t, cls). Each bound is
    one as-of lookup among the frames of its video and phase, in slices of time.
    """
    key = lambda c: F.concat_ws("|", "video_id", _phase(c, step))
    playing = classes.where("cls = 'playing'").select(key(F.col("t")).alias("_key"), F.col("t").cast("double").alias("t")).withColumn("p", F.col("t"))
    known = games.where("start_s is not null and end_s is not null").select("video_id", "game_no", "start_s", "end_s")

    def moved(bound: str, forward: bool) -> DataFrame:
        asked = known.select("video_id", "game_no", key(F.col(bound)).alias("_key"), F.col(bound).cast("double").alias("t"))
        return as_of(asked, playing, "_key", "t", "p", forward).where("found_p is not null").select("video_id", "game_no", F.col("found_p").alias(bound))

    return moved("start_s", True).join(moved("end_s", False), ["video_id", "game_no"])


def next_acceptable_frame(requests: DataFrame, frames: DataFrame, accept: Column, step: float = 1.0) -> DataFrame:
    """requests(video_id, request_id, t0) with t: the first accepted frame at t0, t0 + step, ..., null if none."""
    good = frames.where(accept).select("video_id", F.col("t").cast("double").alias("t"))
    asked = requests.withColumn("_key", F.concat_ws("|", "video_id", _phase(F.col("t0"), step))).withColumn("t", F.col("t0").cast("double"))
    keyed = good.withColumn("_key", F.concat_ws("|", "video_id", _phase(F.col("t"), step))).withColumn("next", F.col("t"))
    return as_of(asked, keyed, "_key", "t", "next").drop("_key", "t").withColumnRenamed("found_next", "t")


def order_chunks(chunks: DataFrame) -> DataFrame:
    """Kept chunks with order_no, their place by start in their video, from 1."""
    return chunks.where("not coalesce(remove, false)").withColumn("order_no", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")))
