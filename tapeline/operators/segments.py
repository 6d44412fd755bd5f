"""From a timeline of frame classes to games and their attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.intervals import interval_join

END, START = ("score", "end"), ("loading", "intro")


def sample_frames(frames: DataFrame, durations: DataFrame, step: float = 1.0) -> DataFrame:
    """One frame for each point duration - k * step > 0: the first at or after the point, before the next one."""
    known = frames.join(durations, "video_id").where((F.col("t") > 0) & (F.col("t") <= F.col("duration")))
    k = F.ceil((F.col("duration") - F.col("t")) / step).cast("long")
    numbered = known.withColumn("k", k).where(F.col("duration") - F.col("k") * step > 0)
    w = Window.partitionBy("video_id", "k").orderBy("t")
    return numbered.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def downsample(frames: DataFrame, fps: float = 10) -> DataFrame:
    """The first frame of each 1 / fps of a second."""
    w = Window.partitionBy("video_id", F.floor(F.col("t") * fps)).orderBy("t")
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def segment_games(classes: DataFrame, lead_in: float = 2) -> DataFrame:
    """(video_id, game_no, mode, start_s, end_s): games between markers, numbered from the last one backwards.

    Read backwards, an end marker opens a game, further ones don't matter, and the
    first start marker closes it ``lead_in`` after itself; without one the start is
    unknown. Only changes of marker matter, so one window by video decides.
    """
    kind = F.when(F.col("cls").isin(*END), "E").when(F.col("cls").isin(*START), "S")
    mode = F.when(F.col("cls") == "score", F.col("mode") if "mode" in classes.columns else F.lit(0)).otherwise(F.lit(1))
    marks = classes.where("t > 0").select("video_id", "t", kind.alias("m"), mode.alias("mode"), "cls").where("m is not null")
    back = Window.partitionBy("video_id").orderBy(F.col("t").desc(), "m", "cls")
    changes = marks.withColumn("before", F.lag("m").over(back)).where("m <> coalesce(before, 'S')")
    numbered = changes.withColumn("game_no", F.sum(F.when(F.col("m") == "E", 1).otherwise(0)).over(back))
    start, end = F.max(F.when(F.col("m") == "S", F.col("t") + lead_in)), F.max(F.when(F.col("m") == "E", F.col("t")))
    return numbered.groupBy("video_id", "game_no").agg(F.max(F.when(F.col("m") == "E", F.col("mode"))).alias("mode"), start.alias("start_s"), end.alias("end_s"))


def game_attributes(games: DataFrame, readings: DataFrame, fields: list[str], width: float = 600.0) -> DataFrame:
    """Games with, for each field, the usable reading nearest to their end; a reading is usable if it is not null or empty.

    readings(video_id, t, field, text). Of readings at one time the largest text counts, or the
    first one where readings have their order, seq. A game is open from its start, or from 0, to its end.
    """
    near = F.struct("t", -F.col("seq") if "seq" in readings.columns else F.col("text"))
    open_ = games.select("video_id", "game_no", F.coalesce("start_s", F.lit(0)).alias("_s"), F.col("end_s").alias("_e"))
    usable = readings.where("coalesce(text, '') <> ''")
    held = interval_join(usable, open_, "video_id", "t", "_s", "_e", width)
    best = held.groupBy("video_id", "game_no").agg(*(F.max_by(F.when(F.col("field") == f, F.col("text")), F.when(F.col("field") == f, near)).alias(f) for f in fields))
    return games.join(best, ["video_id", "game_no"], "left")


def jump_hints(readings: DataFrame) -> DataFrame:
    """(video_id, game_no, t, estimate): the latest frame of each game at which a clock estimate is known and earlier than the frame.

    readings(video_id, game_no, t, estimate, map, orange, blue): read backwards, a
    frame counts once the map and both names have been read at it or at a later one.
    """
    back = Window.partitionBy("video_id", "game_no").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = [F.max(F.coalesce(F.col(c), F.lit("")) != "").over(back).alias(f"_{c}") for c in ("map", "orange", "blue")]
    usable = readings.select("*", *known).where("_map and _orange and _blue and estimate is not null and estimate < t")
    w = Window.partitionBy("video_id", "game_no").orderBy(F.col("t").desc())
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("video_id", "game_no", "t", "estimate")


def without_jumped(classes: DataFrame, hints: DataFrame, width: float = 600.0) -> DataFrame:
    """Classes without the markers between a hint's estimate and its frame."""
    spans = hints.select("video_id", F.col("estimate").alias("_s"), F.col("t").alias("_e"))
    inside = interval_join(classes.select("video_id", "t").distinct(), spans, "video_id", "t", "_s", "_e", width).where("t > _s").select("video_id", "t").distinct()
    return classes.join(inside, ["video_id", "t"], "left_anti")


def one_frame_per_game(frames: DataFrame, seed: int = 7) -> DataFrame:
    """One frame of each game, picked by a hash of its time: the same on every run."""
    w = Window.partitionBy("video_id", "game_no").orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("t").cast("string")).cast("binary")), "t")
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def games_in_list_order(games: DataFrame) -> DataFrame:
    """Games with list_no, their place by time in their video, from 1."""
    return games.withColumn("list_no", F.row_number().over(Window.partitionBy("video_id").orderBy("end_s")))


def games_found(games: DataFrame) -> DataFrame:
    """(video_id, games_found)."""
    return games.groupBy("video_id").agg(F.count("*").alias("games_found"))


def selection(games: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, all_selected, some_selected); nulls count as not selected."""
    s: Column = F.coalesce(F.col("selected"), F.lit(False))
    return games.groupBy(key).agg(F.coalesce(F.bool_and(s), F.lit(False)).alias("all_selected"), F.coalesce(F.bool_or(s), F.lit(False)).alias("some_selected"))
