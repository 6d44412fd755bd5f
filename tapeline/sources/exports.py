"""Time codes and cut lists of selected games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import output_name, read_time


def export_timecodes(games: DataFrame) -> DataFrame:
    """(video_id, text): one line for each selected game, in time order. games(video_id, start_s, orange, blue, map, selected)."""
    line = F.concat(read_time(F.col("start_s")), F.lit(" "), F.col("orange"), F.lit(" vs "), F.col("blue"), F.lit(" - "), F.col("map"))
    own = games.where("selected").select("video_id", F.struct("start_s", line.alias("line")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return own.groupBy("video_id").agg(F.array_join(listed, "\n").alias("text"))


def cut_manifest(games: DataFrame, free_text: str, source_name: str, prefix: str) -> DataFrame:
    """(video_id, name, start, length): what an outside cutter needs for each selected game."""
    name = output_name(F.col("orange"), F.col("blue"), F.col("map"), F.lit(free_text), read_time(F.col("start_s")), F.lit(source_name), prefix)
    return games.where("selected").select("video_id", name.alias("name"), F.col("start_s").alias("start"), (F.col("end_s") - F.col("start_s")).alias("length"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One table in the order of its videos, so that a reader of some videos skips the other files; no folder for each."""
    manifest.repartitionByRange("video_id").sortWithinPartitions("video_id", "start").write.parquet(path)
