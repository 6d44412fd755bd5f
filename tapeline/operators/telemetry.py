"""Progress lines and gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import progress_duration, progress_time, round_half_up


def progress_series(lines: DataFrame) -> DataFrame:
    """(job_id, seq, current, duration, percent): lines with a time, once a duration above 0 is known. lines(job_id, seq, line)."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = lines.withColumn("duration", F.last(progress_duration(F.col("line")), ignorenulls=True).over(w)).withColumn("current", progress_time(F.col("line")))
    return known.where("current is not null and duration > 0").select("job_id", "seq", "current", "duration", F.ceil(100 * F.col("current") / F.col("duration")).cast("int").alias("percent"))


def multi_part_progress(points: DataFrame) -> DataFrame:
    """points(job_id, part, current, start, end), parts from 0, with global: the percentage of the whole job.

    A part's fraction is held within 0 and 100, not 1, so a part that runs over counts for more.
    """
    n = F.max("part").over(Window.partitionBy("job_id")) + 1
    fraction = F.least(F.greatest((F.col("current") - F.col("start")) / (F.col("end") - F.col("start")), F.lit(0.0)), F.lit(100.0))
    return points.withColumn("global", round_half_up(100 / n * F.col("part") + 100 / n * fraction).cast("int"))


def monotone_progress(values: DataFrame, key: str = "job_id", order: str = "seq", value: str = "value") -> DataFrame:
    """Rows strictly above every earlier one of their key, starting from 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn("_most", F.greatest(F.coalesce(F.max(value).over(w), F.lit(0)), F.lit(0))).where(F.col(value) > F.col("_most")).drop("_most")


def gauge_changes(samples: DataFrame, first_only: bool = False) -> DataFrame:
    """samples(user_id, ts, value) that differ from the one before; with first_only the first change of each user."""
    w = Window.partitionBy("user_id").orderBy("ts")
    changed = samples.withColumn("_before", F.lag("value").over(w)).where("_before is not null and value <> _before").drop("_before")
    if first_only:
        changed = changed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return changed
