"""Application logs of two producers, their tail and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.sources.shared import checkpointed, small

SCHEMA = "seq long, level string, message string, ts timestamp, source string"


def read_logs(spark: SparkSession, paths: str | list[str], streaming: bool = False) -> DataFrame:
    """JSON lines of either producer; a message that is an object stays as its JSON text."""
    return (spark.readStream if streaming else spark.read).schema(SCHEMA).json(paths)


def message_text(parts: Column) -> Column:
    """array<string> of rendered parts to one message, parted by blanks."""
    return F.array_join(parts, " ", "null")


def union_logs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def last_n_logs(logs: DataFrame, level: str, n: int = 500) -> DataFrame:
    """The last n logs of a level in order; all logs for 'all'."""
    if level == "all":
        return logs.orderBy("seq")
    return logs.where(F.col("level") == level).orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


#: Partitions whose counts one task sums up.
STRIDE = 1000


def number_rows(df: DataFrame, order: list[str], name: str = "n", by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """1-based numbers in the order, within each group of equal ``by`` columns; nulls come first. ``total`` names a column for the group's count.

    A range-partitioned sort, so that a group may span any number of partitions. Range
    bounds are sampled anew in each run, so the sorted rows are kept, and counts and
    numbers both come from them. Offsets are a table: counts of each partition are
    summed within STRIDE partitions and over such strides, then joined by partition.
    """
    own, sort = by or [], [*(by or []), *order]
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = checkpointed(spread.withColumn("_i", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_i", 33))
    counts = placed.groupBy(*own, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first")).withColumn("_stride", F.floor(F.col("_p") / STRIDE))

    def before(keys: list[str], at: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_c").over(w), F.lit(0))

    keys = [F.coalesce(F.to_json(F.struct(*own)), F.lit("")).alias("_key")] if own else [F.lit("").alias("_key")]
    counts = counts.select(*own, *keys, "_p", "_stride", "_c", "_first")
    strides = counts.groupBy("_key", "_stride").agg(F.sum("_c").alias("_c"))
    strides = strides.select("_key", "_stride", before(["_key"], "_stride").alias("_over"), F.sum("_c").over(Window.partitionBy("_key")).alias("_total"))
    starts = counts.withColumn("_under", before(["_key", "_stride"], "_p")).join(strides, ["_key", "_stride"])
    # one row for each partition and one more for each group that begins inside one
    starts = small(checkpointed(starts.select(*(F.col(c).alias(f"_by_{c}") for c in own), F.col("_p").alias("_at"), "_total", (F.col("_over") + F.col("_under") - F.col("_first") + 1).alias("_offset"))))
    same = F.col("_p") == F.col("_at")
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbers = [(F.col("_i") + F.col("_offset")).alias(name), *([F.col("_total").alias(total)] if total else [])]
    return placed.join(starts, same).select(*(c for c in df.columns if c not in (name, total)), *numbers)


def export_logs(logs: DataFrame, title: str, generated_at: str) -> DataFrame:
    """(line_no, value): the lines of the report in order. line_no 0 is the head; a log's entry has its number."""
    total = logs.agg(F.concat(F.lit(f"{title}\nGenerated at: {generated_at}\nTotal logs: "), F.count("*").cast("string"), F.lit("\n" + "=" * 80)).alias("value")).select(F.lit(0).cast("long").alias("line_no"), "value")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.format_string("[%d] <%s> [%s] [%s]\n%s\n%s", "n", stamp, F.upper("level"), "source", "message", F.lit("-" * 40))
    return total.unionByName(number_rows(logs, ["seq"]).select(F.col("n").alias("line_no"), entry.alias("value")))


def write_report(report: DataFrame, path: str) -> None:
    report.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
