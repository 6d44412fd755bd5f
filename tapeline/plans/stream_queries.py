"""Registered queries of the streaming operators: rows arrive in parts, and the whole result must agree with SQL over the whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.plans import views as V
from tapeline.plans.queries import CELLS, SLOTS_SQL, frames_of, order_games, query
from tapeline.plans.views import sql
from tapeline.sources import history
from tapeline.sources.shared import checkpointed, shared_folder
from tapeline.streaming import stateful, streams

#: How often rows arrive.
PARTS = 3


def arrivals(rows: DataFrame, order: Column) -> list[DataFrame]:
    """All rows in parts of about one size, by ranges of what they are ordered by."""
    cuts = rows.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    part = sum((F.when(order >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return [rows.where(part == i) for i in range(PARTS)]


def replayed(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], latest: list[str] | None = None) -> DataFrame:
    """What a stream gives out for parts that arrive one after another; it stops after each and goes on from its checkpoint.

    With ``latest``, each batch's rows replace those of earlier batches with the same values of these columns.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    for rows in parts:
        rows.write.mode("append").parquet(f"{folder}/in")
        made = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        writer = made.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        if latest:
            # a batch that is repeated writes the same folder again
            writer = writer.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            writer.start().awaitTermination()
        else:
            writer.format("parquet").start(out).awaitTermination()
    if not latest:
        return spark.read.schema(made.schema).parquet(out)
    every = spark.read.schema(made.schema.add("batch", "long")).parquet(out)
    return every.join(every.groupBy(*latest).agg(F.max("batch").alias("batch")), [*latest, "batch"], "left_semi").drop("batch")


SIDES = ", ".join(f"CAST(count(l_orderkey) FILTER (WHERE side = {n}) AS INTEGER) AS n_{side}, max(CASE WHEN side = {n} AND k = 1 THEN {CELLS['name']} END) AS first_{side}" for n, side in enumerate(("orange", "blue")))


@query("WITH " + SLOTS_SQL + f""" SELECT CAST(o_orderkey // 100 AS INTEGER) AS page, o_orderstatus AS mode, o_orderpriority AS map, strftime(o_orderdate, '%d/%m/%Y') AS date, CAST(o_orderkey % 900 AS INTEGER) AS duration,
  CAST(o_orderkey % 10 AS INTEGER) AS orange_score, CAST(o_custkey % 7 AS INTEGER) AS blue_score, {SIDES} FROM orders LEFT JOIN slots ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate""")
def stream_history(spark, d):
    """Orders as page documents that arrive in parts; every page of the one season is taken, each once.

    Each part brings a third of the pages of the part before again, as a retry does;
    the last part also has a page after the one that calls itself the last.
    """
    node = F.struct("createdAt", "mode", "map", "data", "players")
    games = order_games(spark, d).withColumn("season", F.lit(1)).withColumn("page", F.floor(F.col("pos") / 100))
    pages = games.groupBy("season", "page").agg(F.collect_list(node).alias("nodes"))
    end = pages.agg(F.max("page")).first()[0] or 0
    text = F.to_json(F.struct("season", "page", (F.col("page") == end).alias("last"), F.struct(F.struct("nodes").alias("gameHistories")).alias("data"))).alias("value")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parts = arrivals(pages, F.col("page"))
    for i, part in enumerate(parts):
        if i:
            part = part.unionByName(parts[i - 1].where("page % 3 = 0"))
        if i == PARTS - 1:
            part = part.unionByName(pages.where(F.col("page") == end).withColumn("page", F.col("page") + 1))
        part.select(text).write.mode("append").text(f"{folder}/in", compression="gzip")
        streams.stream_history(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", 1, n_pages=2**31, first_page=0).awaitTermination()
    sides = (c for s in ("orange", "blue") for c in (F.size(s).alias(f"n_{s}"), F.get(s, F.lit(0))["name"].alias(f"first_{s}")))
    flat = history.game_teams(history.history_nodes(spark.createDataFrame([], history.PAGES)))
    return spark.read.schema(flat.schema).parquet(f"{folder}/out").select("page", "mode", "map", "date", "duration", "orange_score", "blue_score", *sides)


@query(sql("SELECT video_id, CAST(mode AS INTEGER) AS mode, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s FROM v_games", "v_games"))
def stream_segments(spark, d):
    """Markers arrive up to six hours out of order, in a stream that waits a day; a far marker of another video closes all."""
    own = V.markers(spark, d)
    at, idle_s = lambda t: F.timestamp_seconds(t + V.EPOCH_US / 1e6), 10**7
    marks = own.select(F.col("video_id").cast("string").alias("video_id"), at(F.col("t")).alias("ts"), F.col("t").cast("double").alias("t"), "cls", F.lit(0).alias("mode"), (F.col("t") + F.col("event_id") % 7 * 3600).alias("arrives"))
    far = own.agg((F.coalesce(F.max("t"), F.lit(0)) + 2 * idle_s).alias("t")).select(F.lit("").alias("video_id"), at(F.col("t")).alias("ts"), F.col("t").cast("double").alias("t"), F.lit("loading").alias("cls"), F.lit(0).alias("mode"))
    parts = [p.drop("arrives") for p in arrivals(marks, F.col("arrives"))]
    parts[-1] = parts[-1].unionByName(far)
    return replayed(spark, parts, lambda f: streams.stream_segments(f, "1 day", idle_s * 1000)).withColumn("video_id", F.col("video_id").cast("long"))


@query("""SELECT job_id, seq, CAST(v AS DOUBLE) AS value FROM (SELECT user_id AS job_id, event_id AS seq, event_id * 7919 % 1001 AS v, max(event_id * 7919 % 1001) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE v > coalesce(m, 0)""")
def stream_monotone_progress(spark, d):
    e = F.col("event_id")
    values = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), e.alias("seq"), (e * 7919 % 1001).cast("double").alias("value"))
    return replayed(spark, arrivals(values, F.col("seq")), stateful.monotone_progress).withColumn("job_id", F.col("job_id").cast("long"))


@query("""SELECT user_id, epoch_us(ts) AS at_us, CAST(v AS DOUBLE) AS value FROM (SELECT user_id, ts, event_id % 3 AS v, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id % 3) AS b FROM events) WHERE v <> b""")
def stream_gauge_changes(spark, d):
    samples = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).cast("double").alias("value"))
    return replayed(spark, arrivals(samples, F.unix_micros("ts")), stateful.gauge_changes).select("user_id", F.unix_micros("ts").alias("at_us"), "value")


@query(sql("SELECT source, level, seq, message FROM v_logs QUALIFY row_number() OVER (PARTITION BY source, level ORDER BY seq DESC) <= 500", "v_logs"))
def stream_last_logs(spark, d):
    logs = V.logs(spark, d).select("source", "level", "seq", "message")
    return replayed(spark, arrivals(logs, F.col("seq")), stateful.last_n_logs, ["source", "level"])


@query(sql("""SELECT CAST(frame_id % 3 AS VARCHAR) AS video_id, CAST(frame_id // 3 + 1 AS DOUBLE) AS t, CAST(y AS INTEGER) AS y, CAST(n AS INTEGER) AS height FROM (SELECT frame_id, i, min(y) AS y, count(*) AS n FROM (
  SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM (SELECT frame_id, y, bool_or(c = 'w') AS w, bool_or(c = 'o') AS o, bool_or(c = 'b') AS b, bool_or(c = 'r') AS r FROM (
  SELECT frame_id, y, CASE WHEN r >= 175 AND g >= 175 AND b >= 175 THEN 'w' WHEN r >= 175 AND g >= 135 AND b <= 80 THEN 'o' WHEN r <= 80 AND g <= 80 AND b >= 175 THEN 'b' WHEN r >= 175 AND g <= 80 AND b <= 80 THEN 'r' END AS c FROM v_pixels)
  GROUP BY frame_id, y) WHERE w AND ((coalesce(o, false) AND coalesce(b, false)) OR coalesce(r, false))) GROUP BY frame_id, i) WHERE y + n - 1 < 39 AND n BETWEEN 1 AND 9""", "v_pixels"))
def stream_kill_lines(spark, d):
    palette = [("white", (255, 255, 255)), ("orange", (255, 215, 0)), ("blue", (0, 0, 255)), ("red", (255, 0, 0))]
    frames = checkpointed(frames_of(spark, d))  # drawn once, not again for each part
    return replayed(spark, arrivals(frames, F.col("t")), lambda f: streams.stream_kill_lines(f, palette, (60, 40), 80, 5, 4))
