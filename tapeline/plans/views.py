"""Domain tables derived from the star-schema tables, by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01, from which event times are counted.
EPOCH_US = 1704067200000000
#: Invented probes: template, mode, probe, x, y, r, g, b, tol.
PROBES = [("a", 0, 1, 5, 5, 200, 200, 200, 80), ("a", 0, 2, 10, 6, 200, 200, 200, 80), ("b", 1, 1, 20, 7, 128, 128, 128, 110), ("b", 1, 2, 30, 8, 128, 128, 128, 110)]
#: Invented maps and their tokens.
MAPS = [(1, "North", ["the", "of"]), (2, "South", ["de", "la"]), (3, "East", ["der", "und"])]
DURATION = 2592000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds():
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000000.0).cast("long")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "score").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "loading").when(F.col("event_type") == "click", "playing").otherwise("none")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), seconds().alias("t"), "event_id", kind.alias("cls"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    keys = F.floor(o / 500).alias("frame_id"), (p % 60).alias("x"), (s % 40).alias("y")
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max((o * 7 + n * 31) % 256).alias("r"), F.max((p * 13 + n * 17) % 256).alias("g"), F.max((s * 29 + n * 11) % 256).alias("b"))


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, "template string, mode int, probe int, x long, y long, r int, g int, b int, tol int")


def map_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPS, "map_order int, name string, tokens array<string>")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(o.alias("game_id"), F.concat(F.lit("M"), (c % 12).cast("string")).alias("map"), (o % 10).alias("orange_score"), (c % 7).alias("blue_score"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.lit("M"), (c % 12).cast("string")).alias("map"), (c % 10).alias("orange_score"), (c % 7).alias("blue_score"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    level = F.when(e == "error", "error").when(e == "view", "debug").when(e == "click", "info").when(e == "signup", "log").otherwise("warn")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), level.alias("level"), F.col("props").alias("message"), "ts", F.when(F.col("user_id") % 2 == 0, "shell").otherwise("ui").alias("source"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = (F.col("event_id") % 50 + 10).cast("string")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Duration: 01:00:"), part, F.lit(".00, start"))).otherwise(F.concat(F.lit("frame time=00:"), part, F.lit(":10.50 x")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers(spark, sf_dir).where("cls = 'loading'").select("video_id", "t")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers(spark, sf_dir).select("video_id").distinct().withColumn("duration", F.lit(float(DURATION)))


SECS = f"CAST(floor((epoch_us(ts) - {EPOCH_US}) / 1000000.0) AS BIGINT)"
SQL = {
    "v_markers": f"""SELECT user_id AS video_id, {SECS} AS t, event_id, CASE event_type WHEN 'signup' THEN 'score' WHEN 'purchase' THEN 'end'
      WHEN 'error' THEN 'loading' WHEN 'click' THEN 'playing' ELSE 'none' END AS cls FROM events""",
    "v_pixels": """SELECT l_orderkey // 500 AS frame_id, l_partkey % 60 AS x, l_suppkey % 40 AS y, max((l_orderkey * 7 + l_linenumber * 31) % 256) AS r,
      max((l_partkey * 13 + l_linenumber * 17) % 256) AS g, max((l_suppkey * 29 + l_linenumber * 11) % 256) AS b FROM lineitem GROUP BY ALL""",
    "v_probes": "SELECT * FROM (VALUES " + ", ".join(map(str, PROBES)) + ") AS p(template, mode, probe, x, y, r, g, b, tol)",
    "v_detected": "SELECT o_orderkey AS game_id, concat('M', o_custkey % 12) AS map, o_orderkey % 10 AS orange_score, o_custkey % 7 AS blue_score FROM orders",
    "v_stats": "SELECT c_custkey AS id, concat('M', c_custkey % 12) AS map, c_custkey % 10 AS orange_score, c_custkey % 7 AS blue_score FROM customer",
    "v_logs": """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'log' ELSE 'warn' END AS level,
      props AS message, ts, CASE WHEN user_id % 2 = 0 THEN 'shell' ELSE 'ui' END AS source FROM events""",
    "v_progress": """SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN concat('Duration: 01:00:', 10 + event_id % 50, '.00, start')
      ELSE concat('frame time=00:', 10 + event_id % 50, ':10.50 x') END AS line FROM events""",
    "v_games": """SELECT video_id, game_no, max(CASE WHEN m = 'E' THEN mode END) AS mode, max(CASE WHEN m = 'S' THEN t + 2 END) AS start_s, max(CASE WHEN m = 'E' THEN t END) AS end_s FROM (
      SELECT *, sum(CASE WHEN m = 'E' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t DESC, m, cls) AS game_no FROM (
      SELECT *, lag(m) OVER (PARTITION BY video_id ORDER BY t DESC, m, cls) AS b FROM (
      SELECT video_id, t, cls, CASE WHEN cls IN ('score', 'end') THEN 'E' ELSE 'S' END AS m, CASE WHEN cls = 'score' THEN 0 ELSE 1 END AS mode
      FROM v_markers WHERE t > 0 AND cls IN ('score', 'end', 'loading', 'intro'))) WHERE m <> coalesce(b, 'S')) GROUP BY video_id, game_no""",
    "v_chunks": f"""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY p) AS chunk_no, p AS "start", n AS "end" FROM (
      SELECT video_id, p, lead(p) OVER (PARTITION BY video_id ORDER BY p) AS n FROM (
      SELECT video_id, CAST(t AS DOUBLE) AS p FROM v_markers WHERE cls = 'loading' AND t > 0 AND t < {DURATION}
      UNION SELECT video_id, 0.0 FROM v_markers UNION SELECT video_id, {DURATION}.0 FROM v_markers)) WHERE n IS NOT NULL""",
}
NEEDS = {"v_games": ["v_markers"], "v_chunks": ["v_markers"]}


def sql(body: str, *views: str) -> str:
    """The query with the views that it names in front."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*NEEDS.get(v, []), v] if x not in order]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in order) + " " + body
