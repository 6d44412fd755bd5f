"""Registered queries over the star-schema tables, each with the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import predicates as P
from tapeline.functions import scalars as C
from tapeline.operators import intervals, matching, pixels, resolve, segments, telemetry
from tapeline.plans import views as V
from tapeline.plans.views import sql
from tapeline.sources import exports, history, logs
from tapeline.sources.shared import shared_folder

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def games_of(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_games(V.markers(spark, d))


@query(sql("""SELECT video_id, CAST(game_no AS BIGINT) AS game_no, CAST(mode AS INTEGER) AS mode, start_s, end_s,
  CASE WHEN start_s IS NULL THEN NULL ELSE CASE WHEN start_s // 3600 <> 0 THEN concat(start_s // 3600, ':') ELSE '' END || lpad(CAST(start_s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_s % 60 AS VARCHAR), 2, '0') END AS start_text
  FROM v_games""", "v_games"))
def segment_games(spark, d):
    g = games_of(spark, d)
    return g.select("video_id", "game_no", "mode", F.col("start_s").cast("long").alias("start_s"), "end_s", C.read_time(F.col("start_s")).alias("start_text"))


@query(sql("""SELECT g.video_id, CAST(g.game_no AS BIGINT) AS game_no, arg_max(upper(r.text), r.t) FILTER (WHERE field = 'click') AS click, arg_max(upper(r.text), r.t) FILTER (WHERE field = 'view') AS view
  FROM v_games g LEFT JOIN (SELECT user_id AS video_id, """ + V.SECS + """ AS t, event_type AS field, 'n' || CAST(event_id AS VARCHAR) AS text FROM events) r
  ON g.video_id = r.video_id AND r.t >= coalesce(g.start_s, 0) AND r.t < g.end_s GROUP BY g.video_id, g.game_no""", "v_games"))
def game_attributes(spark, d):
    text = C.team_name_clean(F.concat(F.lit("n"), F.col("event_id").cast("string")), F.lit(""))
    readings = V.table(spark, d, "events").select(F.col("user_id").alias("video_id"), V.seconds().alias("t"), F.col("event_type").alias("field"), text.alias("text"), F.col("event_id").alias("seq"))
    return segments.game_attributes(games_of(spark, d), readings, ["click", "view"], width=86400.0).select("video_id", "game_no", "click", "view")


@query(sql("""SELECT video_id, CAST(game_no AS BIGINT) AS game_no, CAST(min(CASE WHEN t >= start_s THEN t END) AS DOUBLE) AS start_s, CAST(max(CASE WHEN t <= end_s THEN t END) AS DOUBLE) AS end_s
  FROM v_games JOIN (SELECT video_id, t FROM v_markers WHERE cls = 'playing') USING (video_id) WHERE start_s IS NOT NULL GROUP BY video_id, game_no
  HAVING min(CASE WHEN t >= start_s THEN t END) IS NOT NULL AND max(CASE WHEN t <= end_s THEN t END) IS NOT NULL""", "v_games"))
def playing_bounds(spark, d):
    out = intervals.playing_bounds(games_of(spark, d), V.markers(spark, d))
    return out.select("video_id", "game_no", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))


@query(sql("""SELECT video_id, CAST(game_no AS BIGINT) AS request_id, (SELECT CAST(min(t) AS DOUBLE) FROM v_markers m WHERE m.video_id = g.video_id AND m.t >= g.start_s + 10 AND m.event_id % 3 <> 0) AS t
  FROM v_games g WHERE start_s IS NOT NULL""", "v_games"))
def next_frame(spark, d):
    asked = games_of(spark, d).where("start_s is not null").select("video_id", F.col("game_no").alias("request_id"), (F.col("start_s") + 10).alias("t0"))
    e = F.col("event_id") % 3 * 20
    return intervals.next_acceptable_frame(asked, V.markers(spark, d), P.bright_enough(e, e, e)).select("video_id", "request_id", "t")


@query(sql(f"""SELECT video_id, CAST(ceil(({V.DURATION} - t) / 3600.0) AS BIGINT) AS k, min(t) AS t FROM v_markers WHERE t > 0 AND t <= {V.DURATION}
  AND {V.DURATION} - ceil(({V.DURATION} - t) / 3600.0) * 3600 > 0 GROUP BY 1, 2""", "v_markers"))
def sample_frames(spark, d):
    return segments.sample_frames(V.markers(spark, d), V.durations(spark, d), 3600.0).select("video_id", "k", "t")


@query(sql("SELECT video_id, t // 100000 AS bucket, min(t) AS t FROM v_markers GROUP BY 1, 2", "v_markers"))
def downsample(spark, d):
    return segments.downsample(V.markers(spark, d), 0.00001).select("video_id", F.floor(F.col("t") / 100000).alias("bucket"), "t")


@query("""WITH e AS (SELECT event_id, event_id % 9000 AS s, event_id % 600 AS u, CASE event_id % 4 WHEN 0 THEN concat(event_id % 12, ':', event_id % 60) WHEN 1 THEN 'x:5' WHEN 2 THEN CAST(event_id % 9 AS VARCHAR) ELSE concat('9:', event_id % 60) END AS clock FROM events)
SELECT event_id, CASE WHEN s // 3600 <> 0 THEN concat(s // 3600, ':') ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS read_time,
  concat(u // 60, 'm', u % 60, 's') AS duration, CAST(event_id % 24 * 3600 + event_id % 60 * 60 + 7.5 AS DOUBLE) AS seconds,
  CAST(CASE WHEN event_id % 4 IN (0, 3) AND TRY_CAST(split_part(clock, ':', 1) AS INTEGER) <= 9 THEN s - ((10 - CAST(split_part(clock, ':', 1) AS INTEGER)) * 60 - CAST(split_part(clock, ':', 2) AS INTEGER) - 5) END AS BIGINT) AS estimate FROM e""")
def clock_text(spark, d):
    e, s = F.col("event_id"), F.col("event_id") % 9000
    clock = F.when(e % 4 == 0, F.concat((e % 12).cast("string"), F.lit(":"), (e % 60).cast("string"))).when(e % 4 == 1, "x:5").when(e % 4 == 2, (e % 9).cast("string")).otherwise(F.concat(F.lit("9:"), (e % 60).cast("string")))
    hms = F.concat_ws(":", (e % 24).cast("string"), (e % 60).cast("string"), F.lit("7.5"))
    return V.table(spark, d, "events").select("event_id", C.read_time(s).alias("read_time"), C.readable_duration(e % 600).alias("duration"), C.hms_to_sec(hms).alias("seconds"), C.clock_start_estimate(s, clock).cast("long").alias("estimate"))


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN concat(event_id % 150, 'x') ELSE CAST(event_id % 3 AS VARCHAR) END AS text FROM events),
v AS (SELECT user_id, event_id, CASE WHEN regexp_matches(text, '^[0-9]') THEN CAST(least(CAST(regexp_extract(left(text, 3), '^[0-9]+') AS INTEGER), 100) AS VARCHAR) ELSE '0' END AS c, text FROM r),
n AS (SELECT user_id, c, count(*) AS n, min(event_id) AS f FROM v GROUP BY 1, 2), p AS (SELECT user_id, text, count(*) AS n, min(event_id) AS f FROM v WHERE text <> '' GROUP BY 1, 2),
a AS (SELECT user_id, c, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM n), b AS (SELECT user_id, text, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM p)
SELECT a.user_id, coalesce(b.text, '') AS plain, a.c AS checked FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.k = 1 WHERE a.k = 1""")
def consensus(spark, d):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, "").when(e % 7 == 0, F.concat((e % 150).cast("string"), F.lit("x"))).otherwise((e % 3).cast("string"))
    r = V.table(spark, d, "events").select("user_id", e.alias("pos"), text.alias("text"))
    return resolve.consensus(r, ["user_id"]).withColumnRenamed("text", "plain").join(resolve.consensus(r, ["user_id"], checker=C.score_check).withColumnRenamed("text", "checked"), "user_id")


@query("""WITH RECURSIVE c AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
ten AS (SELECT c_nationkey, list(c_name ORDER BY n) AS roster FROM c WHERE n <= 10 GROUP BY 1),
own AS (SELECT c_nationkey, n // 6 AS g, list(replace(c_name, '0', 'o') ORDER BY c_custkey) AS readings FROM c GROUP BY 1, 2),
fold AS (SELECT c_nationkey, g, readings, roster, 0 AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS VARCHAR[]) AS names FROM own JOIN ten USING (c_nationkey)
  UNION ALL SELECT c_nationkey, g, readings, roster, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, list_append(names, coalesce(roster[best.j + 1], readings[i + 1])) FROM (
  SELECT *, list_sort(list_transform(list_filter(range(0, len(roster)), lambda j: NOT list_contains(used, j)),
    lambda j: {'d': CASE WHEN roster[j + 1] = readings[i + 1] THEN -1 ELSE levenshtein(lower(roster[j + 1]), lower(readings[i + 1])) END, 'j': j}))[1] AS best FROM fold WHERE i < len(readings)))
SELECT c_nationkey, g, array_to_string(names, '|') AS names FROM fold WHERE i = len(readings)""")
def resolve_names(spark, d):
    """Names of each nation's customers read with an error, six at a time, against a roster of ten, as many as two full sides have."""
    c = V.table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    numbered = c.withColumn("n", F.row_number().over(w))
    ten = numbered.where("n <= 10").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c_name"))), lambda x: x["c_name"]).alias("roster"))
    read = numbered.groupBy("c_nationkey", F.floor(F.col("n") / 6).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.regexp_replace(x["c_name"], "0", "o")).alias("readings"))
    return read.join(ten, "c_nationkey").select("c_nationkey", "g", F.array_join(resolve.resolved_names(F.col("readings"), F.col("roster")), "|").alias("names"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(lower(replace(replace(text, chr(10), ''), chr(13), '')), ' ')) AS word FROM documents),
m AS (SELECT * FROM (VALUES ('the', 1, 'North'), ('of', 1, 'North'), ('de', 2, 'South'), ('la', 2, 'South'), ('der', 3, 'East'), ('und', 3, 'East')) AS m(word, o, name))
SELECT doc_id, coalesce(arg_min(name, o), '') AS map FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT * FROM w JOIN m USING (word)) USING (doc_id) GROUP BY doc_id""")
def map_from_text(spark, d):
    return resolve.map_from_text(V.table(spark, d, "documents"), V.map_dictionary(spark), "doc_id")


@query(sql("SELECT game_id, count(*) AS n, min(id) AS first_id FROM v_detected JOIN v_stats USING (map, orange_score, blue_score) GROUP BY game_id", "v_detected", "v_stats"))
def attach(spark, d):
    return matching.candidate_counts(V.detected(spark, d), V.stats(spark, d)).select("game_id", "n", "first_id")


@query(sql("""
SELECT game_id, id, CAST(rank AS INTEGER) AS rank
FROM v_detected JOIN (
  SELECT *, row_number() OVER (PARTITION BY map, orange_score, blue_score ORDER BY id DESC) AS rank FROM v_stats) USING (map, orange_score, blue_score)
WHERE rank <= 3""", "v_detected", "v_stats"))
def attach_best(spark, d):
    return matching.best_candidates(V.detected(spark, d), V.stats(spark, d), [F.col("id").desc()], 3).select("game_id", "id", "rank")


@query(sql("""SELECT game_id, replace(replace(replace(replace(replace('{"map":"' || map || '","date":0,"orange":{"score":' || orange_score || '},"blue":{"score":' || blue_score || '}}', '"', '%22'), '{', '%7B'), '}', '%7D'), ':', '%3A'), ',', '%2C') AS payload
  FROM v_detected g WHERE NOT EXISTS (SELECT 1 FROM v_stats s WHERE s.map = g.map AND s.orange_score = g.orange_score AND s.blue_score = g.blue_score)""", "v_detected", "v_stats"))
def unattached(spark, d):
    side = lambda c: F.struct(F.col(c).alias("score"))
    return matching.unattached_games(V.detected(spark, d), V.stats(spark, d)).select("game_id", C.new_game_payload(F.col("map"), F.lit(0), side("orange_score"), side("blue_score")).alias("payload"))


def order_games(spark, d):
    """Orders as page nodes: two teams, players in the order of the lines."""
    line = V.table(spark, d, "lineitem")
    sort = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    player = lambda x: F.struct(F.struct(x["l_partkey"].cast("string").alias("niceName"), F.when(x["l_linenumber"] % 2 == 0, "A").otherwise("B").alias("team"), x["l_quantity"].cast("int").alias("kills"), x["l_linenumber"].alias("deaths"), x["l_suppkey"].cast("int").alias("assists"), F.lit(0).alias("score"), x["l_extendedprice"].alias("inflictedDamage"), x["l_tax"].alias("bulletsFiredAccuracy")).alias("data"))
    # lines are dealt out as they are, and become players where they have arrived
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*sort, "l_tax")).alias("lines"))
    o = V.table(spark, d, "orders")
    team = lambda n, s: F.struct(F.lit(n).alias("name"), s.cast("int").alias("score"))
    node = o.join(lines, "o_orderkey", "left").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.struct(F.col("o_orderstatus").alias("identifier")).alias("mode"), F.struct(F.col("o_orderpriority").alias("name")).alias("map"), F.struct((F.col("o_orderkey") % 900).cast("int").alias("duration"), team("A", F.col("o_orderkey") % 10), team("B", F.col("o_custkey") % 7)).alias("data"), F.transform(F.array_sort("lines"), player).alias("players"))
    return node.withColumn("data", F.struct(F.col("data.duration").alias("duration"), F.col("data.col2").alias("teamOne"), F.col("data.col3").alias("teamTwo"))).withColumnRenamed("o_orderkey", "pos")


SLOTS_SQL = """slots AS (SELECT *, l_linenumber % 2 AS side, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)"""
#: A player's cells and what they are in a line.
CELLS = {"name": "CAST(l_partkey AS VARCHAR)", "kills": "CAST(l_quantity AS INTEGER)", "deaths": "l_linenumber", "assists": "CAST(l_suppkey AS INTEGER)", "score": "0", "inflictedDamage": "l_extendedprice", "bulletsFiredAccuracy": "l_tax"}
WIDE_SQL = ", ".join(f"max(CASE WHEN side = {n} AND k = {k} THEN {v} END) AS {side}_{k}_{c}" for n, side in enumerate(("orange", "blue")) for k in range(1, 6) for c, v in CELLS.items())


@query("WITH " + SLOTS_SQL + """ SELECT o_orderkey, o_orderstatus AS mode, CAST(count(l_orderkey) AS INTEGER) AS n_players, o_orderpriority AS map, strftime(o_orderdate, '%d/%m/%Y') AS date, strftime(o_orderdate, '%H:%M') AS hour,
  concat(o_orderkey % 900 // 60, 'm', o_orderkey % 900 % 60, 's') AS readable_duration, CAST(o_orderkey % 900 AS INTEGER) AS duration, CAST(o_orderkey % 10 AS INTEGER) AS orange_score, CAST(o_custkey % 7 AS INTEGER) AS blue_score,
  """ + WIDE_SQL + """, CAST(count(*) FILTER (WHERE k > 5) AS INTEGER) AS n_dropped FROM orders LEFT JOIN slots ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, o_custkey""")
def history_wide(spark, d):
    return history.export_wide(history.game_teams(order_games(spark, d)), ("pos",)).withColumnRenamed("pos", "o_orderkey")


@query("""SELECT CAST(o_orderkey % 4 AS INTEGER) AS season, CAST(o_orderkey // 100 AS INTEGER) AS page, o_orderstatus AS mode, o_orderpriority AS map, CAST(o_orderkey % 900 AS INTEGER) AS duration, CAST(o_orderkey % 10 AS INTEGER) AS orange_score,
  CAST(o_custkey % 7 AS INTEGER) AS blue_score, CAST(count(l_orderkey) AS INTEGER) AS n_players FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderpriority""")
def history_pages(spark, d):
    """Orders written as page documents, with pages that have no list of games among them, and read back."""
    node = F.struct("createdAt", "mode", "map", "data", "players")
    games = order_games(spark, d).withColumn("season", F.col("pos") % 4).withColumn("page", F.floor(F.col("pos") / 100))
    pages = games.groupBy("season", "page").agg(F.collect_list(node).alias("nodes"))
    full = pages.select(F.to_json(F.struct("season", "page", F.struct(F.struct("nodes").alias("gameHistories")).alias("data"))).alias("value"))
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    full.unionByName(pages.select(F.to_json(F.struct("season", "page", F.struct(F.lit(1).alias("other")).alias("data"))).alias("value"))).write.text(folder, compression="gzip")
    flat = history.n_players(history.game_teams(history.read_history(spark, folder)))
    return flat.join(pages.select("season", "page"), ["season", "page"], "left_semi").select(F.col("season").cast("int").alias("season"), F.col("page").cast("int").alias("page"), "mode", "map", "duration", "orange_score", "blue_score", "n_players")


@query("WITH " + SLOTS_SQL + " SELECT l_orderkey AS o_orderkey, CASE side WHEN 0 THEN 'orange' ELSE 'blue' END AS side, CAST(k - 1 AS INTEGER) AS slot, CAST(l_partkey AS VARCHAR) AS name, CAST(l_quantity AS INTEGER) AS kills FROM slots WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def history_players(spark, d):
    return history.history_players(history.game_teams(order_games(spark, d)), ["pos"]).select(F.col("pos").alias("o_orderkey"), "side", "slot", "name", "kills")


@query("SELECT o_orderkey AS pos FROM orders WHERE o_orderkey % 4 = 2 AND o_orderkey // 100 >= 3 AND o_orderkey // 100 < 8")
def page_window(spark, d):
    pages = order_games(spark, d).withColumn("season", F.col("pos") % 4).withColumn("page", F.floor(F.col("pos") / 100))
    own = history.page_window(history.append_pages(pages, pages), season=2, skip=2, n_pages=5)
    return own.dropDuplicates(["season", "page", "pos"]).select("pos")


@query("""WITH p AS (SELECT event_id % 7 AS season, event_id // 3 AS page FROM events) SELECT DISTINCT season, page FROM p""")
def append_pages(spark, d):
    p = V.table(spark, d, "events").select((F.col("event_id") % 7).alias("season"), F.floor(F.col("event_id") / 3).alias("page"))
    return history.append_pages(p, p, once=True)


@query(sql("SELECT m.video_id, m.event_id, CAST(game_no AS BIGINT) AS game_no FROM v_markers m JOIN v_games g ON m.video_id = g.video_id AND t >= start_s AND t < end_s", "v_games"))
def frames_in_games(spark, d):
    return intervals.frames_in_games(V.markers(spark, d), games_of(spark, d), 86400.0).select("video_id", "event_id", "game_no")


@query(sql('SELECT video_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST("start" AS DOUBLE) AS "start", CAST("end" AS DOUBLE) AS "end" FROM v_chunks', "v_chunks"))
def split_at_cuts(spark, d):
    return intervals.split_at_cuts(V.durations(spark, d), V.cuts(spark, d)).select("video_id", "chunk_no", "start", "end")


def chunks_of(spark, d):
    return intervals.split_at_cuts(V.durations(spark, d), V.cuts(spark, d)).withColumn("remove", F.col("chunk_no") % 3 == 0)


@query(sql("""SELECT m.video_id, event_id, CAST(t - "start" + shift AS DOUBLE) AS new_t FROM v_markers m JOIN (SELECT *, coalesce(sum("end" - "start") OVER (PARTITION BY video_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
  FROM v_chunks WHERE chunk_no % 3 <> 0) c ON m.video_id = c.video_id AND t >= "start" AND t < "end" """, "v_chunks"))
def retime(spark, d):
    return intervals.retime(V.markers(spark, d), chunks_of(spark, d), width=86400.0).select("video_id", "event_id", "new_t")


@query(sql("""SELECT video_id, bool_or(chunk_no % 3 = 0) AS valid, CAST(count(*) FILTER (WHERE chunk_no % 3 <> 0) AS BIGINT) AS n_kept,
  CAST(sum(CASE WHEN chunk_no % 3 <> 0 THEN "end" - "start" ELSE 0 END) * 2 AS DOUBLE) AS twice FROM v_chunks GROUP BY video_id""", "v_chunks"))
def kept_chunks(spark, d):
    c = chunks_of(spark, d)
    kept = P.keep_chunks(c)
    twice = intervals.concat_chunks(kept, kept).groupBy("video_id").agg(F.max("new_end").alias("twice"))
    return P.cut_is_valid(c).join(kept.groupBy("video_id").agg(F.count("*").alias("n_kept")), "video_id").join(twice, "video_id")


@query(sql("""SELECT job_id, seq, CAST(ceil(100 * c / dur) AS INTEGER) AS percent FROM (SELECT job_id, seq, CASE WHEN line LIKE 'frame%' THEN CAST(substr(line, 15, 2) AS INTEGER) * 60 + 10.5 END AS c,
  last_value(CASE WHEN line LIKE 'Duration%' THEN 3600 + CAST(substr(line, 17, 2) AS DOUBLE) END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq) AS dur FROM v_progress) WHERE c IS NOT NULL AND dur > 0""", "v_progress"))
def progress(spark, d):
    return telemetry.progress_series(V.progress(spark, d)).select("job_id", "seq", "percent")


@query("""SELECT user_id AS job_id, event_id AS seq, CAST(floor(100.0 / 4 * (event_id % 4) + 100.0 / 4 * least(greatest((event_id % 90 - 10) / 50.0, 0), 100) + 0.5) AS INTEGER) AS "global"
FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(event_id % 4) = 3)""")
def multi_part(spark, d):
    e = F.col("event_id")
    p = V.table(spark, d, "events").select(F.col("user_id").alias("job_id"), e.alias("seq"), (e % 4).alias("part"), (e % 90).cast("double").alias("current"), F.lit(10.0).alias("start"), F.lit(60.0).alias("end"))
    whole = p.groupBy("job_id").agg(F.max("part").alias("m")).where("m = 3")
    return telemetry.multi_part_progress(p.join(whole, "job_id", "left_semi")).select("job_id", "seq", "global")


@query("""SELECT job_id, seq, v FROM (SELECT user_id AS job_id, event_id AS seq, event_id * 7919 % 1001 // 10 AS v, max(event_id * 7919 % 1001 // 10) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE v > coalesce(m, 0)""")
def monotone(spark, d):
    chunk = F.concat(F.lit("[download] "), ((F.col("event_id") * 7919 % 1001) / 10).cast("string"), F.lit("% of x"))
    v = V.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), C.download_percent(chunk).cast("long").alias("v"))
    return telemetry.monotone_progress(v, value="v")


@query("""SELECT user_id, event_id, v FROM (SELECT user_id, event_id, event_id % 3 AS v, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE v <> b""")
def gauge(spark, d):
    s = V.table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("ts"), "event_id", (F.col("event_id") % 3).alias("value"))
    return telemetry.gauge_changes(s).select("user_id", "event_id", F.col("value").alias("v"))


@query(sql("SELECT seq, message, source FROM v_logs WHERE level = 'error' ORDER BY seq DESC LIMIT 500", "v_logs"))
def logs_tail(spark, d):
    own = V.logs(spark, d)
    both = logs.union_logs(own.where("source = 'shell'"), own.where("source = 'ui'"))
    return logs.last_n_logs(P.log_level_filter(both, "error"), "error").select("seq", "message", "source")


@query(sql("""SELECT CAST(0 AS BIGINT) AS line_no, concat('Console', chr(10), 'Generated at: now', chr(10), 'Total logs: ', count(*), chr(10), repeat('=', 80)) AS value FROM v_logs UNION ALL
  SELECT n, concat('[', n, '] <', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.', lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z> [', upper(level), '] [', source, ']', chr(10), message, chr(10), repeat('-', 40))
  FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM v_logs)""", "v_logs"))
def logs_report(spark, d):
    return logs.export_logs(V.logs(spark, d), "Console", "now")


@query(sql("SELECT seq, level, CASE WHEN seq % 2 = 0 THEN concat('{\"id\":', seq, '}') ELSE concat('a ', seq) END AS message, source FROM v_logs", "v_logs"))
def logs_read(spark, d):
    """Logs of two producers written as JSON lines, some messages as objects and some as parts, and read back."""
    own, folder = V.logs(spark, d), f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    head = [F.col("seq"), F.col("level"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("source")]
    objects = own.where("seq % 2 = 0").select(F.to_json(F.struct(*head, F.struct(F.col("seq").alias("id")).alias("message"))).alias("value"), "source")
    parts = own.where("seq % 2 <> 0").select(F.to_json(F.struct(*head, logs.message_text(F.array(F.lit("a"), F.col("seq").cast("string"))).alias("message"))).alias("value"), "source")
    for name in ("shell", "ui"):
        objects.unionByName(parts).where(F.col("source") == name).select("value").write.text(f"{folder}/{name}")
    return logs.union_logs(logs.read_logs(spark, f"{folder}/shell"), logs.read_logs(spark, f"{folder}/ui")).select("seq", "level", "message", "source")


@query(sql("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY "start") AS order_no, CAST("start" AS DOUBLE) AS "start", CAST("end" AS DOUBLE) AS "end" FROM v_chunks WHERE chunk_no % 3 <> 0""", "v_chunks"))
def chunk_order(spark, d):
    return intervals.order_chunks(chunks_of(spark, d)).select("video_id", F.col("order_no").cast("long").alias("order_no"), "start", "end")


@query(sql("SELECT video_id, CAST(game_no AS BIGINT) AS game_no, row_number() OVER (PARTITION BY video_id ORDER BY end_s) AS list_no, count(*) OVER (PARTITION BY video_id) AS games_found FROM v_games", "v_games"))
def games_list(spark, d):
    g = games_of(spark, d)
    return segments.games_in_list_order(g).join(segments.games_found(g), "video_id").select("video_id", "game_no", F.col("list_no").cast("long").alias("list_no"), "games_found")


ID = "lpad(CAST(page_id AS VARCHAR), 11, 'a')"


@query(f"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?list=x&v=' || {ID} || '&t=3' WHEN 1 THEN 'youtube.com/live/' || {ID} || CASE WHEN page_id % 12 = 1 THEN '&a b' ELSE '&a=b' END WHEN 2 THEN 'https://youtu.be/' || {ID} || '?si=q'
  WHEN 3 THEN 'twitch.tv/some_one/clip/' || {ID} WHEN 4 THEN 'https://www.twitch.tv/videos/' || page_id ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://www.youtube.com/watch?v=' || {ID} ELSE url END AS canonical, CASE WHEN page_id % 6 = 0 THEN 'youtube' WHEN page_id % 6 = 1 AND page_id % 12 <> 1 THEN 'youtube' WHEN page_id % 6 IN (3, 4) THEN 'twitch' END AS platform,
  concat('n', page_id, '#', page_id) AS tag, page_id % 2 = 0 AS is_tag, concat('n', page_id) AS tag_name FROM u""")
def urls(spark, d):
    p, i = F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 11, "a")
    url = F.when(p % 6 == 0, F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), i, F.lit("&t=3"))).when(p % 6 == 1, F.concat(F.lit("youtube.com/live/"), i, F.when(p % 12 == 1, "&a b").otherwise("&a=b"))).when(p % 6 == 2, F.concat(F.lit("https://youtu.be/"), i, F.lit("?si=q")))
    url = url.when(p % 6 == 3, F.concat(F.lit("twitch.tv/some_one/clip/"), i)).when(p % 6 == 4, F.concat(F.lit("https://www.twitch.tv/videos/"), p.cast("string"))).otherwise(F.col("url"))
    tag = F.concat(F.lit("n"), p.cast("string"), F.lit("#"), p.cast("string"))
    pasted = C.player_tag_from_paste(F.concat(F.lit("https://x/"), tag, F.lit("/z")))
    canonical = C.canonical_video_url(F.col("u"))
    return V.table(spark, d, "pages").withColumn("u", url).select("page_id", canonical.alias("canonical"), P.platform(canonical).alias("platform"), pasted.alias("tag"), P.is_player_tag(F.when(p % 2 == 0, tag).otherwise(F.concat(tag, F.lit("\n")))).alias("is_tag"), C.tag_name(tag).alias("tag_name"))


@query(sql("""SELECT frame_id, CAST(min(mode) AS INTEGER) AS mode FROM (SELECT frame_id, template, p.mode, count(DISTINCT probe) AS n, bool_and(abs(a.r - p.r) <= tol AND abs(a.g - p.g) <= tol AND abs(a.b - p.b) <= tol) AS ok
  FROM v_pixels a JOIN v_probes p USING (x, y) GROUP BY ALL) WHERE ok AND n = 2 GROUP BY frame_id""", "v_pixels", "v_probes"))
def templates(spark, d):
    return pixels.match_templates(V.pixels(spark, d), V.probes(spark))


@query(sql("""SELECT f.frame_id, coalesce(bool_and(anyone AND every AND n = 2) AND count(side) = 2, false) AS playing FROM (SELECT DISTINCT frame_id FROM v_pixels) f LEFT JOIN (
  SELECT frame_id, side, count(DISTINCT slot) AS n, bool_or(own) AS anyone, bool_and(own OR (r <= 250 AND g <= 250 AND b <= 250)) AS every FROM (SELECT *, abs(r - 200) <= 90 AND abs(g - 200) <= 90 AND abs(b - 200) <= 90 AS own
  FROM v_pixels JOIN (VALUES ('a', 1, 5, 5), ('a', 2, 10, 6), ('b', 1, 20, 7), ('b', 2, 30, 8)) AS s(side, slot, x, y) USING (x, y)) GROUP BY ALL) q ON f.frame_id = q.frame_id GROUP BY f.frame_id""", "v_pixels"))
def playing(spark, d):
    slots = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 10, 6), ("b", 1, 20, 7), ("b", 2, 30, 8)], "side string, slot int, x long, y long")
    return pixels.playing_frame(V.pixels(spark, d), slots, {"a": (200, 200, 200), "b": (200, 200, 200)}, 90, 250)


@query(sql("""SELECT frame_id, coalesce(min(CASE WHEN w AND x < 50 AND y < 30 THEN x END), 0) AS x1, coalesce(min(CASE WHEN w AND x < 50 AND y < 30 THEN y END), 0) AS y1,
  coalesce(1 + max(CASE WHEN w AND x <= 50 AND y < 30 THEN x END), 0) AS x2, coalesce(1 + max(CASE WHEN w AND x < 50 AND y <= 30 THEN y END), 0) AS y2
  FROM (SELECT *, r >= 155 AND g >= 155 AND b >= 155 AS w FROM v_pixels) GROUP BY frame_id""", "v_pixels"))
def bbox(spark, d):
    out = pixels.bright_bbox(V.pixels(spark, d), 50, 30, 100)
    return out.select("frame_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(sql("""SELECT frame_id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, white, x2 - x1 <= 63 AND y2 - y1 <= 30 AS size_ok, frame_id % 5 = 0 OR (abs(x1 - 10) <= 10 AND abs(y1 - 10) <= 10 AND abs(x2 - 60) <= 10 AND abs(y2 - 35) <= 10) AS bound_ok,
  CAST(floor(x1 - gx + 0.5) AS INTEGER) AS gx1, CAST(floor(y1 - gy + 0.5) AS INTEGER) AS gy1, CAST(floor(x2 + CASE WHEN l = 25 THEN gx ELSE (x2 - x1) * 0.25 END + 0.5) AS INTEGER) AS gx2, CAST(floor(y2 + gy + 0.5) AS INTEGER) AS gy2 FROM (
  SELECT *, least(x1, (x2 - x1) * l / 100.0) AS gx, least(y1, (y2 - y1) * 10 / 100.0) AS gy FROM (
  SELECT *, frame_id % 20 AS x1, frame_id * 7 % 20 AS y1, frame_id % 20 + 40 + b % 30 AS x2, frame_id * 7 % 20 + 20 + frame_id % 20 AS y2, CASE WHEN frame_id % 2 = 0 THEN 25 ELSE 40 END AS l FROM (
  SELECT frame_id, CAST(floor(avg(r) + 0.5) AS BIGINT) AS r, CAST(floor(avg(g) + 0.5) AS BIGINT) AS g, CAST(floor(avg(b) + 0.5) AS BIGINT) AS b, CAST(sum(CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b > 127.3 THEN 255 ELSE 0 END) AS BIGINT) AS white FROM v_pixels GROUP BY frame_id)))""", "v_pixels"))
def mean_color(spark, d):
    """Mean colours, and boxes made from them: their size, their nearness to a bound that some frames have, and grown by margins."""
    p = V.pixels(spark, d)
    b, f = F.col("b"), F.col("frame_id")
    x, y = f % 20, f * 7 % 20
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 40 + b % 30).alias("x2"), (y + 20 + x).alias("y2"))
    bound = F.when(f % 5 != 0, F.array(*map(F.lit, (10, 10, 50, 25))))
    grown = C.expand_box(F.col("box"), F.array(F.lit(10), F.lit(25), F.lit(10), F.when(f % 2 == 0, 25).otherwise(40)))
    out = pixels.mean_color(p).join(pixels.black_and_white(p, 127.3).groupBy("frame_id").agg(F.sum("v").alias("white")), "frame_id").withColumn("box", box).withColumn("grown", grown)
    checks = P.box_size_ok(F.col("box"), 63, 30).alias("size_ok"), P.box_matches_bound(F.col("box"), bound, F.lit(2000)).alias("bound_ok")
    return out.select("frame_id", "r", "g", "b", "white", *checks, *(F.col("grown")[c].alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")))


@query(sql("""SELECT frame_id, CAST(y AS BIGINT) AS y, CAST(n AS INTEGER) AS height FROM (SELECT frame_id, i, min(y) AS y, count(*) AS n, max(last) AS last FROM (
  SELECT *, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM (SELECT frame_id, y, max(max(y)) OVER (PARTITION BY frame_id) AS last,
  sum(CASE WHEN c = 'w' THEN 1 ELSE 0 END) > 0 AND ((sum(CASE WHEN c = 'o' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN c = 'b' THEN 1 ELSE 0 END) > 0) OR sum(CASE WHEN c = 'r' THEN 1 ELSE 0 END) > 0) AS hot
  FROM (SELECT frame_id, y, CASE WHEN r >= 175 AND g >= 175 AND b >= 175 THEN 'w' WHEN r >= 175 AND g >= 135 AND b <= 80 THEN 'o' WHEN r <= 80 AND g <= 80 AND b >= 175 THEN 'b' WHEN r >= 175 AND g <= 80 AND b <= 80 THEN 'r' END AS c FROM v_pixels)
  GROUP BY frame_id, y) WHERE hot) GROUP BY frame_id, i) WHERE y + n - 1 < last AND n BETWEEN 1 AND 9""", "v_pixels"))
def runs(spark, d):
    palette = [("white", (255, 255, 255)), ("orange", (255, 215, 0)), ("blue", (0, 0, 255)), ("red", (255, 0, 0))]
    lines = pixels.line_color_counts(V.pixels(spark, d), palette, 80)
    hot = pixels.hot_line(F.col("white"), F.col("orange"), F.col("blue"), F.col("red"))
    return pixels.text_runs(lines.select("frame_id", "y", hot.alias("hot")), 5, 4)


def panel_sql(left: bool) -> str:
    return sql(f"""SELECT e.frame_id, CAST(coalesce(min(q.x) FILTER (WHERE q.x > 0), 0) AS BIGINT) AS x1, y1, CAST(coalesce(max(q.x), 0) AS BIGINT) AS x2, y2, y2 - y1 BETWEEN 10 AND 30 AS tall FROM (
  SELECT f.frame_id, CAST(coalesce(max(p.y) FILTER (WHERE NOT p.hit AND p.y <= v.fourth - 2), 0) AS BIGINT) AS y1, CAST(coalesce(v.bottom + 2, 0) AS BIGINT) AS y2 FROM (SELECT DISTINCT frame_id FROM v_pixels) f LEFT JOIN (
  SELECT frame_id, max(CASE WHEN k = 1 THEN e END) AS bottom, max(CASE WHEN k = 4 THEN s END) AS fourth FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY e DESC) AS k FROM (
  SELECT frame_id, i, min(y) AS s, max(y) AS e FROM (SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM v_pixels WHERE x = 30 AND r >= 100 AND g >= 60 AND b >= 60) GROUP BY ALL)) GROUP BY frame_id) v ON v.frame_id = f.frame_id
  LEFT JOIN (SELECT frame_id, y, r >= 100 AND g >= 60 AND b >= 60 AS hit FROM v_pixels WHERE x = 30) p ON p.frame_id = f.frame_id GROUP BY f.frame_id, v.bottom) e
  LEFT JOIN (SELECT * FROM v_pixels WHERE r >= 55 AND g >= 15 AND b >= 15 AND {"x < 15" if left else "x > 45"}) q ON q.frame_id = e.frame_id AND q.y = e.y1 GROUP BY ALL""", "v_pixels")


def panel_of(spark, d, left):
    box = pixels.panel_bbox(V.pixels(spark, d), (255, 215, 215), 30, 60, 40, left, 155, 200)
    return box.select("frame_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), P.panel_height_ok(F.struct("y1", "y2"), 1, 20, 0.5).alias("tall"))


@query(panel_sql(True))
def panel(spark, d):
    return panel_of(spark, d, True)


@query(panel_sql(False))
def panel_right(spark, d):
    return panel_of(spark, d, False)


#: Invented probes of frame classes: where each looks.
CLASS_PROBES = {"score": (5, 5), "end": (10, 6), "loading": (20, 7), "intro": (30, 8), "playing": (40, 9)}
CLASSES_SQL = "v_classes AS (SELECT frame_id % 3 AS video, frame_id // 3 + 1 AS t, CASE " + " ".join(f"WHEN bool_or(x = {x} AND y = {y} AND least(r, g, b) >= 90) THEN '{c}'" for c, (x, y) in CLASS_PROBES.items()) + " END AS cls FROM v_pixels GROUP BY frame_id)"


def frames_of(spark, d):
    """Pixels as the bytes of frames of 60 x 40; a pixel that is not there is black."""
    x, y, r, g, b = (F.col(c).cast("long") for c in ("x", "y", *pixels.RGB))
    cell = (y * 60 + x) * 2**24 + sum(F.coalesce(v, F.lit(0)) * 256**k for k, v in enumerate((b, g, r)))
    made = V.pixels(spark, d).groupBy("frame_id").agg(F.collect_list(cell).alias("cells"))
    return made.select((F.col("frame_id") % 3).cast("string").alias("video_id"), (F.floor(F.col("frame_id") / 3) + 1).cast("double").alias("t"), "cells").mapInArrow(drawn, FRAMES)


FRAMES = "video_id string, t double, width int, height int, rgb binary"


def drawn(batches: Iterator[pa.RecordBatch], width: int = 60, height: int = 40, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    """Frames(video_id, t, cells) as bytes; a cell is its place times 2^24 and its colour. Every cell is written once, whatever its frame holds."""
    for batch in batches:
        for own in (batch.slice(i, at_once) for i in range(0, batch.num_rows, at_once)):
            cells = own.column("cells")
            value, frame = cells.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(own.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
            images = np.zeros((own.num_rows, width * height, 3), np.uint8)
            for k, shift in enumerate((16, 8, 0)):
                images[frame, value >> 24, k] = value >> shift & 255
            size = [pa.array([n] * own.num_rows, pa.int32()) for n in (width, height)]
            yield pa.RecordBatch.from_arrays([own.column("video_id"), own.column("t"), *size, pa.array([i.tobytes() for i in images], pa.binary())], names=["video_id", "t", "width", "height", "rgb"])


def classes_of(spark, d):
    """Frames to probed points, to matched templates, to one class a frame."""
    spec = spark.createDataFrame([(c, c, 0, 1, x, y, 255, 255, 255, 165) for c, (x, y) in CLASS_PROBES.items()], "class string, template string, mode int, probe int, x int, y int, r int, g int, b int, tol int")
    frames = frames_of(spark, d)
    seen = pixels.probe_frames(frames, list(CLASS_PROBES.values())).withColumn("frame_id", F.struct("video_id", "t"))
    hit = pixels.match_templates(seen, spec, ("class",)).groupBy("frame_id").agg(*(F.coalesce(F.bool_or(F.col("class") == c), F.lit(False)).alias(c) for c in CLASS_PROBES))
    cls = P.frame_class(*(F.col(c) for c in CLASS_PROBES))
    return frames.select("video_id", "t").join(hit.select("frame_id.video_id", "frame_id.t", cls.alias("cls")), ["video_id", "t"], "left")


@query(sql("SELECT CAST(video AS VARCHAR) AS video_id, CAST(t AS BIGINT) AS t, cls FROM v_classes", "v_pixels").replace(" SELECT CAST(video AS", ", " + CLASSES_SQL + " SELECT CAST(video AS", 1))
def frame_classes(spark, d):
    return classes_of(spark, d).select("video_id", F.col("t").cast("long").alias("t"), "cls")


@query(sql("""SELECT region, frame_id, count(*) AS n, CAST(sum(a.x - x1) AS BIGINT) AS sx, CAST(sum(a.y - y1) AS BIGINT) AS sy FROM v_pixels a JOIN (VALUES ('c', 20.0, 0.0, 40.0, 10.0), ('s0', 0.0, 0.0, 45.6, 6.0), ('s1', 0.0, 20.0, 45.6, 26.0)) AS g(region, x1, y1, x2, y2)
  ON a.x >= x1 AND a.x < x2 AND a.y >= y1 AND a.y < y2 GROUP BY ALL""", "v_pixels"))
def crop(spark, d):
    one = spark.range(1)
    center = one.select(F.lit("c").alias("region"), C.centered_box(F.lit(20), F.lit(10), F.lit(60)).alias("box"))
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(60.0).alias("x2"), F.lit(40.0).alias("y2"))
    slices = one.select(F.posexplode(C.name_slices(box, 2, False)).alias("i", "box")).select(F.concat(F.lit("s"), F.col("i").cast("string")).alias("region"), "box")
    own = center.unionByName(slices).select("region", "box.*")
    out = pixels.crop_regions(V.pixels(spark, d), own)
    return out.groupBy("region", "frame_id").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("sx"), F.sum("y").cast("long").alias("sy"))


@query("""WITH g AS (SELECT o_custkey AS video_id, o_orderkey, o_orderpriority AS map, o_totalprice > 100000 AS selected, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS box FROM orders)
SELECT video_id, bool_and(selected) AS all_selected, bool_or(selected) AS some_selected, CAST(sum(used) AS BIGINT) AS boxes FROM (SELECT *, first_value(box IGNORE NULLS) OVER (PARTITION BY video_id, map ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM g) GROUP BY video_id""")
def selection(spark, d):
    o = F.col("o_orderkey")
    g = V.table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), o.alias("game_order"), F.col("o_orderpriority").alias("map"), (F.col("o_totalprice") > 100000).alias("selected"), F.when(o % 3 != 0, o).alias("box"))
    return segments.selection(g).join(matching.first_box_per_map(g).groupBy("video_id").agg(F.sum("box_used").alias("boxes")), "video_id")


@query("""SELECT o_orderkey, o_custkey % 4 = 0 AND c_acctbal > 0 AND o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0 AS eligible, o_custkey % 4 = 0 AS member FROM orders JOIN customer ON o_custkey = c_custkey""")
def eligible(spark, d):
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    users = c.select(F.col("c_custkey").alias("user_id"))
    beta = users.where("user_id % 4 = 0")
    maps = spark.createDataFrame([("m1", [1]), ("m2", [2]), ("m0", None)], "name string, margins array<int>")
    g = o.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 5 != 0, "x").alias("video_path"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("map"))
    out = matching.upload_eligible(g, beta, c.select(F.col("c_custkey").alias("user_id"), F.ceil("c_acctbal").alias("coins")), maps)
    member = matching.beta_members(users, beta).withColumn("member", F.lit(True))
    return out.join(users, "user_id").join(member, "user_id", "left").select("o_orderkey", "eligible", F.coalesce("member", F.lit(False)).alias("member"))


@query("""SELECT event_id, CAST(event_id % 2000 AS INTEGER) AS w, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'rescale' END AS route, concat('P - A vs B - M - f (', event_id, ').mp4') AS name, CAST(CASE WHEN event_id % 5 <> 3 THEN event_id % 5 - 3 ELSE event_id % 3 END AS INTEGER) AS version,
  concat('{"a": "...", "n": [', event_id, ', "..."], "k": "data"}') AS redacted, 'TEAM' || event_id AS team, CAST(CASE WHEN event_id % 200 <= 100 THEN event_id % 200 ELSE 0 END AS INTEGER) AS score, concat('a', event_id, 'b', chr(10), 'c') AS stripped FROM events""")
def misc_scalars(spark, d):
    e = F.col("event_id")
    text = lambda x: x.cast("string")
    line = F.concat(F.lit("Stream: h264, "), text(e % 2000), F.lit("x"), F.when(e % 2 == 0, "1080").otherwise("720"), F.lit(", 60 fps"))
    res = C.resolution(line)
    json = F.concat(F.lit('{"a": "data:image/png;base64,xx", "n": ['), text(e), F.lit(', "data:image/x"], "k": "data"}'))
    name = C.output_name(F.lit("A"), F.lit("B"), F.lit("M"), F.lit("f"), text(e), F.lit("x.y.MP4"), "P")
    version = C.version_diff(F.concat(F.lit("1."), text(e % 5), F.lit("."), text(e % 3)), F.lit("1.3"))
    return V.table(spark, d, "events").select("event_id", res["w"].alias("w"), C.resolution_route(res["h"]).alias("route"), name.alias("name"), version.alias("version"), C.redact_inline_images(json).alias("redacted"), C.team_name_clean(F.concat(F.lit("team"), text(e)), F.lit(" ")).alias("team"), C.accept_score(text(e % 200)).alias("score"), C.strip_first_newline(F.concat(F.lit("a"), text(e), F.lit("\nb\nc"))).alias("stripped"))



@query(sql("""SELECT m.video_id, CAST(game_no AS BIGINT) AS game_no, arg_min(t, md5(concat('7:', t))) AS t FROM v_markers m JOIN v_games g ON m.video_id = g.video_id AND t >= start_s AND t < end_s GROUP BY m.video_id, game_no""", "v_games"))
def one_per_game(spark, d):
    held = intervals.frames_in_games(V.markers(spark, d), games_of(spark, d), 86400.0)
    return segments.one_frame_per_game(held.select("video_id", "game_no", "t")).select("video_id", "game_no", "t")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 HOUR, '%d/%m/%Y') AS date, strftime(o_orderdate + INTERVAL 2 HOUR, '%H:%M') AS hour FROM orders")
def dates(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return V.table(spark, d, "orders").select("o_orderkey", C.date_text(ts, "+02:00").alias("date"), C.hour_text(ts, "+02:00").alias("hour"))


@query("""
SELECT doc_id, md5(nfc_normalize(t)) AS text_md5, nfc_normalize(t) <> t AS changed
FROM (SELECT doc_id, replace(replace(replace(text, 'e', 'e' || chr(769)), 'u', 'u' || chr(776)), 'n', 'n' || chr(771)) AS t FROM documents)""")
def nfc(spark, d):
    """Texts whose e, u and n are followed by combining marks, as some systems write accents."""
    text = F.col("text")
    for letter, mark in (("e", "\u0301"), ("u", "\u0308"), ("n", "\u0303")):
        text = F.replace(text, F.lit(letter), F.lit(letter + mark))
    made = V.table(spark, d, "documents").select("doc_id", text.alias("t")).withColumn("c", C.nfc(F.col("t")))
    return made.select("doc_id", F.md5(F.col("c").cast("binary")).alias("text_md5"), (F.col("c") != F.col("t")).alias("changed"))


@query(sql("""SELECT video_id, string_agg(CASE WHEN start_s // 3600 <> 0 THEN concat(start_s // 3600, ':') ELSE '' END || lpad(CAST(start_s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_s % 60 AS VARCHAR), 2, '0') || ' O vs B - M', chr(10) ORDER BY start_s) AS text
  FROM v_games WHERE start_s IS NOT NULL GROUP BY video_id""", "v_games"))
def timecodes(spark, d):
    return exports.export_timecodes(named_games(spark, d))


def named_games(spark, d):
    return games_of(spark, d).select("*", F.lit("O").alias("orange"), F.lit("B").alias("blue"), F.lit("M").alias("map"), F.col("start_s").isNotNull().alias("selected"))


@query(sql("""SELECT video_id, CAST(start_s AS BIGINT) AS "start", CAST(end_s - start_s AS BIGINT) AS length, 'P - O vs B - M (' || CASE WHEN start_s // 3600 <> 0 THEN concat(start_s // 3600, ':') ELSE '' END || lpad(CAST(start_s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_s % 60 AS VARCHAR), 2, '0') || ').mkv' AS name
  FROM v_games WHERE start_s IS NOT NULL""", "v_games"))
def manifest(spark, d):
    m = exports.cut_manifest(named_games(spark, d), "", "a.b.MKV", "P")
    return m.select("video_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "name")


@query(sql("""SELECT video_id, count(*) AS n FROM v_markers m WHERE NOT EXISTS (SELECT 1 FROM v_games g WHERE g.video_id = m.video_id AND start_s IS NOT NULL AND m.t > start_s AND m.t < end_s) GROUP BY video_id""", "v_games"))
def jump_filter(spark, d):
    g = games_of(spark, d).where("start_s is not null").select("video_id", "game_no", F.col("end_s").alias("t"), F.col("start_s").alias("estimate"), *(F.lit("x").alias(c) for c in ("map", "orange", "blue")))
    return segments.without_jumped(V.markers(spark, d), segments.jump_hints(g), 86400.0).groupBy("video_id").agg(F.count("*").alias("n"))


@query(sql("""SELECT video_id, CAST(game_no AS BIGINT) AS game_no, max(t) AS t, max(t) - 100 AS estimate FROM (
  SELECT m.video_id, game_no, t, event_id, max(cls = 'playing') OVER w AS a, max(event_id % 3 = 0) OVER w AS b, max(event_id % 3 = 1) OVER w AS c FROM v_markers m JOIN v_games g ON m.video_id = g.video_id AND t >= start_s AND t < end_s
  WINDOW w AS (PARTITION BY m.video_id, game_no ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE a AND b AND c AND event_id % 2 = 0 GROUP BY video_id, game_no""", "v_games"))
def jump_hint(spark, d):
    e = F.col("event_id")
    held = intervals.frames_in_games(V.markers(spark, d), games_of(spark, d), 86400.0)
    readings = held.select("video_id", "game_no", "t", F.when(e % 2 == 0, F.col("t") - 100).alias("estimate"), F.when(F.col("cls") == "playing", "m").alias("map"), F.when(e % 3 == 0, "o").alias("orange"), F.when(e % 3 == 1, "b").alias("blue"))
    return segments.jump_hints(readings).select("video_id", "game_no", "t", "estimate")
