import datetime as dt
import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tapeline.operators import segments
from tapeline.plans import stream_queries
from tapeline.plans.queries import FOUND
from tapeline.sources.shared import shared_folder
from tapeline.streaming import stateful, streams
from tests.conftest import SF


def replay(spark, rows, schema, make, tmp_path, mode="append", parts=3):
    """Feeds rows in parts through a stream made by ``make`` and returns what came out."""
    source = tmp_path / "in"
    source.mkdir()
    name = f"out{abs(hash(str(tmp_path)))}"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(source))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = make(frame).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_monotone_and_gauge(spark, tmp_path):
    rows = [("j", i, float(v)) for i, v in enumerate([0, 5, 5, 3, 7])]
    (tmp_path / "a").mkdir()
    got = replay(spark, rows, "job_id string, seq long, value double", streams.stream_monotone_progress, tmp_path / "a", parts=1)
    assert [r["value"] for r in got] == [5.0, 7.0]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=i), float(v)) for i, v in enumerate([1, 1, 2, 2, 1])]
    (tmp_path / "b").mkdir()
    got = replay(spark, rows, "user_id long, ts timestamp, value double", streams.stream_gauge_changes, tmp_path / "b", parts=1)
    assert [r["value"] for r in got] == [2.0, 1.0]


def test_tail(spark, tmp_path):
    rows = [("ui", "log", i, f"m{i}") for i in range(9)]
    got = replay(spark, rows, "source string, level string, seq long, message string", lambda f: streams.stream_last_n_logs(f, 3), tmp_path, "update")
    assert [r["seq"] for r in got[-3:]] == [6, 7, 8]


MARKS = "video_id string, ts timestamp, t double, cls string, mode int"


def marks(*rows):
    t0 = dt.datetime(2024, 1, 1)
    return [(v, t0 + dt.timedelta(seconds=t), float(t), c, 0) for v, t, c in rows]


def played(spark, tmp_path, batches, delay="10 seconds", idle_ms=100_000):
    """Games that come out of batches of markers, and how many rows Spark dropped as late."""
    source = tmp_path / "in"
    source.mkdir()
    name = f"games{abs(hash(str(tmp_path)))}"
    made = streams.stream_segments(spark.readStream.schema(MARKS).parquet(str(source)), delay, idle_ms)
    q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    late = 0
    try:
        for batch in batches:
            spark.createDataFrame(marks(*batch), MARKS).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    finally:
        q.stop()
    return sorted(((r["video_id"], r["mode"], r["start_s"], r["end_s"]) for r in spark.table(name).collect()), key=lambda g: (g[0], g[3])), late


def test_segments_out_of_order_equal_batch(spark, tmp_path):
    own = [("v", 5, "loading"), ("v", 20, "end"), ("v", 30, "end"), ("v", 40, "loading"), ("v", 45, "loading"), ("v", 50, "score"), ("v", 50, "end"), ("v", 60, "loading"), ("w", 7, "score"), ("w", 9, "intro"), ("w", 55, "end")]
    mixed = [own[3], own[0], own[8], own[2]], [own[9], own[5], own[1]], [own[7], own[4], own[10], own[6]]
    got, late = played(spark, tmp_path, [*mixed, [("z", 9999, "loading")]], "1 minute")
    want = segments.segment_games(spark.createDataFrame(marks(*own), MARKS)).collect()
    assert got == sorted(((r["video_id"], r["mode"], r["start_s"], r["end_s"]) for r in want), key=lambda g: (g[0], g[3])) and len(got) == 4 and late == 0


def test_late_markers_are_dropped_and_counted(spark, tmp_path):
    first, second = [("v", 5, "loading"), ("v", 20, "end"), ("v", 100, "loading")], [("v", 30, "end"), ("v", 120, "score"), ("v", 130, "loading")]
    got, late = played(spark, tmp_path, [first, second, [("z", 9999, "loading")]])
    assert late == 1 and got == [("v", 1, 7.0, 20.0), ("v", 0, 102.0, 120.0)]


def test_idle_videos_close(spark, tmp_path):
    got, _ = played(spark, tmp_path, [[("v", 5, "loading"), ("v", 20, "end")], [("w", 60, "loading")]])
    assert got == []
    (tmp_path / "b").mkdir()
    got, _ = played(spark, tmp_path / "b", [[("v", 5, "loading"), ("v", 20, "end")], [("w", 400, "loading")], [("v", 500, "end"), ("z", 9999, "intro")]])
    # what comes after the video closed starts anew, so the start of the second game isn't known
    assert got == [("v", 1, 7.0, 20.0), ("v", 1, None, 500.0)]


def test_state_lasts_over_batches(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rows = [("j", i, float(v)) for i, v in enumerate([0, 5, 5, 3, 7, 6, 7, 9])]
    halves = [rows[:3], rows[3:6], rows[6:]]
    got = in_turn(spark, tmp_path / "a", halves, "job_id string, seq long, value double", streams.stream_monotone_progress)
    assert sorted(r["value"] for r in got) == [5.0, 7.0, 9.0]
    (tmp_path / "b").mkdir()
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=i), float(v)) for i, v in enumerate([1, 1, 2, 2, 1, 1])]
    got = in_turn(spark, tmp_path / "b", [rows[:2], rows[2:3], rows[3:]], "user_id long, ts timestamp, value double", streams.stream_gauge_changes)
    assert [r["value"] for r in got] == [2.0, 1.0]


def in_turn(spark, tmp_path, batches, schema, make):
    frames = [spark.createDataFrame(b, schema) for b in batches]
    return stream_queries.replayed(spark, frames, make).orderBy("value" if "job_id" in schema else "ts").collect()


def test_history_stream(spark, tmp_path):
    player = lambda n, t: {"data": {"niceName": n, "team": t, "kills": 1}}
    node = {"createdAt": "2024-01-02T03:04:05Z", "mode": {"identifier": "m"}, "map": {"name": "x"}, "data": {"duration": 65, "teamOne": {"name": "A", "score": 1}, "teamTwo": {"name": "A", "score": 2}}, "players": [player("p", "A"), player("q", "Z")]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.json").write_text(json.dumps({"season": 1, "page": 1, "data": {"gameHistories": {"nodes": [node]}}}) + "\n" + json.dumps({"season": 1, "page": 2, "data": {}}))
    q = streams.stream_history(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    q.awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(r) == 1 and [p["name"] for p in r[0]["orange"]] == ["p"] and r[0]["blue"] == [] and r[0]["hour"] == "03:04"


def page(number, *names, last=None):
    node = {"map": {"name": "x"}, "data": {"duration": 65, "teamOne": {"name": "A", "score": 1}, "teamTwo": {"name": "B", "score": 2}}, "players": []}
    return json.dumps({"season": 1, "page": number, "last": last, "data": {"gameHistories": {"nodes": [node | {"map": {"name": n}} for n in names]}}})


def taken(spark, tmp_path, parts, **options):
    """Maps of the games that parts of pages give, each part a run of its own."""
    (tmp_path / "in").mkdir()
    done = []
    for i, pages in enumerate(parts):
        (tmp_path / f"in/{i}.json").write_text("\n".join(pages))
        streams.stream_history(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1, **options).awaitTermination(120)
        done.append(streams.history_is_done(spark, str(tmp_path / "out"), options.get("n_pages", 20)))
    return sorted(r["map"] for r in spark.read.parquet(str(tmp_path / "out")).collect()), done


def test_pages_that_arrive_again_count_once(spark, tmp_path):
    got, done = taken(spark, tmp_path, [[page(1, "a", "b"), page(1, "a", "b")], [page(2, "c"), page(1, "a", "b")], [page(2, "c"), page(3)]])
    assert got == ["a", "b", "c"] and done == [False] * 3


def test_history_stops_after_n_pages(spark, tmp_path):
    """Pages of a batch count in order; empty pages count too."""
    got, done = taken(spark, tmp_path, [[page(4, "d"), page(2)], [page(5, "e"), page(2), page(3, "c")], [page(1, "a")]], n_pages=3, skip=1, first_page=1)
    assert got == ["c", "d"] and done == [False, True, True]


def test_history_stops_at_the_last_page(spark, tmp_path):
    got, done = taken(spark, tmp_path, [[page(1, "a")], [page(4, "d"), page(2, "b", last=True), page(3, "c")], [page(5, "e")]])
    assert got == ["a", "b"] and done == [False, True, True]


def test_typed_state_agrees_with_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    logs = [(f"s{rng.integers(3)}", f"l{rng.integers(2)}", int(i), None if i % 17 == 0 else f"m{i}") for i in rng.permutation(300)]
    gauge = [(int(rng.integers(5)), t0 + dt.timedelta(seconds=i), float(rng.integers(3))) for i in range(200)]
    steps = [(f"j{rng.integers(4)}", i, float(rng.integers(100))) for i in range(200)]
    cases = [
        (logs, "source string, level string, seq long, message string", lambda f: stateful.last_n_logs(f, 7), lambda f: streams.stream_last_n_logs(f, 7), ["source", "level"]),
        (gauge, "user_id long, ts timestamp, value double", stateful.gauge_changes, streams.stream_gauge_changes, None),
        (steps, "job_id string, seq long, value double", stateful.monotone_progress, streams.stream_monotone_progress, None),
    ]
    for rows, schema, typed, grouped, latest in cases:
        parts = [spark.createDataFrame(rows[at : at + 70], schema) for at in range(0, len(rows), 70)]
        got, want = ([tuple(r) for r in stream_queries.replayed(spark, parts, make, latest).collect()] for make in (typed, grouped))
        assert sorted(got, key=str) == sorted(want, key=str) and got


def test_partitions_send_on_n_rows_of_a_key(spark):
    logs = spark.range(0, 10_000, 1, 5).select(F.lit("ui").alias("source"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("level"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("message"))
    sent = {r["level"]: r["count"] for r in stateful.last_of_partitions(logs, 30).groupBy("level").count().collect()}
    assert sent == {"hot": 150, "rare": 100}
    assert stateful.last_of_partitions(logs.limit(0), 3).collect() == []


def test_idle_keys_of_typed_logs_start_anew(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s, source, seq: (source, "log", seq, f"m{seq}", t0 + dt.timedelta(seconds=s))
    batches = [[at(0, "a", 1)], [at(10, "a", 2), at(10, "b", 3)], [at(500, "b", 4)], [at(510, "b", 5)], [at(600, "a", 6)]]
    schema = "source string, level string, seq long, message string, ts timestamp"
    (tmp_path / "in").mkdir()
    make = stateful.last_n_logs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, idle_ms=100_000, delay="10 seconds")
    q = make.writeStream.outputMode("update").format("memory").queryName("idle_logs").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
    finally:
        q.stop()
    rows = [tuple(r) for r in spark.table("idle_logs").collect()]
    assert [r[2] for r in rows if r[0] == "a"] == [1, 1, 2, 6]


def test_kill_lines(spark):
    image = np.zeros((60, 40, 3), np.uint8)
    image[10:20, 30] = 255
    image[10:20, 31] = (255, 0, 0)
    image[50:60, 30:32] = image[10:20, 30:32]
    df = spark.createDataFrame([("v", 1.0, 40, 60, image.tobytes())], "video_id string, t double, width int, height int, rgb binary")
    palette = [("white", (255, 255, 255)), ("orange", (255, 128, 0)), ("blue", (0, 0, 255)), ("red", (255, 0, 0))]
    assert [(r["y"], r["height"]) for r in streams.stream_kill_lines(df, palette, (20, 60)).collect()] == [(10, 10)]


def test_pages_are_written_compressed_and_taken_without_a_join(spark, monkeypatch):
    """What the history queries write for their readers is compressed; the pages of a batch are cut by number."""
    joins = []
    monkeypatch.setattr(DataFrame, "join", lambda self, *a, real=DataFrame.join, **k: joins.append(sys._getframe(1).f_code.co_name) or real(self, *a, **k))
    before = set(Path(shared_folder(spark)).glob("*"))
    for name in ("history_pages", "stream_history"):
        assert FOUND[name](spark, SF).count() > 0
    new = [p for folder in set(Path(shared_folder(spark)).glob("*")) - before for p in [*folder.glob("part-*"), *folder.glob("in/part-*")]]
    assert len(new) > 3 and all(p.name.endswith(".txt.gz") for p in new)
    assert "order_games" in joins and "take" not in joins


def test_pages_of_a_batch_are_not_held(spark, tmp_path, monkeypatch):
    """A batch's pages are written as flat games and not kept in memory; empty pages and an empty last page are known from these."""
    held = []
    for name in ("persist", "cache", "checkpoint", "localCheckpoint"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, real=getattr(DataFrame, name), **k: held.append(sys._getframe(1).f_code.co_name) or real(self, *a, **k))
    got, done = taken(spark, tmp_path, [[page(1, "a", "b"), page(2), page(1, "a", "b")], [page(4, "d"), page(3, last=True), page(2)]])
    assert held == [] and got == ["a", "b"] and done == [False, True]
    pages = streams.taken_pages(spark, str(tmp_path / "out")).collect()
    assert sorted((r["page"], r["last"]) for r in pages) == [(1, False), (2, False), (3, True)]
    games = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["page"], r["pos"], r["map"]) for r in games) == [(1, 0, "a"), (1, 1, "b")] and "last" not in games[0]


def test_many_videos_share_a_state_row(spark, tmp_path):
    """Markers of 90 videos out of order, in 4 rows of state at most, give the games of the batch form."""
    rng = np.random.default_rng(5)
    own = marks(*((f"v{rng.integers(90)}", int(t), str(rng.choice(["loading", "intro", "score", "end", "playing"]))) for t in rng.permutation(np.arange(1, 900))))
    (tmp_path / "in").mkdir()
    made = streams.stream_segments(spark.readStream.schema(MARKS).parquet(str(tmp_path / "in")), "1 hour", 100_000_000, buckets=4)
    q = made.writeStream.format("memory").queryName("shared").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for batch in (own[:300], own[300:600], own[600:], marks(("z", 999_999, "loading"))):
            spark.createDataFrame(batch, MARKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    finally:
        q.stop()
    columns = ("video_id", "mode", "start_s", "end_s")
    got, want = (sorted((tuple(r[c] for c in columns) for r in rows), key=str) for rows in (spark.table("shared").collect(), segments.segment_games(spark.createDataFrame(own, MARKS)).collect()))
    assert got == want and len(got) > 90 and 0 < max(states) <= 4
