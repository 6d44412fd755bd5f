import random
import re

from pyspark.sql import functions as F

from tapeline.operators import intervals, matching, resolve
from tapeline.sources import exports, history, logs


def test_intervals_of_very_different_length(spark):
    rng = random.Random(4)
    own = [(rng.choice("ab"), i, s, s + rng.choice([0.0, 0.25, 3, 700, 10**6, 10**9])) for i in range(300) for s in [rng.uniform(-50, 5000)]]
    own += [("a", 900, None, 5.0), ("a", 901, 5.0, None), ("a", 902, 9.0, 1.0)]
    points = [(rng.choice("abc"), i, rng.choice([rng.uniform(-100, 10**4), s])) for i, (_, _, s, _) in enumerate(own[:300])]
    df = intervals.interval_join(spark.createDataFrame(points, "k string, p int, t double"), spark.createDataFrame(own, "k string, i int, start double, end double"), "k", "t", "start", "end", 1.0)
    want = sorted((p, i) for k, p, t in points for key, i, s, e in own if k == key and s is not None and e is not None and s <= t < e)
    assert sorted((r["p"], r["i"]) for r in df.select("p", "i").collect()) == want and len(want) > 5000
    assert df.columns == ["k", "p", "t", "i", "start", "end"]


def test_a_long_interval_has_two_copies(spark):
    """The plan's join gets two rows at most of an interval of any length."""
    long = spark.createDataFrame([("a", 0.5, 10.0**12)], "k string, start double, end double")
    joined = intervals.interval_join(spark.createDataFrame([("a", 7.0)], "k string, t double"), long, "k", "t", "start", "end", 1.0)
    assert joined.count() == 1
    assert not re.search("NestedLoop|Cartesian", joined._jdf.queryExecution().executedPlan().toString())
    assert intervals.interval_join(spark.createDataFrame([("a", 7.0)], "k string, t double"), long.limit(0), "k", "t", "start", "end", 1.0).collect() == []


def test_as_of_over_slices(spark):
    """Nearest values from the own slice, from a slice far away, from none; null keys, ties of a request and a row."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), float(t), t * 10) for t in rng.sample(range(3000), 60)] + [("a", 5.0, None)]
    asked = [(rng.choice(["a", "b", None, "none"]), i, float(rng.choice([rng.randrange(-50, 3100), rng.choice(rows)[1]]))) for i in range(200)]
    r, q = spark.createDataFrame(rows, "k string, t double, v long"), spark.createDataFrame(asked, "k string, id int, t double")
    for forward in (True, False):
        want = {}
        for k, i, t in asked:
            near = [(x, v) for key, x, v in rows if key == k and v is not None and (x >= t if forward else x <= t)]
            want[i] = (min if forward else max)(near)[1] if near else None
        for width in (7.0, 10.0**6):
            got = intervals.as_of(q, r, "k", "t", "v", forward, width)
            assert got.columns == ["k", "id", "t", "found_v"] and {x["id"]: x["found_v"] for x in got.collect()} == want


def test_a_hot_key_of_as_of_is_split(spark):
    """One video with all rows: no task of the window gets more than a few slices."""
    rows = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("t"), F.col("id").alias("v"))
    asked = spark.range(0, 100_000, 10).select(F.lit("hot").alias("k"), F.col("id").alias("id"), (F.col("id") + 0.5).alias("t"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.as_of(asked, rows, "k", "t", "v", True, 1000.0).withColumn("p", F.spark_partition_id())
        dealt = [r["count"] for r in got.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(dealt) > 2 and max(dealt) < 6000
    assert got.where("found_v <> id + 1 and id < 99999").count() == 0


def test_candidates_without_pairs(spark):
    key = [F.lit("m").alias("map"), (F.col("id") % 2).alias("orange_score"), F.lit(1).alias("blue_score")]
    games, stats = spark.range(500).select(F.col("id").alias("game_id"), *key), spark.range(3, 400).select("id", *key)
    every = matching.attach_candidates(games, stats).groupBy("game_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    columns = ["game_id", "n", "first_id"]
    assert sorted(map(tuple, matching.candidate_counts(games, stats).select(columns).collect())) == sorted(map(tuple, every.select(columns).collect()))
    best = matching.best_candidates(games, stats, [F.col("id").desc()], 2).where("game_id = 6").orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in best] == [(398, 1), (396, 2)]
    assert matching.candidate_counts(games, stats.limit(0)).collect() == []


def test_maps_inside_texts_and_by_join(spark, monkeypatch):
    maps = spark.createDataFrame([(2, "B", ["x", "y"]), (1, "A", ["y z", "w", None]), (3, "C", []), (4, "D", None), (5, "E", ["éé"])], "map_order int, name string, tokens array<string>")
    texts = ["x", "w x", "X\nW", "y  z", "", None, "no", "éÉ", "a\r\nx b", "x" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    inside = resolve.map_from_text(df, maps)
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    want = ["B", "A", "", "B", "", "", "", "E", "", ""]
    assert [r["map"] for r in inside.orderBy("id").collect()] == want
    monkeypatch.setattr(resolve, "SMALL_TOKENS", 1)
    joined = resolve.map_from_text(df, maps)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and [r["map"] for r in joined.orderBy("id").collect()] == want
    assert resolve.map_from_text(df, maps.limit(0)).where("map <> ''").count() == 0


def test_report_is_read_back(spark, tmp_path):
    """Head, entries in order, over several files."""
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("seq"), F.lit("info").alias("level"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("ui").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs.write_report(logs.export_logs(rows, "Console", "now"), str(tmp_path / "report"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "report").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[:4] == ["Console", "Generated at: now", "Total logs: 4000", "=" * 80]
    assert lines[4:7] == ["[1] <1970-01-01T00:00:00.000Z> [INFO] [ui]", "m0", "-" * 40] and lines[-2] == "m3999"
    assert [int(x[1 : x.index("]")]) for x in lines[4::3]] == list(range(1, 4001)) and len(files) > 1


def test_wide_sheet_is_read_back(spark, tmp_path):
    """Games with players, without any, and with more than a side has room for."""
    player = lambda n, t: ((n, t, 1, 2, 3, 4, 5.5, 0.5),)
    team = ((1, ("A", 3), ("B", 4)),)
    nodes = [(1, 1, k, "2024-01-02T03:04:05Z", ("m",), ("x",), team[0], players) for k, players in enumerate([[player("p", "A"), player("q", "B")], [], None, [player(f"n{i}", "A") for i in range(7)]])]
    schema = "season int, page int, pos int, " + history.NODE.removeprefix("struct<").removesuffix(">")
    games = history.game_teams(spark.createDataFrame(nodes, schema))
    history.write_wide(games, str(tmp_path / "sheet"))
    got = spark.read.option("header", True).csv(str(tmp_path / "sheet")).collect()
    assert len(got[0]) == 79 and sorted(int(r["n_players"]) for r in got) == [0, 0, 2, 7]
    two = next(r for r in got if r["n_players"] == "2")
    assert (two["orange_1_name"], two["blue_1_name"], two["orange_2_name"], two["readable_duration"], two["hour"]) == ("p", "q", None, "0m1s", "03:04")
    assert sum(r["n_dropped"] for r in history.export_wide(games).collect()) == 2


def test_manifest_is_read_back(spark, tmp_path):
    games = spark.createDataFrame([(f"v{i % 3}", float(i), float(i + 9), "O", "B", "M", i != 4) for i in range(6)], "video_id string, start_s double, end_s double, orange string, blue string, map string, selected boolean")
    exports.write_manifest(exports.cut_manifest(games, "f", "a.MP4", "P"), str(tmp_path / "cuts"))
    got = spark.read.parquet(str(tmp_path / "cuts")).orderBy("start").collect()
    assert [(r["video_id"], r["start"], r["length"]) for r in got] == [(f"v{i % 3}", float(i), 9.0) for i in (0, 1, 2, 3, 5)]
    assert got[1]["name"] == "P - O vs B - M - f (00:01).mp4"
