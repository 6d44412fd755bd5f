import random

import pytest
from pyspark.sql import functions as F

from tapeline.functions import predicates as P
from tapeline.functions import scalars as C
from tapeline.operators import intervals, pixels, resolve, segments, telemetry
from tapeline.sources import logs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    for s, want in ((0.0, "00:00"), (59.5, "00:60"), (3599.4, "59:59"), (3600.0, "1:00:00"), (36000.0, "10:00:00")):
        assert value(spark, C.read_time(F.lit(s))) == want
    for text, want in (("", "0"), ("87x", "87"), ("1000", "100"), ("-5", "0"), ("x9", "0")):
        assert value(spark, C.score_check(F.lit(text))) == want
    for clock, want in (("7:30", -45), ("10:00", None), ("7", None), ("9:58", 103)):
        assert value(spark, C.clock_start_estimate(F.lit(100), F.lit(clock))) == want
    for a, b, want in (("1.10", "1.9", 1), ("1.2", "1.2.0", 0), ("1.x", "1.0", 0)):
        assert value(spark, C.version_diff(F.lit(a), F.lit(b))) == want
    assert value(spark, C.canonical_video_url(F.lit("y.com/watch?v=a%20b&t=1"))).endswith("?v=a b")
    assert value(spark, C.canonical_video_url(F.lit("https://y.com/watch?v="))) == "https://y.com/watch?v="
    assert value(spark, C.nfc(F.lit("é"))) == "é"
    assert value(spark, C.download_percent(F.lit("100%"))) is None


def test_predicates(spark):
    near = lambda d: value(spark, P.color_similar((F.lit(0),) * 3, (F.lit(d),) * 3))
    assert near(20) and not near(21)
    for text, want in (("ab1#22", True), ("ab1#22\n", False), ("a_b#1", False), ("", False)):
        assert value(spark, P.is_player_tag(F.lit(text))) is want


def fold(marks):
    """The backward scan, one frame at a time."""
    games, current = [], None
    for t, m in sorted(marks, reverse=True):
        if m == "end" and current is None:
            current = t
        elif m == "loading" and current is not None:
            games.append((t + 2, current))
            current = None
    return games + ([(None, current)] if current is not None else [])


def test_segments_match_the_fold(spark):
    rng = random.Random(3)
    videos = {str(v): [(t, rng.choice(["end", "loading", "playing"])) for t in rng.sample(range(1, 40), rng.randint(0, 12))] for v in range(60)}
    df = spark.createDataFrame([(v, float(t), m) for v, ms in videos.items() for t, m in ms], "video_id string, t double, cls string")
    got = {v: [] for v in videos}
    for r in segments.segment_games(df).orderBy("game_no").collect():
        got[r["video_id"]].append((r["start_s"], r["end_s"]))
    assert got == {v: fold([x for x in ms if x[1] != "playing"]) for v, ms in videos.items()}


def test_names_match_the_fold(spark):
    cases = [(["bob", "bob"], ["bob", "rob"], ["bob", "rob"]), (["a", "b"], ["a"], ["a", "b"]), (["x"], [], ["x"])]
    df = spark.createDataFrame([(a, b, c) for a, b, c in cases], "readings array<string>, roster array<string>, want array<string>")
    for r in df.select("want", resolve.resolved_names(F.col("readings"), F.col("roster")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_consensus(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("baba")] + [(2, 0, ""), (2, 1, "")] + [(3, 0, ""), (3, 1, ""), (3, 2, "7")], "k int, pos int, text string")
    plain = {r["k"]: r["text"] for r in resolve.consensus(df, ["k"]).collect()}
    checked = {r["k"]: r["text"] for r in resolve.consensus(df, ["k"], checker=C.score_check).collect()}
    assert plain == {1: "b", 2: "", 3: "7"} and checked[3] == "0"


def test_retime(spark):
    chunks = spark.createDataFrame([("v", 0.0, 10.0, False), ("v", 10.0, 20.0, True), ("v", 20.0, 30.0, False)], "video_id string, start double, end double, remove boolean")
    events = spark.createDataFrame([("v", 25.0), ("v", 12.0), ("v", 30.0)], "video_id string, t double")
    assert [(r["t"], r["new_t"]) for r in intervals.retime(events, chunks, width=7.0).collect()] == [(25.0, 15.0)]


def test_runs(spark):
    hot = {y for a, n in ((2, 6), (20, 7), (40, 15), (70, 16), (95, 10)) for y in range(a, a + n)}
    lines = spark.createDataFrame([(1, y, y in hot) for y in range(105)], "frame_id int, y int, hot boolean")
    assert sorted(r["height"] for r in pixels.text_runs(lines).collect()) == [7, 15]


def test_numbers_over_many_partitions(spark):
    n = 3_000_000
    df = spark.range(n).select((F.col("id") * 1000003 % n).alias("seq"), F.md5(F.col("id").cast("string")).alias("message"))
    # the largest message is asked for, so that messages are shuffled along
    got = logs.number_rows(df, ["seq"]).agg(F.count("*"), F.sum((F.col("n") == F.col("seq") + 1).cast("long")), F.max("message")).first()
    assert tuple(got)[:2] == (n, n)


def test_numbers_in_groups(spark):
    """Groups over several partitions, a null group, ties, and no rows."""
    key = lambda i: F.when(i % 10 < 8, "hot").when(i % 10 == 8, F.concat(F.lit("k"), (i % 70).cast("string")))
    df = spark.range(20_000).select(key(F.col("id")).alias("k"), F.floor(F.col("id") / 3).alias("seq"), "id")
    got = logs.number_rows(df, ["seq", "id"], "n", ["k"], "total").toPandas()
    for _, g in got.groupby("k", dropna=False):
        g = g.sort_values(["seq", "id"])
        assert g["n"].tolist() == list(range(1, len(g) + 1)) and set(g["total"]) == {len(g)}
    assert len(got) == 20_000 and got["k"].isna().sum() == 2000
    assert logs.number_rows(df.limit(0), ["seq"], by=["k"]).collect() == []


def test_plan_of_numbers_does_not_grow(spark):
    size = lambda p: len(logs.number_rows(spark.range(0, 4000, 1, p).withColumnRenamed("id", "seq"), ["seq"])._jdf.queryExecution().optimizedPlan().toString())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        sizes = []
        for p in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            sizes.append(size(p))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(sizes[0] - sizes[1]) < 50


def test_monotone(spark):
    df = spark.createDataFrame([("j", i, v) for i, v in enumerate([0, 5, 5, 3, 7])], "job_id string, seq long, value long")
    assert [r["value"] for r in telemetry.monotone_progress(df).orderBy("seq").collect()] == [5, 7]


@pytest.mark.parametrize("values,want", [([], []), ([0.0, 60.0, 10.0, 10.0, 70.0], [(0.0, 10.0), (10.0, 50.0)])])
def test_split(spark, values, want):
    cuts = spark.createDataFrame([("v", v) for v in values], "video_id string, t double")
    lengths = spark.createDataFrame([("v", 50.0)] if values else [], "video_id string, duration double")
    assert [(r["start"], r["end"]) for r in intervals.split_at_cuts(lengths, cuts).orderBy("chunk_no").collect()] == want
