import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import frames, pixels
from tapeline.plans.frame_queries import SPEC
from tapeline.streaming import streams

SCHEMA = "video_id string, t double, width int, height int, rgb binary"
COLORS = [(255, 255, 255), (255, 215, 0), (0, 0, 255), (255, 0, 0), (200, 200, 200), (0, 0, 0), (240, 200, 220), (90, 20, 30)]


def drawn(seed):
    """A frame of 60 x 40 made of bars and noise in colours that the operators look for."""
    rng = np.random.default_rng(seed)
    image = np.array(COLORS, np.uint8)[rng.integers(0, len(COLORS), (40, 60)) if seed % 3 == 0 else np.full((40, 60), 5)]
    for _ in range(rng.integers(0, 14)):
        y, x = rng.integers(0, 40), rng.integers(0, 60)
        image[y : y + rng.integers(1, 9), x : x + rng.integers(1, 60)] = COLORS[rng.integers(0, len(COLORS))]
    if seed % 4 == 0:
        image[::5, 28:33] = (255, 215, 215)
        image[:, 3:9] = (200, 180, 190)
    return image


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("v", float(i), 60, 40, bytearray(drawn(i).tobytes())) for i in range(60)], SCHEMA).cache()


def test_features_equal_the_row_forms(spark, table):
    got = {r["t"]: r for r in frames.frame_features(table, SPEC).collect()}
    rows = frames.frame_pixels(table).withColumn("frame_id", F.col("t")).cache()
    by = lambda df: {r["frame_id"]: r for r in df.collect()}
    mean, white = by(pixels.mean_color(rows)), by(pixels.black_and_white(rows, SPEC.threshold).groupBy("frame_id").agg(F.count_if(F.col("v") == 255).alias("n")))
    box = by(pixels.bright_bbox(rows, 50, 30, 100))
    panel = by(pixels.panel_bbox(rows, (255, 215, 215), 30, 60, 40, True, 155, 200))
    lines = pixels.line_color_counts(rows, SPEC.lines.palette, 80).select("frame_id", "y", pixels.hot_line(*map(F.col, ("white", "orange", "blue", "red"))).alias("hot"))
    runs = {}
    for r in pixels.text_runs(lines, 5, 4).orderBy("y").collect():
        runs.setdefault(r["frame_id"], []).append((r["y"], r["height"]))
    probes = spark.createDataFrame([(c, t, m, k, x, y, r, g, b, tol) for k, (c, t, m, x, y, r, g, b, tol) in enumerate(SPEC.probes)], "class string, template string, mode int, probe int, x int, y int, r int, g int, b int, tol int")
    modes = {}
    for r in pixels.match_templates(rows, probes, ("class",)).collect():
        modes.setdefault(r["frame_id"], {})[r["class"]] = r["mode"]
    slots = spark.createDataFrame([(s, k, x, y) for k, (s, x, y) in enumerate(SPEC.slots)], "side string, slot int, x int, y int")
    playing = by(pixels.playing_frame(rows, slots, SPEC.sides, 90, 250))
    assert len(got) == 60
    for t, r in got.items():
        assert r["ok"] and tuple(r["mean"]) == tuple(mean[t])[1:] and r["n_white"] == white[t]["n"]
        assert tuple(r["box"]) == tuple(box[t])[1:] and tuple(r["panel"]) == tuple(panel[t])[1:]
        assert [tuple(x) for x in r["runs"]] == runs.get(t, []) and r["modes"] == modes.get(t, {}) and r["playing"] == playing[t]["playing"]
    # every branch is met
    assert len({tuple(r["panel"]) for r in got.values()}) > 8 and len({tuple(r["box"]) for r in got.values()}) > 8 and len(runs) > 8 and len({r["playing"] for r in got.values()}) == 2 and len(modes) > 8


def test_black_and_white_bytes(table):
    for r in frames.black_and_white_frames(table, 127.3).where("t < 5").collect():
        v = drawn(int(r["t"])).astype(float) @ np.array([0.299, 0.587, 0.114])
        assert (np.frombuffer(r["bw"], np.uint8).reshape(40, 60) == np.where(v > 127.3, 255, 0)).all()


def test_templates_take_the_lowest_mode_and_all_probes():
    image = np.zeros((4, 4, 3), np.uint8)
    image[1, 1] = 200
    at = lambda name, template, mode, x, v: (name, template, mode, x, 1, v, v, v, 10)
    probes = [at("a", "p", 3, 1, 200), at("a", "q", 1, 1, 205), at("a", "q", 1, 2, 200), at("a", "r", 2, 1, 190), at("b", "p", 0, 9, 200)]
    assert frames.lowest_modes(image, probes) == {"a": 2}


def test_damaged_frames(spark, table):
    whole = bytearray(drawn(4).tobytes())
    odd = [("v", 0.0, 60, 40, None), ("v", 1.0, 60, 40, bytearray(5)), ("v", 2.0, None, 40, whole), ("v", 3.0, 0, 0, bytearray()), ("v", 4.0, 60, 40, whole), (None, None, 60, 40, whole + bytearray(9)), ("v", 6.0, -60, -40, whole)]
    df = spark.createDataFrame(odd, SCHEMA)
    got = frames.frame_features(df, SPEC).collect()
    assert [r["ok"] for r in got] == [False] * 4 + [True, True, False]
    assert all(r["mean"] is None and r["runs"] is None and r["modes"] is None for r in got if not r["ok"])
    assert frames.frame_features(df, frames.Spec()).where("ok and mean is not null and box is null and panel is null and runs is null").count() == 2
    assert frames.frame_features(df.limit(0), SPEC).collect() == [] and frames.frame_pixels(df).count() == 2 * 2400
    assert df.select(F.count_if(frames.whole_frame())).first()[0] == 2


def test_one_pass_without_a_shuffle(table):
    plan = frames.frame_features(table, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_kill_lines_skip_and_count_damaged_frames(spark, tmp_path):
    rows = [("v", float(i), 60, 40, bytearray(drawn(i).tobytes())) for i in range(9)] + [("w", 0.0, 60, 40, None), ("w", 1.0, 60, 40, bytearray(7))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    make = lambda f: streams.stream_kill_lines(f, SPEC.lines.palette, (60, 40), 80, 5, 4)
    q = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("kills").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [p["observedMetrics"]["damaged_frames"]["n"] for p in q.recentProgress if p["numInputRows"]] == [2]
    got = sorted((r["t"], r["y"], r["height"]) for r in spark.table("kills").collect())
    want = sorted((float(i), line["y"], line["height"]) for i in range(9) for line in frames.text_lines(drawn(i), SPEC.lines))
    assert got == want and want


def cropped(spark, regions, schema, points, n_frames=3):
    px = spark.createDataFrame([(f, x, y, 1) for f in range(n_frames) for x, y in points], "frame_id long, x int, y int, v int")
    df = pixels.crop_regions(px, spark.createDataFrame(regions, schema))
    return df, sorted((r["region"], r["frame_id"], r["x"], r["y"]) for r in df.collect())


def test_crop_against_every_pair(spark):
    rng = random.Random(6)
    points = [(rng.randrange(2000), rng.randrange(1100)) for _ in range(400)] + [(63, 64), (64, 63), (128, 0), (0, 0)]
    boxes = [(f"r{i}", *(float(v) for v in (a, b, a + rng.choice([0.5, 1, 64, 200, 5000]), b + rng.choice([1, 63.5, 400, 10**7])))) for i in range(60) for a, b in [(rng.randrange(-50, 1900), rng.randrange(-50, 1000))]]
    boxes += [("empty", 5.0, 5.0, 5.0, 9.0), ("turned", 9.0, 9.0, 5.0, 5.0), ("null", None, 0.0, 9.0, 9.0)]
    inside = lambda b, x, y: None not in b and b[1] <= x < b[3] and b[2] <= y < b[4]
    want = sorted((b[0], f, x - b[1], y - b[2]) for b in boxes for f in range(3) for x, y in points if inside(b, x, y))
    _, got = cropped(spark, boxes, "region string, x1 double, y1 double, x2 double, y2 double", points)
    assert got == want and len(want) > 1000
    own = [(*b, i % 4) for i, b in enumerate(boxes)]
    want = sorted((b[0], b[5], x - b[1], y - b[2]) for b in own for x, y in points if b[5] < 3 and inside(b, x, y))
    _, got = cropped(spark, own, "region string, x1 double, y1 double, x2 double, y2 double, frame_id long", points)
    assert got == want
    assert cropped(spark, [], "region string, x1 double, y1 double, x2 double, y2 double", points)[1] == []


def test_crop_never_loops(spark, monkeypatch):
    """Few regions are sent everywhere, many are dealt out with the pixels, by cell and by frame or part of the frames."""
    points, boxes = [(x, y) for x in range(0, 200, 9) for y in range(0, 200, 9)], [(f"r{i}", i % 90, i % 80, i % 90 + 30, i % 80 + 20) for i in range(300)]
    few, want = cropped(spark, boxes, "region string, x1 int, y1 int, x2 int, y2 int", points)
    monkeypatch.setattr("tapeline.sources.shared.SMALL", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many, got = cropped(spark, boxes, "region string, x1 int, y1 int, x2 int, y2 int", points)
        by_frame, _ = cropped(spark, [(*b, 1) for b in boxes], "region string, x1 int, y1 int, x2 int, y2 int, frame_id long", points)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many, by_frame)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and want
    assert not any(re.search("NestedLoop|Cartesian", p) for p in plans)
    assert "BroadcastHashJoin" in plans[0] and re.search(r"hashpartitioning\(_level#\d+, _cx#\w+, _cy#\w+, _part#\w+", plans[1]) and re.search(r"hashpartitioning\(frame_id#\w+, _level", plans[2])


def test_many_regions_at_full_size(spark):
    """150,000 regions for all frames are more than are sent everywhere."""
    spread = spark.range(150_000).select(F.col("id").cast("string").alias("region"), *((F.col("id") * k % m).alias(c) for c, k, m in (("x1", 7, 1800), ("y1", 11, 1000))))
    regions = spread.select("*", (F.col("x1") + 8).alias("x2"), (F.col("y1") + 8).alias("y2"))
    px = spark.range(2000).select(F.lit(1).alias("frame_id"), (F.col("id") * 13 % 1920).alias("x"), (F.col("id") * 17 % 1080).alias("y"))
    held = pixels.crop_regions(px, regions)
    assert not re.search("NestedLoop|Cartesian", held._jdf.queryExecution().executedPlan().toString())
    X, Y = (np.arange(150_000) * k % m for k, m in ((7, 1800), (11, 1000)))
    want = sum(int(((X <= i * 13 % 1920) & (i * 13 % 1920 < X + 8) & (Y <= i * 17 % 1080) & (i * 17 % 1080 < Y + 8)).sum()) for i in range(2000))
    assert held.count() == want > 1000


def test_luminance_at_the_threshold_is_black(spark):
    """Colours whose luminance is 127.3 exactly, of which sums of fractions put some above it, and the next brighter ones."""
    at = [(r, g, (127300 - 299 * r - 587 * g) // 114) for r in range(256) for g in range(256) if (127300 - 299 * r - 587 * g) % 114 == 0 and 0 <= 127300 - 299 * r - 587 * g < 114 * 255]
    assert any(0.299 * r + 0.587 * g + 0.114 * b > 127.3 for r, g, b in at)
    colors = at + [(r, g, b + 1) for r, g, b in at]
    want = [0] * len(at) + [255] * len(at)
    image = np.array([colors], np.uint8)
    assert (frames.luminance_over(image, 127.3) * 255).ravel().tolist() == want
    made = spark.createDataFrame([("v", 0.0, len(colors), 1, bytearray(image.tobytes()))], SCHEMA)
    assert list(frames.black_and_white_frames(made, 127.3).first()["bw"]) == want
    assert frames.frame_features(made, frames.Spec(threshold=127.3)).first()["n_white"] == len(at)
    rows = pixels.black_and_white(frames.frame_pixels(made), 127.3).orderBy("x").collect()
    assert [r["v"] for r in rows] == want
