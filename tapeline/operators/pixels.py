"""Pixels: probes, templates, regions, boxes, runs. Frames are reduced before anything is dealt out by video."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.predicates import color_similar
from tapeline.functions.scalars import luminance_bw, round_half_up
from tapeline.sources.shared import small

RGB = ("r", "g", "b")


def probes_on_pixels(pixels: DataFrame, probes: DataFrame) -> DataFrame:
    own = probes.select(*(F.col(c).alias(f"p_{c}") if c in (*RGB, "tol") else F.col(c) for c in probes.columns))
    return pixels.join(small(own), ["x", "y"])


def match_templates(pixels: DataFrame, probes: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, groups, mode): the lowest mode of a template all of whose probes are there and match.

    probes(template, mode, probe, x, y, r, g, b, tol), with the columns in groups, as
    a class, where templates stand for several things.
    """
    hit = color_similar(tuple(map(F.col, RGB)), tuple(F.col(f"p_{c}") for c in RGB), F.col("p_tol"))
    wanted = probes.groupBy(*groups, "template", "mode").agg(F.countDistinct("probe").alias("wanted"))
    met = probes_on_pixels(pixels, probes).groupBy("frame_id", *groups, "template", "mode").agg(F.bool_and(hit).alias("ok"), F.countDistinct("probe").alias("n"))
    full = met.join(small(wanted), [*groups, "template", "mode"]).where("ok and n = wanted")
    return full.groupBy("frame_id", *groups).agg(F.min("mode").alias("mode"))


def playing_frame(pixels: DataFrame, slots: DataFrame, palette: dict[str, tuple[int, int, int]], tol: int = 20, black_tol: int = 50) -> DataFrame:
    """(frame_id, playing): both sides have a slot in their colour, and all slots have it or are black.

    slots(side, slot, x, y). Slots without a pixel don't match.
    """
    rgb = tuple(map(F.col, RGB))
    own = F.lit(False)
    for side, color in palette.items():
        own = F.when(F.col("side") == side, color_similar(rgb, tuple(map(F.lit, color)), tol)).otherwise(own)
    black = color_similar(rgb, (F.lit(0), F.lit(0), F.lit(0)), black_tol)
    by_side = pixels.join(small(slots), ["x", "y"]).groupBy("frame_id", "side").agg(F.bool_or(own).alias("some"), F.bool_and(own | black).alias("all"), F.countDistinct("slot").alias("n"))
    wanted = slots.groupBy("side").agg(F.countDistinct("slot").alias("wanted"))
    sides = by_side.join(small(wanted), "side").groupBy("frame_id").agg((F.bool_and(F.col("some") & F.col("all") & (F.col("n") == F.col("wanted"))) & (F.count("*") == len(palette))).alias("playing"))
    return pixels.select("frame_id").distinct().join(sides, "frame_id", "left").select("frame_id", F.coalesce("playing", F.lit(False)).alias("playing"))


#: Pixels on a side of the finest cell, and how many cells of a level make one of the next, as a power of two.
CELL, COARSER_BITS = 64, 2
#: Parts that the frames are dealt into where regions are for all frames and too many to be sent everywhere.
FRAME_PARTS = 64


def crop_regions(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels of each region, with x and y counted from its corner. regions(region, x1, y1, x2, y2), of one frame each where there is a frame_id.

    A join by cells of a grid: a region lies in the cells of the first level, of cells
    of 64 pixels, then 256 and so on, on which it spans three or less each way, so
    16 at most whatever its size; a pixel has one cell on each level that has regions. Regions
    of one frame also meet by the frame. Regions for all frames are sent everywhere
    if few, else once to each part of the frames. Empty regions and null bounds hold nothing.
    """
    by_frame = ["frame_id"] if "frame_id" in regions.columns else []
    sides = [F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]
    own = regions.select("region", *by_frame, *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2"))).where((sides[0] < sides[2]) & (sides[1] < sides[3]))
    longest = F.greatest(sides[2] - sides[0], sides[3] - sides[1])
    level = F.greatest(F.ceil(F.log2(longest / (3.0 * CELL)) / COARSER_BITS), F.lit(0)).cast("int")
    own = own.withColumn("_level", level)
    levels = sorted(r["_level"] for r in own.select("_level").distinct().collect())  # logarithmic in the largest region

    def cell(c: Column) -> Column:
        return F.floor(c / F.expr(f"shiftleft({CELL}L, {COARSER_BITS} * _level)")).cast("long")

    for axis, low, high in (("_cx", sides[0], sides[2]), ("_cy", sides[1], sides[3])):
        own = own.withColumn(axis, F.explode(F.sequence(cell(low), cell(high))))
    placed = pixels.withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    keys = [*by_frame, "_level", "_cx", "_cy"]
    if not by_frame:
        few = small(own)
        if few is own:
            own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FRAME_PARTS - 1))))
            placed, keys = placed.withColumn("_part", F.pmod(F.hash("frame_id"), F.lit(FRAME_PARTS))), [*keys, "_part"]
        else:
            own = few
    inside = (F.col("x") >= sides[0]) & (F.col("x") < sides[2]) & (F.col("y") >= sides[1]) & (F.col("y") < sides[3])
    held = placed.join(own, keys).where(inside).withColumn("x", F.col("x") - sides[0]).withColumn("y", F.col("y") - sides[1])
    return held.select(*pixels.columns, "region")


def mean_color(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg(*(round_half_up(F.avg(c)).cast("int").alias(c) for c in RGB))


def black_and_white(pixels: DataFrame, threshold: float) -> DataFrame:
    return pixels.withColumn("v", luminance_bw(*map(F.col, RGB), threshold))


def line_color_counts(pixels: DataFrame, palette: list[tuple[str, tuple[int, int, int]]], tol: int = 40) -> DataFrame:
    """(frame_id, y, one count for each colour): a pixel counts once, as the first colour that it resembles."""
    rgb, name = tuple(map(F.col, RGB)), None
    for color, value in palette:
        like = color_similar(rgb, tuple(map(F.lit, value)), tol)
        name = F.when(like, color) if name is None else name.when(like, color)
    return pixels.withColumn("_c", name).groupBy("frame_id", "y").agg(*(F.count_if(F.col("_c") == c).alias(c) for c, _ in palette))


def hot_line(white: Column, orange: Column, blue: Column, red: Column) -> Column:
    return (white > 0) & (((orange > 0) & (blue > 0)) | (red > 0))


def text_runs(lines: DataFrame, height: int = 11, tol: int = 4) -> DataFrame:
    """(frame_id, y, height): maximal runs of hot lines of about the height. A run that reaches a frame's last line is never closed, so it is lost.

    lines(frame_id, y, hot).
    """
    last = lines.groupBy("frame_id").agg(F.max("y").alias("last"))
    island = F.col("y") - F.row_number().over(Window.partitionBy("frame_id").orderBy("y"))
    runs = lines.where("hot").withColumn("_i", island).groupBy("frame_id", "_i").agg(F.min("y").alias("y"), F.count("*").cast("int").alias("height"))
    closed = runs.join(last, "frame_id").where(F.col("y") + F.col("height") - 1 < F.col("last"))
    return closed.where(F.col("height").between(height - tol, height + tol)).select("frame_id", "y", "height")


def bright_bbox(pixels: DataFrame, win_w: int = 650, win_h: int = 400, tol: int = 50, default: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """(frame_id, x1, y1, x2, y2) around near-white pixels of the window."""
    white = color_similar(tuple(map(F.col, RGB)), (F.lit(255),) * 3, tol)
    x, y = F.col("x"), F.col("y")
    inner = white & (x < win_w) & (y < win_h)
    found = (F.min(F.when(inner, x)), F.min(F.when(inner, y)), 1 + F.max(F.when(white & (x <= win_w) & (y < win_h), x)), 1 + F.max(F.when(white & (x < win_w) & (y <= win_h), y)))
    return pixels.groupBy("frame_id").agg(*(F.coalesce(v, F.lit(d)).alias(n) for v, d, n in zip(found, default, ("x1", "y1", "x2", "y2"), strict=True)))


#: Shares of a frame's height, from the lowest hit to a panel's bottom and from its top to the row that is read across.
BOTTOM, ACROSS = 0.058, 0.005


def panel_bbox(pixels: DataFrame, color: tuple[int, int, int], column_x: int, width: int, height: int, left: bool = True, tol: int = 20, across_tol: int = 30) -> DataFrame:
    """(frame_id, x1, y1, x2, y2) of a panel of rows in one colour at the left or right of each frame; 0 for what isn't found.

    On one column, read upwards, the bottom lies a margin under the first hit, and the
    top is the nearest row without a hit at least two rows above the fourth run of
    hits. On a row just under the top, both sides are the outermost hits of the
    quarter where the panel is; a hit at x = 0 can't be its left side.
    """
    rgb, own = tuple(map(F.col, RGB)), tuple(map(F.lit, color))
    column = pixels.where(F.col("x") == column_x).withColumn("hit", color_similar(rgb, own, tol))
    island = F.col("y") - F.row_number().over(Window.partitionBy("frame_id").orderBy("y"))
    runs = column.where("hit").withColumn("_i", island).groupBy("frame_id", "_i").agg(F.min("y").alias("top"), F.max("y").alias("end"))
    ranked = runs.withColumn("n", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("end").desc())))
    edges = ranked.groupBy("frame_id").agg(F.max(F.when(F.col("n") == 1, F.col("end"))).alias("end"), F.max(F.when(F.col("n") == 4, F.col("top"))).alias("fourth"))
    above = column.where("not hit").join(edges, "frame_id").where("y <= fourth - 2").groupBy("frame_id").agg(F.max("y").alias("y1"))
    found = pixels.select("frame_id").distinct().join(edges, "frame_id", "left").join(above, "frame_id", "left")
    vertical = found.select("frame_id", F.coalesce("y1", F.lit(0)).alias("y1"), F.coalesce(F.col("end") + int(np.floor(BOTTOM * height)), F.lit(0)).alias("y2"))
    quarter = F.col("x") < width / 4 if left else F.col("x") > width * 3 / 4
    row = F.col("y") == F.floor(F.col("y1") + ACROSS * height)
    sides = pixels.where(quarter & color_similar(rgb, own, across_tol)).join(vertical, "frame_id").where(row).groupBy("frame_id")
    sides = sides.agg(F.min(F.when(F.col("x") > 0, F.col("x"))).alias("x1"), F.max("x").alias("x2"))
    return vertical.join(sides, "frame_id", "left").select("frame_id", F.coalesce("x1", F.lit(0)).alias("x1"), "y1", F.coalesce("x2", F.lit(0)).alias("x2"), "y2")


def probe_frames(frames: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """frames(video_id, t, width, height, rgb) to (video_id, t, x, y, r, g, b) at the points only; points outside a frame, and short buffers, give no row."""
    at = np.array(points, np.int64).reshape(-1, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, t, w, h, rgb in pdf[["video_id", "t", "width", "height", "rgb"]].itertuples(index=False):
                own = np.frombuffer(rgb or b"", np.uint8)
                x, y = at[(at[:, 0] < w) & (at[:, 1] < h)].T
                place = (y * w + x) * 3
                ok = place + 3 <= len(own)
                x, y, place = x[ok], y[ok], place[ok]
                out.append(pd.DataFrame({"video_id": v, "t": t, "x": x, "y": y, "r": own[place], "g": own[place + 1], "b": own[place + 2]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return frames.mapInPandas(run, "video_id string, t double, x int, y int, r int, g int, b int")
