"""Frames as bytes: what the row forms in ``pixels`` find, by one pass of numpy over each frame and without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import LUMINANCE, thousandths
from tapeline.operators.pixels import ACROSS, BOTTOM

Rgb = tuple[int, int, int]
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
FEATURES = f"video_id string, t double, ok boolean, mean struct<r:int,g:int,b:int>, n_white long, box {BOX}, runs array<struct<y:int,height:int>>, panel {BOX}, playing boolean, modes map<string,int>"
_BOX = pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")])
FEATURE_SCHEMA = pa.schema([
    ("video_id", pa.string()), ("t", pa.float64()), ("ok", pa.bool_()), ("mean", pa.struct([(c, pa.int32()) for c in "rgb"])), ("n_white", pa.int64()), ("box", _BOX),
    ("runs", pa.list_(pa.struct([("y", pa.int32()), ("height", pa.int32())]))), ("panel", _BOX), ("playing", pa.bool_()), ("modes", pa.map_(pa.string(), pa.int32())),
])


@dataclass(frozen=True)
class Bright:
    """Near-white pixels of a window, as in ``bright_bbox``."""

    win_w: int = 650
    win_h: int = 400
    tol: int = 50
    default: tuple[int, int, int, int] = (0, 0, 0, 0)


@dataclass(frozen=True)
class Lines:
    """Hot lines and their runs, as in ``line_color_counts``, ``hot_line`` and ``text_runs``; of the top right region (w, h), or of the whole frame."""

    palette: list[tuple[str, Rgb]]
    color_tol: int = 40
    height: int = 11
    tol: int = 4
    region: tuple[int, int] | None = None


@dataclass(frozen=True)
class Panel:
    """A panel of rows in one colour, as in ``panel_bbox``; columns and shares are of the frame's own size."""

    color: Rgb
    column_x: int
    left: bool = True
    tol: int = 20
    across_tol: int = 30


@dataclass(frozen=True)
class Spec:
    """What to look for; parts that are None give null columns.

    ``probes``: (class, template, mode, x, y, r, g, b, tol), as in ``match_templates``;
    ``slots``: (side, x, y) with the colour of each side in ``sides``, as in ``playing_frame``.
    """

    threshold: float | None = None
    bright: Bright | None = None
    lines: Lines | None = None
    panel: Panel | None = None
    probes: list[tuple] | None = None
    slots: list[tuple[str, int, int]] | None = None
    sides: dict[str, Rgb] | None = None
    side_tol: int = 20
    black_tol: int = 50


def like(image: np.ndarray, color: Rgb, tol: int) -> np.ndarray:
    """Which pixels differ from a colour by tol at most in every channel."""
    low, high = (np.clip(np.array(color) + d, 0, 255).astype(np.uint8) for d in (-tol, tol))
    return ((image >= low) & (image <= high)).all(-1)


def mean_of(image: np.ndarray) -> dict[str, int]:
    total = image.reshape(-1, 3).sum(0, dtype=np.int64)
    return {c: int(np.floor(total[k] / (image.size // 3) + 0.5)) for k, c in enumerate("rgb")}


def luminance_over(image: np.ndarray, threshold: float) -> np.ndarray:
    """Which pixels' luminance is above the threshold, in whole thousandths: one that equals it is not."""
    r, g, b = (image[..., k].astype(np.int32) * w for k, w in enumerate(LUMINANCE))
    return r + g + b > math.floor(thousandths(threshold))


def bright_box(image: np.ndarray, spec: Bright) -> dict[str, int]:
    """Sums of rows and columns of the near-white pixels; each window's far sides reach one pixel further in one direction."""
    white = like(image[: spec.win_h + 1, : spec.win_w + 1], (255, 255, 255), spec.tol)
    inner, wide, tall = white[: spec.win_h, : spec.win_w], white[: spec.win_h], white[:, : spec.win_w]
    columns, rows = np.flatnonzero(inner.sum(0)), np.flatnonzero(inner.sum(1))
    right, bottom = np.flatnonzero(wide.sum(0)), np.flatnonzero(tall.sum(1))
    found = [x[at] + more if len(x) else None for x, at, more in ((columns, 0, 0), (rows, 0, 0), (right, -1, 1), (bottom, -1, 1))]
    return {c: int(d if v is None else v) for c, v, d in zip(("x1", "y1", "x2", "y2"), found, spec.default, strict=True)}


def runs_of(hot: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of maximal runs."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hot.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def text_lines(image: np.ndarray, spec: Lines) -> list[dict[str, int]]:
    """Runs of hot lines of about the height; one that reaches the last line is never closed, so it is lost."""
    if spec.region:
        image = image[: spec.region[1], max(0, image.shape[1] - spec.region[0]) :]
    free, n = np.ones(image.shape[:2], bool), {}
    for name, color in spec.palette:
        own = like(image, color, spec.color_tol) & free
        n[name], free = own.sum(1) > 0, free & ~own
    hot = n["white"] & ((n["orange"] & n["blue"]) | n["red"])
    return [{"y": a, "height": m} for a, m in runs_of(hot) if a + m < len(hot) and abs(m - spec.height) <= spec.tol]


def panel_box(image: np.ndarray, spec: Panel) -> dict[str, int]:
    """Runs of hits on one column from the bottom give the vertical sides; the outermost hits of one row the others. 0 for what isn't found."""
    h, w = image.shape[:2]
    column = like(image[:, spec.column_x], spec.color, spec.tol) if spec.column_x < w else np.zeros(0, bool)
    runs = runs_of(column)[::-1]
    bottom = sum(runs[0]) - 1 + int(np.floor(BOTTOM * h)) if runs else 0
    above = np.flatnonzero(~column[: max(0, runs[3][0] - 1)]) if len(runs) > 3 else []
    top = int(above[-1]) if len(above) else 0
    x = np.arange(w)
    row, quarter = int(np.floor(top + ACROSS * h)), x < w / 4 if spec.left else x > w * 3 / 4
    hits = x[quarter & like(image[row], spec.color, spec.across_tol)] if row < h else x[:0]
    inner = hits[hits > 0]
    return {"x1": int(inner[0]) if len(inner) else 0, "y1": top, "x2": int(hits[-1]) if len(hits) else 0, "y2": bottom}


def lowest_modes(image: np.ndarray, probes: list[tuple]) -> dict[str, int]:
    """By class, the lowest mode of a template all of whose probes lie in the frame and match."""
    h, w = image.shape[:2]
    met: dict[tuple, bool] = {}
    for name, template, mode, x, y, *color, tol in probes:
        hit = 0 <= x < w and 0 <= y < h and bool((np.abs(image[y, x].astype(int) - color) <= tol).all())
        met[name, template, mode] = met.get((name, template, mode), True) and hit
    out: dict[str, int] = {}
    for (name, _, mode), ok in met.items():
        if ok:
            out[name] = min(mode, out.get(name, mode))
    return out


def is_playing(image: np.ndarray, spec: Spec) -> bool:
    """Both sides have a slot in their colour, and all slots have it or are black; a slot outside the frame doesn't match."""
    h, w = image.shape[:2]
    for side, color in spec.sides.items():
        at = [(x, y) for s, x, y in spec.slots if s == side]
        if not at or any(x >= w or y >= h for x, y in at):
            return False
        seen = np.array([image[y, x] for x, y in at])
        own = like(seen, color, spec.side_tol)
        if not own.any() or not (own | like(seen, (0, 0, 0), spec.black_tol)).all():
            return False
    return True


def image_of(row: dict) -> np.ndarray | None:
    """(height, width, 3) over the bytes of a frame, without a copy; None for a damaged one."""
    w, h, rgb = row["width"], row["height"], row["rgb"]
    if not w or not h or w < 0 or h < 0 or rgb is None or len(rgb) < 3 * w * h:
        return None
    return np.frombuffer(rgb, np.uint8, 3 * w * h).reshape(h, w, 3)


def images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
    widths, heights, rgb = batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("rgb")
    for i in range(batch.num_rows):
        yield i, image_of({"width": widths[i], "height": heights[i], "rgb": rgb[i].as_buffer() if rgb[i].is_valid else None})


def whole_frame() -> Column:
    """That a frame has all the bytes of its size; damaged frames have none of the features."""
    return F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("rgb") >= 3 * F.col("width").cast("long") * F.col("height")), F.lit(False))


def frame_features(frames: DataFrame, spec: Spec) -> DataFrame:
    """FEATURES, a row for each frame(video_id, t, width, height, rgb): everything that ``spec`` asks for from one pass over its bytes.

    ``ok`` is false for damaged frames: null or too few bytes, no size; their features are null.
    Frames are large, so let spark.sql.execution.arrow.maxRecordsPerBatch be small enough for a batch to fit.
    """

    def of(image: np.ndarray) -> dict:
        return {
            "mean": mean_of(image),
            "n_white": None if spec.threshold is None else int(luminance_over(image, spec.threshold).sum()),
            "box": spec.bright and bright_box(image, spec.bright),
            "runs": None if spec.lines is None else text_lines(image, spec.lines),
            "panel": spec.panel and panel_box(image, spec.panel),
            "playing": None if spec.slots is None else is_playing(image, spec),
            "modes": None if spec.probes is None else list(lowest_modes(image, spec.probes).items()),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"ok": False} if image is None else {"ok": True, **of(image)} for _, image in images(batch)]
            rest = [pa.array([x.get(f.name) for x in out], f.type) for f in list(FEATURE_SCHEMA)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("t"), *rest], schema=FEATURE_SCHEMA)

    own = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("t").cast("double").alias("t"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb")
    return own.mapInArrow(run, FEATURES)


def black_and_white_frames(frames: DataFrame, threshold: float) -> DataFrame:
    """(video_id, t, width, height, bw): a byte for each pixel, 255 where its luminance is above the threshold, else 0; null for damaged frames."""
    schema = pa.schema([("video_id", pa.string()), ("t", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("bw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bw = [None if image is None else (luminance_over(image, threshold) * np.uint8(255)).tobytes() for _, image in images(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video_id", "t", "width", "height")), pa.array(bw, pa.binary())], schema=schema)

    own = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("t").cast("double").alias("t"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb")
    return own.mapInArrow(run, "video_id string, t double, width int, height int, bw binary")


def frame_pixels(frames: DataFrame) -> DataFrame:
    """(video_id, t, x, y, r, g, b): every pixel of every whole frame, for the row forms; a frame at a time."""
    schema = pa.schema([("video_id", pa.string()), ("t", pa.float64()), *((c, pa.int32()) for c in ("x", "y", "r", "g", "b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, image in images(batch):
                if image is not None:
                    h, w = image.shape[:2]
                    y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                    head = [pa.repeat(batch.column(c)[i], h * w) for c in ("video_id", "t")]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(x), pa.array(y), *(pa.array(image[..., k].ravel().astype(np.int32)) for k in range(3))], schema=schema)

    own = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("t").cast("double").alias("t"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb")
    return own.mapInArrow(run, "video_id string, t double, x int, y int, r int, g int, b int")
