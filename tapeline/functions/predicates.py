"""Predicates and classifications of columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def color_similar(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], tol: Column | int = 20) -> Column:
    """Every channel within the tolerance, which counts as within."""
    return reduce(and_, (F.abs(x - y) <= tol for x, y in zip(a, b, strict=True)))


def frame_class(score: Column, end: Column, loading: Column, intro: Column, playing: Column) -> Column:
    """One class of a frame: the first of these that holds, else null."""
    return F.when(score, "score").when(end, "end").when(loading, "loading").when(intro, "intro").when(playing, "playing")


def is_player_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-zA-Z0-9]+#[0-9]+\z"), F.lit(False))


def _host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host of an address, without the scheme and www that it may have, and what follows the first slash."""
    bare = F.when(url.startswith("https://"), F.substring(url, 9, 1 << 30)).when(url.startswith("http://"), F.substring(url, 8, 1 << 30)).otherwise(url)
    bare = F.when(bare.startswith("www."), F.substring(bare, 5, 1 << 30)).otherwise(bare)
    slash = F.locate("/", bare)
    return F.when(slash > 0, F.substring(bare, F.lit(1), slash - 1)), F.when(slash > 0, F.substring(bare, slash + 1, F.lit(1 << 30)))


def _only(text: Column, allowed: str) -> Column:
    """Not empty, and made of the characters alone."""
    return (F.length(text) > 0) & (F.length(F.translate(text, allowed, "")) == 0)


#: Characters of names, of ids, and the length of a video's id.
DIGITS = "0123456789"
NAME = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
ID, ID_LENGTH = NAME + "-", 11


def is_youtube_url(url: Column) -> Column:
    """Watch, live and short addresses of one video: its id, then nothing, or further parameters without white space."""
    host, rest = _host_and_rest(url)
    lead = {"youtube.com": ("watch?v=", "live/"), "youtu.be": ("",)}
    found = None
    for name, starts in lead.items():
        for start in starts:
            video = F.when((host == name) & rest.startswith(start), F.substring(rest, len(start) + 1, 1 << 30))
            found = video if found is None else F.coalesce(found, video)
    own, more = F.substring(found, 1, ID_LENGTH), F.substring(found, ID_LENGTH + 1, 1 << 30)
    ended = (more == "") | (more.startswith("&") & ~more.rlike(r"(?U)\s"))
    return F.coalesce((F.length(own) == ID_LENGTH) & _only(own, ID) & ended, F.lit(False))


def is_twitch_url(url: Column) -> Column:
    """Addresses of a recorded video, by number, or of a channel's clip."""
    host, rest = _host_and_rest(url)
    part = lambda i: F.get(F.split(rest, "/", -1), F.lit(i))
    n = F.size(F.split(rest, "/", -1))
    video = (n == 2) & (part(0) == "videos") & _only(part(1), DIGITS)
    clip = (n == 3) & (part(1) == "clip") & _only(part(0), NAME) & _only(part(2), ID)
    return F.coalesce((host == "twitch.tv") & (video | clip), F.lit(False))


def platform(url: Column) -> Column:
    return F.when(is_youtube_url(url), "youtube").when(is_twitch_url(url), "twitch")


def bright_enough(r: Column, g: Column, b: Column, least: int = 20) -> Column:
    """Of a frame's rounded mean colour: not all channels dark."""
    return ~((r < least) & (g < least) & (b < least))


def box_matches_bound(box: Column, bound: Column, frame_w: Column, share: float = 0.005) -> Column:
    """Each edge within a share of the frame's width of the bound [x, y, w, h]; no bound accepts."""
    x, y, w, h = (F.get(bound, F.lit(i)) for i in range(4))
    tol = frame_w * share
    near = (F.abs(box["x1"] - x) <= tol) & (F.abs(box["y1"] - y) <= tol) & (F.abs(box["x2"] - x - w) <= tol) & (F.abs(box["y2"] - y - h) <= tol)
    return F.coalesce(bound.isNull() | near, F.lit(False))


def box_size_ok(box: Column, max_w: int = 650, max_h: int = 400) -> Column:
    return (box["x2"] - box["x1"] <= max_w) & (box["y2"] - box["y1"] <= max_h)


def panel_height_ok(box: Column, n: int, unit: int = 83, tol: float = 0.1) -> Column:
    return (box["y2"] - box["y1"]).between(unit * n * (1 - tol), unit * n * (1 + tol))


def keep_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that stay."""
    return chunks.where(~F.coalesce("remove", F.lit(False)))


def cut_is_valid(chunks: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, valid): a cut is worth making if some chunk goes."""
    return chunks.groupBy(key).agg(F.bool_or(F.coalesce("remove", F.lit(False))).alias("valid"))


def log_level_filter(logs: DataFrame, level: str) -> DataFrame:
    return logs if level == "all" else logs.where(F.col("level") == level)
