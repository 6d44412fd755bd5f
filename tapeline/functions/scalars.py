"""Scalar functions of columns. All but ``nfc`` are built-in expressions; null in gives null out unless stated."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(x + 0.5)


def number_prefix(text: Column) -> Column:
    """The whole number that a text begins with, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d{1,9})", 1).try_cast("int")


def read_time(s: Column) -> Column:
    """Seconds as [H:]MM:SS; rounded seconds may read 60."""
    h = F.floor(s / 3600)
    m = F.floor(s / 60 - h * 60)
    sec = round_half_up(s - h * 3600 - m * 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.when(h != 0, F.concat(h.cast("string"), F.lit(":"))).otherwise(""), two(m), F.lit(":"), two(sec))


def readable_duration(d: Column) -> Column:
    return F.concat(F.floor(d / 60).cast("string"), F.lit("m"), (d % 60).cast("string"), F.lit("s"))


def hms_to_sec(text: Column) -> Column:
    """h:m:s as seconds; a missing or wrong part gives null."""
    p = F.split(text, ":", -1)
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2)


def _clock_after(line: Column, lead: str) -> Column:
    return hms_to_sec(F.nullif(F.regexp_extract(line, lead + r"(\d+:\d+:\d+\.\d+)", 1), F.lit("")))


def progress_time(line: Column) -> Column:
    return _clock_after(line, "time=")


def progress_duration(line: Column) -> Column:
    return _clock_after(line, "Duration: ")


def resolution(text: Column) -> Column:
    """struct<w, h> of the first ``, WxH`` followed by a blank or comma, else zeros."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r", (\d+)x(\d+)[ ,]", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("w"), part(2).alias("h"))


def resolution_route(height: Column, wanted: int = 1080) -> Column:
    return F.when(height == wanted, "ok").otherwise("rescale")


def download_percent(chunk: Column) -> Column:
    """The first percentage with one decimal, cut to a whole number."""
    return F.floor(F.nullif(F.regexp_extract(chunk, r"(\d{1,3}\.\d)%", 1), F.lit("")).cast("double")).cast("int")


def clock_start_estimate(t: Column, clock: Column, max_minutes: int = 10) -> Column:
    """When a countdown that reads ``clock`` at time t began; null for what isn't m:s with at most nine minutes."""
    p = F.split(clock, ":", -1)
    m, s = number_prefix(F.get(p, F.lit(0))), number_prefix(F.get(p, F.lit(1)))
    return F.when((F.size(p) == 2) & (m <= 9) & s.isNotNull(), t - ((max_minutes - m) * 60 - s - 5))


def score_check(text: Column) -> Column:
    """Whole number at the start of the first three characters, held within 0 and 100, as text; else '0'."""
    n = number_prefix(F.substring(text, 1, 3))
    return F.when(n.isNull(), "0").otherwise(F.greatest(F.least(n, F.lit(100)), F.lit(0)).cast("string"))


def accept_score(text: Column) -> Column:
    """A whole number up to 100, else 0."""
    n = text.try_cast("int")
    return F.coalesce(F.when((F.trim(text) != "") & (n <= 100), n), F.lit(0))


def player_tag_from_paste(text: Column) -> Column:
    """The last part between slashes that holds a '#', if there are slashes and such a part."""
    p = F.split(text, "/", -1)
    found = F.try_element_at(F.filter(p, lambda x: x.contains("#")), F.lit(-1))
    return F.when(F.size(p) > 1, F.coalesce(found, text)).otherwise(text)


def tag_name(tag: Column) -> Column:
    return F.substring_index(tag, "#", 1)


def canonical_video_url(url: Column, prefix: str = "https://www.youtube.com/watch?v=") -> Column:
    """A watch address with its video id alone, where the address has one; else unchanged."""
    v = F.try_url_decode(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]*)", 1))
    return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(prefix), v)).otherwise(url)


def output_name(orange: Column, blue: Column, map_: Column, free_text: Column, ts: Column, source: Column, prefix: str, lower: bool = True) -> Column:
    """``<prefix> - O vs B - M [- free ](ts).ext`` with the extension of the source's name."""
    ext = F.element_at(F.split(source, r"\.", -1), -1)
    free = F.when(F.coalesce(free_text, F.lit("")) != "", F.concat(F.lit("- "), free_text, F.lit(" "))).otherwise("")
    return F.concat(F.lit(f"{prefix} - "), orange, F.lit(" vs "), blue, F.lit(" - "), map_, F.lit(" "), free, F.lit("("), ts, F.lit(")."), F.lower(ext) if lower else ext)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def date_text(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "dd/MM/yyyy")


def hour_text(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "HH:mm")


def version_diff(a: Column, b: Column) -> Column:
    """First difference of dotted numbers that isn't zero; missing and other parts count as 0."""
    x, y = F.split(a, r"\.", -1), F.split(b, r"\.", -1)
    part = lambda p, i: F.coalesce(F.get(p, i).try_cast("int"), F.lit(0))
    diffs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: part(x, i) - part(y, i))
    return F.coalesce(F.get(F.filter(diffs, lambda d: d != 0), F.lit(0)), F.lit(0))


def redact_inline_images(json: Column, token: str = "...") -> Column:
    """String values that begin as inline images, replaced at any depth of a JSON text; keys stay."""
    return F.regexp_replace(json, r'([:\[,]\s*)"data:image/(?:[^"\\]|\\.)*"(?!\s*:)', f'$1"{token}"')


#: Shares of red, green and blue in the luminance, in thousandths.
LUMINANCE = (299, 587, 114)


def thousandths(x: float) -> Decimal:
    """A decimal number times 1000, exactly as it is written."""
    return Decimal(str(x)) * 1000


def luminance_bw(r: Column, g: Column, b: Column, threshold: float) -> Column:
    """255 where the luminance is above the threshold, in whole thousandths, as sums of fractions may lie above a threshold that they equal."""
    total = sum(c * w for c, w in zip((r, g, b), LUMINANCE, strict=True))
    return F.when(total > F.lit(thousandths(threshold)), 255).otherwise(0)


def expand_box(box: Column, margins: Column) -> Column:
    """A box grown by margins [top, right, bottom, left] in percent; left and top stop at the edge."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    top, right, bottom, left = (F.get(margins, F.lit(i)) for i in range(4))
    x, y = F.least(box["x1"].cast("double"), w * left / 100), F.least(box["y1"].cast("double"), h * top / 100)
    out = {"x1": box["x1"] - x, "y1": box["y1"] - y, "x2": box["x2"] + F.when(right == left, x).otherwise(w * right / 100), "y2": box["y2"] + F.when(bottom == top, y).otherwise(h * bottom / 100)}
    return F.struct(*(round_half_up(v).cast("int").alias(k) for k, v in out.items()))


def team_name_clean(text: Column, forced: Column) -> Column:
    """The forced name if any, else a reading of two characters or more, in capitals; else null."""
    f = F.trim(forced)
    return F.coalesce(F.when(f != "", F.upper(f)), F.when(F.length(text) >= 2, F.upper(text)))


def new_game_payload(map_: Column, date_ms: Column, orange: Column, blue: Column) -> Column:
    """A game as JSON, encoded as a value of an address's query."""
    encoded = F.url_encode(F.to_json(F.struct(map_.alias("map"), date_ms.alias("date"), orange.alias("orange"), blue.alias("blue"))))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return encoded


def strip_first_newline(text: Column) -> Column:
    return F.regexp_replace(text, r"^([^\r\n]*)(?:\r?\n|\r)", "$1")


def centered_box(w: Column, h: Column, frame_w: Column) -> Column:
    x = (frame_w - w) / 2
    return F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + w).alias("x2"), h.cast("double").alias("y2"))


def name_slices(box: Column, n: int, avatar_left: bool) -> Column:
    """n bands, each three tenths of its share of the height, without 24 % of the width at the avatar's side."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    trim, step = w * 0.24, h / n

    def band(i: Column) -> Column:
        y = box["y1"] + i * step
        return F.struct((box["x1"] + (trim if avatar_left else F.lit(0.0))).alias("x1"), y.alias("y1"), (box["x2"] - (F.lit(0.0) if avatar_left else trim)).alias("x2"), (y + step * 0.3).alias("y2"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), band)
