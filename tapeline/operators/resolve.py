"""Noisy readings to one value, and values to known names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(readings: DataFrame, keys: list[str], value: str = "text", pos: str = "pos", checker: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, value): the most frequent reading of each key, the earliest of equals, '' without any.

    A checker maps each reading before empty ones are dropped.
    """
    v = checker(F.col(value)) if checker else F.col(value)
    votes = readings.select(*keys, v.alias("v"), F.col(pos).alias("p")).groupBy(*keys, "v").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    best = F.max_by(F.when(F.coalesce("v", F.lit("")) != "", F.col("v")), F.when(F.coalesce("v", F.lit("")) != "", F.struct(F.col("n"), -F.col("first"))))
    return votes.groupBy(*keys).agg(F.coalesce(best, F.lit("")).alias(value))


#: Tokens, and maps, of a dictionary that is looked up inside each text.
SMALL_TOKENS, SMALL_MAPS = 10_000, 200


def map_from_text(readings: DataFrame, map_dictionary: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, map): the first map, in dictionary order, one of whose tokens is a word of the reading; '' if none, or without text.

    Line breaks are removed, then words are parted by single blanks; the key names a
    reading. The tokens of a small dictionary are looked for inside each text, and its maps are tried
    in order up to the first that fits: one pass without a shuffle. A larger one meets the
    words by an equi-join on tokens, so that neither side needs to be small.
    """
    tokens = map_dictionary.select("map_order", "name", F.explode("tokens").alias("word")).where("word is not null")
    words = F.split(F.lower(F.regexp_replace(text, r"[\r\n]", "")), " ", -1)
    listed = map_dictionary.where(F.size("tokens") > 0)
    if listed.limit(SMALL_MAPS + 1).count() <= SMALL_MAPS and tokens.limit(SMALL_TOKENS + 1).count() <= SMALL_TOKENS:
        return _map_inside(readings, words, [tuple(r) for r in listed.orderBy("map_order").select("name", "tokens").collect()], key)
    found = readings.select(key, F.explode(words).alias("word")).join(tokens, "word").groupBy(key).agg(F.min_by("name", "map_order").alias("map"))
    return readings.select(key).join(found, key, "left").select(key, F.coalesce("map", F.lit("")).alias("map"))


def _map_inside(readings: DataFrame, words: Column, maps: list[tuple[str, list[str]]], key: str) -> DataFrame:
    every = sorted({w for _, tokens in maps for w in tokens if w is not None})
    hits = readings.select(key, F.array_distinct(F.filter(words, lambda w: w.isin(every))).alias("_hits"))
    first = [F.when(F.arrays_overlap("_hits", F.array(*(F.lit(w) for w in tokens if w is not None))), name) for name, tokens in maps if any(w is not None for w in tokens)]
    return hits.select(key, F.coalesce(*first, F.lit("")).alias("map"))


def resolved_names(readings: Column, roster: Column) -> Column:
    """array<string>: each reading's roster name, greedily one to one, in order.

    An exact name that is still free, else the free name with the smallest
    Levenshtein distance in lower case, the first of equals; the reading itself once
    the roster is used up.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("out"))
    indexes = F.filter(F.sequence(F.lit(0), F.size(roster)), lambda i: i < F.size(roster))

    def step(state: Column, reading: Column) -> Column:
        free = F.filter(indexes, lambda i: ~F.array_contains(state["used"], i.cast("int")))
        distance = lambda i: F.when(F.get(roster, i) == reading, -1).otherwise(F.levenshtein(F.lower(F.get(roster, i)), F.lower(reading)))
        best = F.array_min(F.transform(free, lambda i: F.struct(distance(i).alias("d"), i.cast("int").alias("i"))))
        chosen = F.coalesce(F.get(roster, best["i"]), reading)
        used = F.when(best.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(best["i"])))
        return F.struct(used.alias("used"), F.concat(state["out"], F.array(chosen)).alias("out"))

    return F.aggregate(readings, start, step, lambda s: s["out"])
