"""Detected games against statistics games, members and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ON = ["map", "orange_score", "blue_score"]


def attach_candidates(games: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs of a detected game and a statistics game with the same map and scores: all of them, as many as the product of both sides of a common result.

    Where counts or the first few are wanted, ``candidate_counts`` and ``best_candidates`` make no more rows than they give.
    """
    return games.join(stats, ON)


def candidate_counts(games: DataFrame, stats: DataFrame, id_col: str = "id") -> DataFrame:
    """Games that have candidates, with n, how many, and first_id, the least of their ids; statistics are counted by map and scores first, so no pair is made."""
    known = stats.groupBy(*ON).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return games.join(known, ON)


def best_candidates(games: DataFrame, stats: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """Games with each of their k first candidates by ``order``, and rank, from 1: statistics are cut to k by map and scores before games meet them."""
    best = stats.withColumn("rank", F.row_number().over(Window.partitionBy(*ON).orderBy(*order))).where(F.col("rank") <= k)
    return games.join(best, ON)


def unattached_games(games: DataFrame, stats: DataFrame) -> DataFrame:
    return games.join(stats, ON, "left_anti")


def beta_members(users: DataFrame, beta: DataFrame) -> DataFrame:
    return users.join(beta, "user_id", "left_semi")


def upload_eligible(games: DataFrame, beta: DataFrame, coins: DataFrame, maps: DataFrame) -> DataFrame:
    """games(user_id, video_path, map) with eligible: a beta user with coins, a video, and margins for the map."""
    member = beta.select("user_id", F.lit(True).alias("_beta")).distinct()
    out = games.join(member, "user_id", "left").join(coins.select("user_id", "coins"), "user_id", "left").join(maps.select(F.col("name").alias("map"), "margins"), "map", "left")
    ok = F.col("_beta") & (F.coalesce("coins", F.lit(0)) > 0) & F.col("video_path").isNotNull() & F.col("margins").isNotNull()
    return out.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("_beta", "coins", "margins")


def first_box_per_map(boxes: DataFrame) -> DataFrame:
    """boxes(video_id, map, game_order, box) with box_used: the first known box of the video's map, for later games too."""
    w = Window.partitionBy("video_id", "map").orderBy("game_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return boxes.withColumn("box_used", F.first("box", ignorenulls=True).over(w))
