"""Pages of match history: nested JSON to games, players and a wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.scalars import date_text, hour_text, readable_duration

STATS = ["kills", "deaths", "assists", "score", "inflictedDamage", "bulletsFiredAccuracy"]
NODE = "struct<createdAt:string,mode:struct<identifier:string>,map:struct<name:string>,data:struct<duration:int,teamOne:struct<name:string,score:int>,teamTwo:struct<name:string,score:int>>,players:array<struct<data:struct<niceName:string,team:string,kills:int,deaths:int,assists:int,score:int,inflictedDamage:double,bulletsFiredAccuracy:double>>>>"
#: A page may call itself the last of its season.
PAGES = f"season int, page int, last boolean, data struct<gameHistories:struct<nodes:array<{NODE}>>>"
#: Players of a side that a wide row has room for.
SLOTS = 5


def read_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Page documents with a fixed schema; what doesn't fit it is null."""
    return (spark.readStream if streaming else spark.read).schema(PAGES).json(path)


def history_nodes(pages: DataFrame, empty: bool = False) -> DataFrame:
    """One row for each game of the pages that have a list of games, in page order.

    With ``empty``, a page whose list is empty has a row without a place, and rows say whether their page is the last.
    """
    keys, explode = (["season", "page", "last"], F.posexplode_outer) if empty else (["season", "page"], F.posexplode)
    return pages.where("data.gameHistories.nodes is not null").select(*keys, explode("data.gameHistories.nodes").alias("pos", "node")).select(*keys, "pos", "node.*")


def read_history(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return history_nodes(read_pages(spark, path, streaming))


def page_window(pages: DataFrame, season: int, skip: int, n_pages: int, first_page: int = 1) -> DataFrame:
    """At most n_pages pages of a season, from first_page + skip on; filters on columns that tables are partitioned by."""
    low = first_page + skip
    return pages.where((F.col("season") == season) & (F.col("page") >= low) & (F.col("page") < low + n_pages))


def append_pages(*pages: DataFrame, once: bool = False) -> DataFrame:
    """Pages one after another; with ``once``, one of each (season, page)."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["season", "page"]) if once else out


def game_teams(nodes: DataFrame, tz: str = "UTC") -> DataFrame:
    """Flat games: mode, map, date, hour, duration, both teams' names, scores and players.

    A player is orange where their team has the first team's name, else blue where it
    has the second's, else left out; with equal names all are orange.
    """
    one, two, team = F.col("data.teamOne"), F.col("data.teamTwo"), lambda p: p["data"]["team"]
    stats = lambda p: F.struct(p["data"]["niceName"].alias("name"), *(p["data"][c].alias(c) for c in STATS))
    orange = F.transform(F.filter("players", lambda p: F.coalesce(team(p) == one["name"], F.lit(False))), stats)
    blue = F.transform(F.filter("players", lambda p: ~F.coalesce(team(p) == one["name"], F.lit(False)) & F.coalesce(team(p) == two["name"], F.lit(False))), stats)
    ts = F.to_timestamp("createdAt")
    own = [c for c in nodes.columns if c in ("season", "page", "last", "pos")]
    empty = F.array().cast("array<struct<name:string,kills:int,deaths:int,assists:int,score:int,inflictedDamage:double,bulletsFiredAccuracy:double>>")
    return nodes.select(*own, F.col("mode.identifier").alias("mode"), F.col("map.name").alias("map"), date_text(ts, tz).alias("date"), hour_text(ts, tz).alias("hour"), F.col("data.duration").alias("duration"), one["name"].alias("orange_name"), one["score"].alias("orange_score"), two["name"].alias("blue_name"), two["score"].alias("blue_score"), F.coalesce(orange, empty).alias("orange"), F.coalesce(blue, empty).alias("blue"))


def n_players(games: DataFrame) -> DataFrame:
    return games.withColumn("n_players", F.size("orange") + F.size("blue"))


def history_players(games: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each kept player: keys, side, slot from 0, name and six figures."""
    side = lambda s: games.select(*keys, F.lit(s).alias("side"), F.posexplode(s).alias("slot", "p"))
    return side("orange").unionByName(side("blue")).select(*keys, "side", "slot", "p.*")


def export_wide(games: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """79 columns in sheet order, and n_dropped, the players that had no slot; slots are picked from arrays, nothing is pivoted."""

    def cells(side: str) -> list:
        return [F.get(side, F.lit(i))[c].alias(f"{side}_{i + 1}_{c}") for i in range(SLOTS) for c in ["name", *STATS]]

    dropped = sum((F.greatest(F.size(s) - SLOTS, F.lit(0)) for s in ("orange", "blue")), F.lit(0))
    head = ["mode", (F.size("orange") + F.size("blue")).alias("n_players"), "map", "date", "hour", readable_duration(F.col("duration")).alias("readable_duration"), "duration"]
    return games.select(*keys, *head, "orange_score", *cells("orange"), "blue_score", *cells("blue"), dropped.alias("n_dropped"))


def write_wide(games: DataFrame, path: str, form: str = "csv") -> None:
    export_wide(games).drop("n_dropped").write.format(form).options(header=True).save(path)
