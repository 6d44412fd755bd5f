"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import checkpointed

#: Edges that a task takes; fewer tasks than shuffle partitions write fewer, larger files.
EDGES = 100_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, component_id): every linked id with the smallest id it reaches.

    Null ends and self links are dropped; ids without a link do not appear. Each
    round's edges are checkpointed, so a lost executor repeats one round at most,
    and the number of edges never grows. Minima are combined before they are
    shuffled, and a hub's join is left to Spark to split.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    now = before = (edges.count(),)
    for _ in range(max_rounds):
        tasks = -(-2 * now[0] // EDGES) or 1
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(roots.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
