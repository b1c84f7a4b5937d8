"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id in a link, roots included: the least id it is connected with.

    Links with a null end and from an id to itself don't count. Both stars only aggregate and join by id, so a hub's
    links are combined in the tasks and split by the join; the number of rounds grows with the logarithm of the
    longest path. Each round is written to the shared checkpoint folder."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before it is joined: the join is then between two shuffles, of which Spark parts the one with a hub.
        low = cut(_least(both).select("u", F.least("u", "least").alias("least")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = cut(_least(large))
        small = large.join(low, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut(small.union(low.select("u", F.col("least").alias("v"))).distinct())
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen.n, seen.s):
            break
        mark = (seen.n, seen.s)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
