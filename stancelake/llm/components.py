"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node on the smallest neighbour it knows (large star),
then hangs smaller neighbours on each other (small star); depth shrinks
geometrically.  All state is a table of links; a round is two aggregates with
map-side combine and two equi-joins (a hub node is split by the skew join), and
ends in a written table.  Nothing is collected but one count and one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b."""
    return (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a > b").distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _print(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links(a long, b long)``.

    ``component`` is the smallest node reachable.  Null ends and self-links are
    ignored; repeated links count once; an empty table gives an empty result.
    """
    cur = staged(_oriented(links.filter("a is not null and b is not null")), name)
    seen = _print(cur)
    while seen[0]:
        cur = staged(_small_star(_large_star(cur)), name)
        now = _print(cur)
        if now == seen:
            break
        seen = now
    # a fixed point is a forest of depth one: every node hangs on its smallest
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
