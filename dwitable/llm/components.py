"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.session import materialise


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest reachable node of every node that has a link: ``(node, component)``, both as the links' type.

    Two moves alternate until nothing changes. First every node's larger neighbours are tied to the smallest node around
    it, then every node and its smaller neighbours are. Both keep what is connected, and each pair of moves shortens paths
    as pointer jumping does, so a chain of n nodes takes about log n rounds. A round is a grouped minimum, which is
    pre-aggregated, and a join on the node, whose hot keys Spark splits; no node's neighbours are gathered in a list.
    Rounds are written to the shared folder, which cuts the lineage. Self links, repeated links, NULL ends and an empty
    table are allowed; a node with only self links is left out.
    """
    known = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    current = materialise(_distinct(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = materialise(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = materialise(_distinct(small.unionByName(least.select("a", F.col("m").alias("b")))), "links")
        new = _state(following)
        current, done, state = following, new == state, new
        if done:
            break
    tied = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
