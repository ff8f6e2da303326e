"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node that has a link to another; label is the least node of its component.

    Rounds of large stars and small stars (each one an aggregation and an equi-join on a node) turn the links into
    one star for each component; a node with very many links is split by adaptive execution like any skewed join key.
    Null ends and links of a node to itself count for nothing.
    """
    edges = stash(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    digest = _digest(edges)
    while digest[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(first.select("u", "m")).distinct()
        edges = stash(small)
        before, digest = digest, _digest(edges)
        if before == digest:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
