"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def connected_components(links: DataFrame) -> DataFrame:
    """The component of every node of `links` (a, b: long, never null, any order, repeats allowed).

    Returns (node, root), root being the least node of the component, for each
    node that has a link to another one. Every round is written to the shared
    folder, and each shrinks the distance to the root at least as pointer
    jumping does, so the number of rounds grows with the logarithm of the
    longest chain. A hub's links are pre-aggregated (min) and joined, never gathered.
    """
    edges = stash(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        edges = stash(_small_star(_large_star(edges)), "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        before = after


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its own least neighbour."""
    return (
        edges.join(_least(edges), F.col("b") == F.col("node"), "left")
        .select("a", F.coalesce("least", "b").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself on the least of them."""
    own = edges.join(_least(edges), F.col("a") == F.col("node"))
    return own.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()
