"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import stage, unstage


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One step: each node hands its larger (or, in a small step, its smaller) neighbours to its smallest one.

    Minima are pre-aggregated per task, so a hub costs one row per task there; the join back is one that AQE
    may split when a hub holds a large share of the links.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of edges (a, b), component being the smallest id reachable.

    Nodes without a link (none, or only to themselves) are absent; nulls in either column are no links;
    repeated links count once; an empty table gives an empty table. Rounds end when a round leaves the links
    as they are; they grow with the logarithm of a component's diameter.
    """
    spark = edges.sparkSession
    links = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        before = links
        links = stage(_star(_star(links, large=True), large=False), "links")
        unstage(spark, before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
