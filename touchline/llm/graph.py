"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .select import join_counted


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), for the nodes that have a link to another.

    Large-star and small-star steps in turn: each hangs a node's neighbours under the smallest node
    it knows, until every node hangs under the smallest of its component and a round changes no edge.
    Each round is written to the shared folder; only counts and two 64-bit folds come to the driver.
    """
    spark = links.sparkSession
    edges = materialize(_oriented(links.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    before = None
    while True:
        folds = [F.bit_xor(F.xxhash64(*order)).alias(f"fold{i}") for i, order in enumerate((("child", "parent"), ("parent", "child")))]
        state = edges.agg(F.count(F.lit(1)).alias("n"), *folds).first()
        if state == before or not state["n"]:
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
                edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
            )
        before = state
        starred = materialize(_large_star(edges, state["n"]))
        following = materialize(_small_star(starred, state["n"]))
        discard(spark, edges, starred)
        edges = following


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("child"), F.least("x", "y").alias("parent")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of each node go under its smallest neighbour or itself."""
    around = edges.select(F.explode(F.array(F.struct(F.col("child").alias("u"), F.col("parent").alias("v")), F.struct(F.col("parent").alias("u"), F.col("child").alias("v")))).alias("e")).select("e.u", "e.v")
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows")).filter("rows > 0").select("u", F.least("u", "m").alias("m"), "rows")
    return join_counted(around.filter("v > u"), least, "u", "rows", n).select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Smaller neighbours of each node, and the node, go under the smallest of them."""
    least = edges.groupBy("child").agg(F.min("parent").alias("m"), F.count(F.lit(1)).alias("rows"))
    moved = join_counted(edges, least, "child", "rows", n).filter("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.unionByName(least.select("child", F.col("m").alias("parent"))).distinct()
