"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quietwire.llm.common import kept

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``edges`` (``a, b``).

    Nodes of any ordered type. Nulls don't link; repeated edges, either way round, and loops are
    allowed. Minima are aggregated before the shuffle and joined back, so that a node with any number of edges
    is never gathered; every round is written to the shared folder. Runs jobs.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    # An edge points from the larger node to the smaller.
    now = kept(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = _state(now)
    for _ in range(MOST_ROUNDS):
        # Large star: neighbours above a node link to the least node around it.
        around = now.union(now.select("b", "a"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # Small star: neighbours below a node, and itself, link to the least of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = kept(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "links")
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    return loops.join(roots, "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    mark = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())
