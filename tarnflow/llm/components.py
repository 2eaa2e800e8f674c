"""Connected components of a link table, by rounds of star rewriting over shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import forget, meet_few, written

#: Rounds after which a run is taken to be at fault; a round halves long chains.
MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether links are stars: every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.union(edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    ends = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return ends.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("parent") > 0))).isEmpty()


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each larger neighbour of a node moves to the least of the node and its neighbours.

    Links may repeat: there are no more of them than of ``edges``, and the small star makes them distinct.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = meet_few(both, least, 2 * rows, ["a"]).where(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = meet_few(down, least, rows, ["a"])
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(``a``, ``b``): every node that has a link, except the least of its component, and that least node.

    ``edges`` has columns ``a`` and ``b`` of one comparable type; direction, repeats and loops do
    not matter.  Each round is written to the shared folder; only whether links have settled reaches
    the driver.  Minima are combined before the shuffle; they are sent to the links while these are few,
    and beyond that the joins may be split where a node has many links.  No edges: no rows.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        rows = edges.count()
        before, edges = edges, written(_small_star(_large_star(edges, rows), rows), "stars")
        forget(before)
        # a star's centre is its least node: both steps link to the least
        if _settled(edges):
            return edges
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
