"""Trees in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.sources.checkpoints import cut_lineage


def tree_depths(nodes: DataFrame, *, node: str = "id", parent: str = "parent") -> DataFrame:
    """(node, ``depth``) of nodes that hang on a root, whose parent is null; of a node's rows a root's
    counts, else the one with the least parent.

    In each round a node looks twice as far up, so rounds grow with the logarithm of the depth.  A node
    whose ancestors form a loop, or are not all in the table, hangs on no root and is left out; null
    nodes are none.  Rounds are joins by node: nothing is gathered.  An empty table gives no rows.
    """
    one = nodes.where(F.col(node).isNotNull()).groupBy(node).agg(F.max(F.col(parent).isNull()).alias("top"), F.min(parent).alias("up"))
    # ``up``: an ancestor ``steps`` above, null if the root is
    rows = one.select(F.col(node).alias("n"), F.when(~F.col("top"), F.col("up")).alias("up"), F.when(F.col("top"), 0).otherwise(1).cast("long").alias("steps"))
    rows = cut_lineage(rows)
    count, reach = rows.count(), 1
    while reach <= count and not rows.where("up is not null").isEmpty():
        above = rows.select(F.col("n").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        found = rows.join(above, "up", "left").where(F.col("up").isNull() | F.col("more").isNotNull())
        rows = cut_lineage(found.select("n", F.col("far").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        reach *= 2
    return rows.where("up is null").select(F.col("n").alias(node), F.col("steps").cast("int").alias("depth"))
