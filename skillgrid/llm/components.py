"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    out = both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    joined = edges.join(least, F.col("a") == F.col("c"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
        least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one ordered type).

    The root is the smallest node of the component and has no row of its own.
    Each round is written to the shared folder, so lineage stays short; the
    number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    a, b = links.columns
    edges = materialize(spark, links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
                        .distinct(), "links")
    while True:
        edges = materialize(spark, _small_star(_large_star(edges)), "stars")
        # done when no node is both below a root and a root, and none has two roots
        roots = edges.select(F.col("b").alias("r")).distinct()
        chained = edges.join(roots, F.col("a") == F.col("r"), "left_semi").isEmpty()
        if chained and edges.groupBy("a").count().where("count > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
