"""Connected components by alternating large-star and small-star contraction.

All state lives in tables of two longs: no links or labels reach the driver
(only a count and a checksum a round). A hub with very many links is one row of
the minimum table; that table is broadcast when it is small and joined by
shuffle from written tables otherwise, where adaptive execution can split the
hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.tables import counted, materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs to (node, root): root is the component's smallest node.

    Nodes without a link to another node are not returned; self links and
    repeated links are ignored, nulls too.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _signature(stars)
    # the contraction settles in a number of rounds about logarithmic in the links
    while before[0]:
        stars = _small(_large(stars))
        after = _signature(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _large(stars: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the least of the node and its neighbours."""
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = counted(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")


def _small(stars: DataFrame) -> DataFrame:
    """A node and all its neighbours below it link to the least of them."""
    least = counted(stars.groupBy("a").agg(F.min("b").alias("m")), "least")
    below = stars.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialise(below.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
