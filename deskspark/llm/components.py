"""Connected components of link tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.spread import attach, merged
from deskspark.sources.scratch import freeze


def _stars(pairs: DataFrame) -> DataFrame:
    """(node, other) plus the least neighbour of each node, itself included, and its number of pairs."""
    least = freeze(
        pairs.groupBy("node").agg(
            F.least(F.min("other"), F.first("node")).alias("least"), F.count(F.lit(1)).alias("n")
        )
    )
    return attach(pairs, least, "node", "n", "other", "inner", merge=True)


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node; ``links`` has two bigint columns.

    The component is the least node that can be reached. Each step sends all
    pairs of a node to its least neighbour, so that every tree becomes a star;
    the number of steps grows with the logarithm of the number of nodes. Links
    of hot nodes are spread by :func:`attach`; nothing is collected, and only hot nodes are broadcast.
    """
    a, b = links.columns
    edges = freeze(
        links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).where("node <> other").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = freeze(
            _stars(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        )
        stars = _stars(large)
        small = stars.select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.col("least").alias("other")),
                    F.struct(F.col("other").alias("node"), F.col("least").alias("other")),
                )
            ).alias("e")
        ).select("e.*")
        edges = freeze(small.where("node <> other").distinct())
        # Stars: every node has one pair and no centre is a node itself.
        roots = edges.select(F.col("other").alias("node")).distinct()
        chained = edges.join(merged(roots), "node", "left_semi")
        if chained.isEmpty() and edges.groupBy("node").count().where("count > 1").isEmpty():
            break
    centre = edges.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    return edges.select("node", F.col("other").alias("component")).unionByName(centre)
