"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patchloom.llm.tools import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    In each round every node moves to its smallest neighbour, or stays where it is
    smaller itself, and the links are drawn anew between the places. Of each component at
    most half the nodes remain, so rounds grow with the logarithm of its size.
    Only aggregates and joins by node are used; no component is gathered anywhere.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    edges = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    moves = []
    while not edges.isEmpty():
        move = stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "moves")
        moves.append(move)
        left = edges.join(move, "u").select("v", F.col("to").alias("nu"))
        right = move.select(F.col("u").alias("v"), F.col("to").alias("nv"))
        edges = stored(left.join(right, "v").filter("nu != nv").select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), "component")
        labels = move.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("component", "to").alias("component"))
    return stored(labels, "components")
