"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge; component = smallest node.

    Nodes may be any orderable type.  A node is reduced with a pre-aggregated
    ``min`` and joined back, so a hub is never collected into one row.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        e = cut(small)
        sig = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sig == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = sig


def label_components(nodes: DataFrame, edges: DataFrame, node: Column, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes with their ``component``; a node without edges is its own component."""
    cc = connected_components(edges, a, b)
    return (
        nodes.withColumn("_node", node)
        .join(cc.select(F.col("node").alias("_node"), "component"), "_node", "left")
        .withColumn("component", F.coalesce("component", "_node"))
        .drop("_node")
    )


def grid_edges(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Face-adjacent pairs of occupied cells as struct nodes ``a``, ``b``."""
    node = F.struct(*keys, *axes)
    steps = [[1 if i == j else 0 for j in range(len(axes))] for i in range(len(axes))]
    moved = cells.select(*keys, *axes, node.alias("a")).select(
        "a",
        *keys,
        F.explode(
            F.array(*[F.struct(*[(F.col(x) + s).alias(x) for x, s in zip(axes, st)]) for st in steps])
        ).alias("_to"),
    )
    moved = moved.select("a", *keys, *[F.col("_to")[x].alias(x) for x in axes])
    return moved.join(cells.select(*keys, *axes).distinct(), keys + axes).select("a", node.alias("b"))


def grid_components(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Cells with the component of face-adjacent occupied cells."""
    return label_components(cells, grid_edges(cells, keys, axes), F.struct(*keys, *axes))
