"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root of every node that has an edge (a, b); root is one node of its component.

    Each round points every node at its smallest neighbour and contracts the edges to the nodes
    pointed at, until no edge is left. A hub's edges are pre-aggregated (min), and every round is
    written to the shared folder. Rounds are logarithmic for stars and chains alike in practice.
    """
    edges = stored(edges.where("a != b").select("a", "b"), f"{label}-0")
    roots, i = None, 0
    while not edges.isEmpty():
        i += 1
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), f"{label}-parents-{i}")
        # a node's root may itself point further down: one jump
        jump = parent.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        parent = stored(parent.join(jump, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("end", "root").alias("root")), f"{label}-jumped-{i}")
        if roots is None:
            roots = parent
        else:
            step = parent.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            roots = stored(roots.join(step, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("end", "root").alias("root")), f"{label}-roots-{i}")
        pa, pb = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(pa, "a").join(pb, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{label}-{i}")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
