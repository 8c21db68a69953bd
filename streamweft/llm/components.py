"""Connected components of an edge table by randomised contraction.

Each round every node points at the node of smallest hash among itself and its
neighbours (a partial aggregation, so a node with very many edges costs one row
a task), edges are relabelled and shrink by a constant factor.  Edges and
labels are tables in the shared folder; nothing is collected but their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (a, b: long, either order,
    repeats and loops allowed); component is the smallest node of the component."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    for round_ in range(max_rounds):
        if edges.isEmpty():
            break
        order = lambda c: F.xxhash64(F.col(c), F.lit(round_))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.select("a", order("b").alias("h"), "b").unionByName(both.select("a", order("a").alias("h"), F.col("a").alias("b")))
        step = materialise(near.groupBy("a").agg(F.min_by("b", "h").alias("to")), "step")
        # follow one more pointer, so that short chains close at once
        far = step.select(F.col("a").alias("to"), F.col("to").alias("far"))
        step = materialise(step.join(far, "to", "left").select("a", F.coalesce("far", "to").alias("to")), "step")
        moved = edges.join(step.select("a", F.col("to").alias("x")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        moved = moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        label = materialise(label.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        edges = materialise(moved, "edges")
    else:
        if not edges.isEmpty():
            raise RuntimeError("components did not settle")
    lowest = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(lowest, "root").select("node", "component")
