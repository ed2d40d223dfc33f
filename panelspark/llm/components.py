"""Connected components of a graph that is itself distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import frozen


def _to_roots(parents: DataFrame) -> DataFrame:
    """(v, p) with each p replaced by the root of its tree, by doubling the steps taken."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("up"))
        stepped = frozen(parents.join(up, "p", "left").select("v", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")))
        parents = stepped.select("v", "p")
        if stepped.where("moved").isEmpty():
            return parents


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, c): each vertex with the smallest vertex of its component.

    ``vertices`` has v, ``edges`` has a and b. In a round each vertex points to its smallest neighbour if
    that is smaller, the trees this gives become one vertex each, and edges inside them go; so a dense
    group is gone after the first round or two and is not carried through the others. Rounds are joins
    and partial aggregations; edges are frozen after each.
    """
    labels = vertices.select("v", F.col("v").alias("c"))
    left = frozen(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        parents = left.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        roots = _to_roots(parents)
        labels = labels.join(roots.withColumnRenamed("v", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c"))
        ends = left.join(roots.withColumnRenamed("v", "a"), "a").select(F.col("p").alias("a"), "b")
        ends = ends.join(roots.select(F.col("v").alias("b"), "p"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        left = frozen(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return frozen(labels)
