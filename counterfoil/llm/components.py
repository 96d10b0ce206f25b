"""Connected components of an edge table: every node gets the smallest node it can reach.

Each round hooks a node to its smallest neighbour if that is smaller, follows the hooks to their
roots by pointer jumping, and contracts the edges. Contracted edges shrink from round to round, and
every step is a grouped minimum or a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of the edges (a long, b long); loops and repeated edges do no harm."""
    left = stored(_tidy(edges.select("a", "b")))
    labels = None
    while not left.isEmpty():
        roots = _roots(left)
        labels = roots if labels is None else _follow(labels, roots)
        ends = left.join(_named(roots, "a", "_a"), "a").join(_named(roots, "b", "_b"), "b")
        left = stored(_tidy(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return stored(labels)


def _tidy(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.filter("a != b").select(low, high).distinct()


def _named(labels: DataFrame, node: str, component: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("component").alias(component))


def _roots(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    hooks = both.groupBy("a").agg(F.min("b").alias("least"))
    hooks = stored(hooks.select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        jumped = hooks.join(_named(hooks, "component", "root"), "component")
        jumped = stored(jumped.select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")))
        hooks = jumped.select("node", "component")
        if jumped.filter("moved").isEmpty():
            return hooks


def _follow(labels: DataFrame, roots: DataFrame) -> DataFrame:
    further = labels.join(_named(roots, "component", "root"), "component", "left")
    return stored(further.select("node", F.coalesce("root", "component").alias("component")))
