"""Connected components of a table of links, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): (node, component), the smallest node reachable; nodes without links are not there.

    In each round every tree's root hooks onto the smallest root next to its
    tree, hooks are followed to their ends by pointer jumping, and links become
    links between the roots that are left, until there are none. A root that is
    smaller than all next to it and that nothing hooks onto has a smaller one
    next to it one round later, so two rounds at least halve the roots that
    still have links. Hooks lead to smaller nodes, so a component ends at its
    smallest. Tables are written to the shared folder, which cuts the lineage.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = None
    while True:
        # links of hubs are summed before they are shuffled
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("to"))
        ends = _ends(written(least))
        merged = ends if labels is None else written(_followed(labels.withColumnsRenamed({"node": "root", "component": "to"}), ends))
        left = written(_renumbered(_renumbered(both, ends, "a"), ends, "b").where("a != b").distinct())
        forget(both, *([] if labels is None else [labels, ends]))
        both, labels = left, merged.withColumnsRenamed({"root": "node", "to": "component"})
        if left.isEmpty():
            return labels


def _followed(hooks: DataFrame, by: DataFrame) -> DataFrame:
    """Of (root, to): to replaced by where it leads."""
    return hooks.join(by.select(F.col("root").alias("to"), F.col("to").alias("next")), "to", "left").select("root", F.coalesce("next", "to").alias("to"))


def _ends(hooks: DataFrame) -> DataFrame:
    """Of (root, to), to itself for roots that stay: (root, to), to the end of the chain; to goes twice as far each time."""
    while True:
        new = written(_followed(hooks, hooks).join(hooks.withColumnRenamed("to", "before"), "root"))
        moved = not new.where("to != before").isEmpty()
        forget(hooks)
        hooks = new.drop("before")
        if not moved:
            return hooks


def _renumbered(both: DataFrame, ends: DataFrame, side: str) -> DataFrame:
    return both.join(ends.withColumnsRenamed({"root": side, "to": "end"}), side).drop(side).withColumnRenamed("end", side).select("a", "b")
