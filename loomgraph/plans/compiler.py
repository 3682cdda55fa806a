"""Pattern trees to lazy DataFrames.

Semantics `reference`: branches of a variable meet with the smaller
multiplicity, and a variable that is only an object is fresh wherever it
stands. Semantics `sparql`: multiplicities multiply and shared variables join.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PatternNode, TreeQuery, UnsupportedQueryError
from loomgraph.operators import bags

SEMANTICS = ("reference", "sparql")


def bindings(triples: DataFrame, root: PatternNode, semantics: str = "reference") -> DataFrame:
    """(id, m) of the root variable."""
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    combine = F.least if semantics == "reference" else bags.product

    def of_node(node: PatternNode) -> DataFrame:
        return bags.intersect([of_edge(child) for child in node.children], combine)

    def of_edge(node: PatternNode) -> DataFrame:
        if node.children:
            return bags.step_up(triples, node.edge, of_node(node))
        return bags.subjects(triples, node.edge, node.label if node.defined else None)

    return of_node(root)


def literal_bindings(triples: DataFrame, root: PatternNode) -> DataFrame:
    """The root's bag row by row with INTERSECT ALL, column id: the plain form of `reference`."""

    def of_node(node: PatternNode) -> DataFrame:
        found = [of_edge(child) for child in node.children]
        out = found[0]
        for more in found[1:]:
            out = bags.intersect_rows(out, more)
        return out

    def of_edge(node: PatternNode) -> DataFrame:
        edges = triples.where(F.col("p") == node.edge)
        if node.children:
            return edges.join(of_node(node), edges["o"] == F.col("id")).select(F.col("s").alias("id"))
        return (edges.where(F.col("o") == node.label) if node.defined else edges).select(F.col("s").alias("id"))

    return of_node(root)


def shared_objects(query: TreeQuery) -> bool:
    """Whether a variable that is never a subject is an object twice."""
    subjects = {s for s, _, _ in query.patterns}
    objects = Counter(o for _, _, o in query.patterns if o[0] == "var" and o not in subjects)
    return any(n > 1 for n in objects.values())


def joined(triples: DataFrame, query: TreeQuery) -> DataFrame:
    """(id, m) by joins of all patterns, for variables that are shared otherwise than in a tree.

    Each pattern is counted before it is joined, and a variable that neither the
    rest of the patterns nor the root needs is summed away at once.
    """
    root, rest, out = f"v_{query.root.label}", list(query.patterns), None

    def variables(pattern: tuple) -> set[str]:
        return {f"v_{k}" for kind, k in (pattern[0], pattern[2]) if kind == "var"}

    while rest:
        known = set(out.columns) - {"m"} if out is not None else set()
        pattern = next((x for x in rest if out is None or variables(x) & known), None)
        if pattern is None:
            raise UnsupportedQueryError("Patterns are not connected")
        rest.remove(pattern)
        needed = {root}.union(*map(variables, rest))
        (_, s), p, (kind, o) = pattern
        rows = triples.where(F.col("p") == p).select(F.col("s").alias(f"v_{s}"), F.col("o").alias("__o"))
        if kind == "const":
            rows = rows.where(F.col("__o") == o)
        elif s == o:
            rows = rows.where(F.col(f"v_{s}") == F.col("__o"))
        else:
            rows = rows.withColumnRenamed("__o", f"v_{o}")
        by = sorted(variables(pattern) & (needed | known))
        rows = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        if out is None:
            out = rows.withColumnRenamed("n", "m")
        else:
            out = out.join(rows, sorted(known & set(by))).withColumn("m", F.col("m") * F.col("n")).drop("n")
        if more := set(out.columns) - {"m"} - needed:
            out = out.groupBy(*sorted(set(out.columns) - {"m"} - more)).agg(F.sum("m").alias("m"))
    return out.select(F.col(root).alias("id"), "m")


def connected(query: TreeQuery) -> bool:
    """Whether every pattern hangs together with the root."""
    reached, before = {query.root.label}, 0
    while len(reached) > before:
        before = len(reached)
        for (_, s), _, (kind, o) in query.patterns:
            if kind == "var" and {s, o} & reached:
                reached |= {s, o}
    return all(s in reached for (_, s), _, _ in query.patterns)


def answer(triples: DataFrame, query: TreeQuery, semantics: str = "reference") -> DataFrame:
    """The query's result: one column, named as its head names it."""
    if semantics == "sparql" and not connected(query):
        raise UnsupportedQueryError("Patterns are not connected")
    bag = joined(triples, query) if semantics == "sparql" and shared_objects(query) else bindings(triples, query.root, semantics)
    if query.is_count:
        return bags.total(bag).withColumnRenamed("n", query.variable)
    return bags.copies(bag).withColumnRenamed("id", query.variable)
