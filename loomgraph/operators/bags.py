"""Bags of bindings as DataFrames of (id, m): m copies of id.

This factorised form never grows with multiplicities: unions of copies are
sums, conjunctions are joins with the smaller multiplicity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.tables import parts_for


def counted(rows: DataFrame, column: str = "id") -> DataFrame:
    """(id, m) of a bag given row by row."""
    return rows.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("m"))


#: Copies that are made from one array; larger multiplicities are cut into spans of so many.
SPAN = 1 << 16


def unfolded(rows: DataFrame, m: str) -> DataFrame:
    """Each row as often as its column m says, without m; no array grows with a multiplicity's copies."""
    spans = rows.where(F.col(m) > 0).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1, F.lit(SPAN).cast("long"))))
    spans = spans.withColumn("__n", F.least(F.lit(SPAN).cast("long"), F.col(m) - F.col("__from")).cast("int"))
    return spans.withColumn("__copy", F.explode(F.expr("array_repeat(true, __n)"))).drop("__copy", "__n", "__from", m)


def copies(bag: DataFrame) -> DataFrame:
    """The bag row by row."""
    return unfolded(bag, "m").select("id")


def intersect(bags: list[DataFrame], combine=F.least) -> DataFrame:
    """Bindings that all bags have; combine gives the multiplicity: the least, or a product."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("m", "n"), "id").select("id", combine(F.col("m"), F.col("n")).alias("m"))

    return reduce(two, bags)


def product(a: Column, b: Column) -> Column:
    return a * b


def subjects(triples: DataFrame, p, o=None) -> DataFrame:
    """Subjects of a predicate, or of a predicate and object, with multiplicities."""
    chosen = triples.where(F.col("p") == p)
    return counted(chosen if o is None else chosen.where(F.col("o") == o), "s")


def step_up(triples: DataFrame, p, candidates: DataFrame) -> DataFrame:
    """Subjects whose object is a candidate, once for each copy of it and each statement."""
    edges = triples.where(F.col("p") == p).select("s", F.col("o").alias("id"))
    return edges.join(candidates, "id").groupBy(F.col("s").alias("id")).agg(F.sum("m").alias("m"))


def total(bag: DataFrame) -> DataFrame:
    """Number of rows, 0 for an empty bag."""
    return bag.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n"))


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag intersection of row-by-row bags of any columns: the smaller multiplicity."""
    return a.intersectAll(b)


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of bags with the larger multiplicity of the two; an empty side changes nothing."""
    columns = a.columns
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = a.select(*columns, one.alias("__m"), none.alias("__n")).unionAll(b.select(*columns, none.alias("__m"), one.alias("__n")))
    # dealt before it is counted: counting where rows are read would keep all their values in memory for few that repeat
    dealt = rows.repartition(parts_for(rows), *columns)
    both = dealt.groupBy(*columns).agg(F.greatest(F.sum("__m"), F.sum("__n")).alias("__k"))
    return unfolded(both, "__k").select(*columns)


def merge_runs(runs: list[DataFrame], *by: str) -> DataFrame:
    """Sorted runs as one sorted run; duplicates stay."""
    return reduce(DataFrame.unionAll, runs).orderBy(*by)


def lookup(requests: DataFrame, triples: DataFrame) -> DataFrame:
    """For a batch of (p, o) requests, their subjects; requests without any give no rows."""
    return requests.join(triples, ["p", "o"]).select("p", "o", "s")


def exists(bag: DataFrame, value) -> DataFrame:
    """Whether a binding is in the bag: one row."""
    return bag.where(F.col("id") == value).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


