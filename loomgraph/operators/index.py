"""Levels and posting lists of the (p, o, s) order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.tables import parts_for, written


def ordered(triples: DataFrame) -> DataFrame:
    """All statements in (p, o, s) order."""
    return triples.repartitionByRange(parts_for(triples), "p", "o", "s").sortWithinPartitions("p", "o", "s")


def level_sizes(triples: DataFrame) -> DataFrame:
    """Entries of the three levels: predicates, objects of predicates, statements."""
    pairs = triples.groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"))
    by_p = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"))
    zero = F.lit(0)
    return by_p.agg(
        F.count(F.lit(1)).alias("predicates"),
        F.coalesce(F.sum("pairs"), zero).cast("long").alias("predicate_objects"),
        F.coalesce(F.sum("n"), zero).cast("long").alias("statements"),
    )


#: Statements in one value at most, on average in nested(): longer lists have several rows.
MOST = 1 << 18


def _long(triples: DataFrame, by: list[str], most: int) -> DataFrame:
    """The lists of more than `most` statements with their sizes; there are as many as the statements divided by `most` at most."""
    return triples.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)


def _parts(triples: DataFrame, by: list[str], spread: list[str], most: int) -> DataFrame:
    """triples with part: 0 for short lists, a hash of the spread columns for those of more than `most` statements."""
    long = _long(triples, by, most).select(*by, F.ceil(F.col("__n") / most).alias("__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")), F.lit(0).cast("long"))
    return triples.join(F.broadcast(long), by, "left").withColumn("part", part).drop("__parts")


def posting_lists(triples: DataFrame, most: int = MOST) -> DataFrame:
    """(p, o, part, subjects): the sorted subjects of each predicate and object, duplicates included.

    A list of more than `most` subjects has several parts from 1 on, which follow
    each other in the order of subjects; others are part 0. Numbers of parts have
    gaps.
    """
    rows = triples.select("s", "p", "o")
    long = written(_long(rows, ["p", "o"], most).select("p", "o"))
    gathered = lambda of: of.groupBy("p", "o", "part").agg(F.sort_array(F.collect_list("s")).alias("subjects"))
    short = gathered(rows.join(F.broadcast(long), ["p", "o"], "left_anti").withColumn("part", F.lit(0).cast("long")))
    if long.isEmpty():
        return short
    dealt = rows.join(F.broadcast(long), ["p", "o"], "left_semi").repartitionByRange(parts_for(rows), "p", "o", "s")
    placed = written(dealt.sortWithinPartitions("p", "o", "s").withColumn("__at", F.monotonically_increasing_id()))
    return short.unionAll(gathered(placed.select("s", "p", "o", (F.expr(f"__at DIV {most}") + 1).alias("part"))))


def posting_texts(triples: DataFrame, mark: str = ",", most: int = MOST) -> DataFrame:
    """(p, o, subjects): each list as one text; a long one is put together from the texts of its parts."""
    lists = posting_lists(triples, most).select("p", "o", "part", F.array_join("subjects", mark).alias("subjects"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "subjects"))), lambda x: x["subjects"])
    long = lists.where("part > 0").groupBy("p", "o").agg(F.array_join(texts, mark).alias("subjects"))
    return lists.where("part = 0").select("p", "o", "subjects").unionAll(long)


def nested(triples: DataFrame, most: int = MOST) -> DataFrame:
    """(p, part, objects): the three levels as nested arrays; a predicate of more than `most` statements has several parts, by object and list."""
    dealt = _parts(triples.select("s", "p", "o"), ["p", "o"], ["s"], most).withColumnRenamed("part", "list")
    dealt = _parts(dealt, ["p"], ["o", "list"], most)
    lists = dealt.groupBy("p", "part", "o", "list").agg(F.sort_array(F.collect_list("s")).alias("subjects"))
    return lists.groupBy("p", "part").agg(F.sort_array(F.collect_list(F.struct("o", "subjects"))).alias("objects"))
