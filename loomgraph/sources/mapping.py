"""Direct mapping of the star-schema tables to statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: predicate -> edges: table, subject prefix and column, object prefix and column.
EDGES = {
    "inRegion": [("nation", "nation", "n_nationkey", "region", "n_regionkey")],
    "ofNation": [("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")],
    "segment": [("customer", "customer", "c_custkey", "segment", "c_mktsegment")],
    "placedBy": [("orders", "order", "o_orderkey", "customer", "o_custkey")],
    "priority": [("orders", "order", "o_orderkey", "priority", "o_orderpriority")],
    "brand": [("part", "part", "p_partkey", "brand", "p_brand")],
    "hasPart": [("lineitem", "order", "l_orderkey", "part", "l_partkey")],
    "suppliedBy": [("lineitem", "order", "l_orderkey", "supplier", "l_suppkey")],
}


def iri(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/"), key.cast("string"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) of all edges; a filter on p keeps only its tables in the plan."""
    parts = []
    for p, edges in EDGES.items():
        for table, sp, s, op, o in edges:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            parts.append(rows.select(iri(sp, F.col(s)).alias("s"), F.lit(p).alias("p"), iri(op, F.col(o)).alias("o")))
    return reduce(DataFrame.unionAll, parts)


def mapping_sql() -> str:
    """The same statements as DuckDB SQL."""
    return " UNION ALL ".join(
        f"SELECT '{sp}/' || CAST({s} AS VARCHAR) AS s, '{p}' AS p, '{op}/' || CAST({o} AS VARCHAR) AS o FROM {table}"
        for p, edges in EDGES.items()
        for table, sp, s, op, o in edges
    )
