"""Answers as SPARQL-results XML."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.codec import xml_text

# Fixed values of the format.
HEAD = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head><variable name="{}"/></head>\n<results>\n'
TAIL = "</results>\n</sparql>\n"
INTEGER = "http://www.w3.org/2001/XMLSchema#integer"


def rows(answer: DataFrame) -> DataFrame:
    """A result element for each row of an answer, made by the executors: column xml."""
    name = answer.columns[0]
    value = F.col(f"`{name}`")
    if dict(answer.dtypes)[name] == "bigint":
        inner = F.concat(F.lit(f'<literal datatype="{INTEGER}">'), value.cast("string"), F.lit("</literal>"))
    else:
        inner = F.concat(F.lit("<uri>"), xml_text(value), F.lit("</uri>"))
    return answer.select(F.concat(F.lit(f'<result><binding name="{escape(name)}">'), inner, F.lit("</binding></result>")).alias("xml"))


def document(answer: DataFrame) -> DataFrame:
    """The document as rows (place, xml): 0 is what comes first, 1 the result elements in any order, 2 what comes last."""
    spark = answer.sparkSession
    ends = spark.createDataFrame([(0, HEAD.format(escape(answer.columns[0]))), (2, TAIL)], "place int, xml string")
    return ends.unionByName(rows(answer).select(F.lit(1).alias("place"), "xml"))


def to_xml(answer: DataFrame) -> Iterator[str]:
    """The document in pieces; rows come one partition at a time."""
    yield HEAD.format(escape(answer.columns[0]))
    for row in rows(answer).toLocalIterator():
        yield row["xml"] + "\n"
    yield TAIL
