"""Command line: c builds dictionaries, l loads statements into a store, q serves queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomgraph.operators import dictionary
from loomgraph.server import PORT, serve
from loomgraph.sources import rdf
from loomgraph.sources.store import Store


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    c = verbs.add_parser("c", help="build the dictionaries of some files")
    c.add_argument("codes")
    c.add_argument("format", choices=rdf.FORMATS)
    c.add_argument("files", nargs="+")
    load = verbs.add_parser("l", help="load files, with dictionaries built before, into a store")
    load.add_argument("codes")
    load.add_argument("store")
    load.add_argument("format", choices=rdf.FORMATS)
    load.add_argument("files", nargs="+")
    load.add_argument("--dedupe", action="store_true")
    q = verbs.add_parser("q", help="serve a store")
    q.add_argument("store")
    q.add_argument("--port", type=int, default=PORT)
    q.add_argument("--semantics", default="reference", choices=("reference", "sparql"))
    q.add_argument("--lenient", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if given.verb == "c":
        triples = rdf.read(spark, given.files, given.format)
        dictionary.ranked(dictionary.subject_object_counts(triples)).write.parquet(f"{given.codes}/terms")
        dictionary.ranked(dictionary.predicate_counts(triples)).write.parquet(f"{given.codes}/predicates")
    elif given.verb == "l":
        triples = rdf.read(spark, given.files, given.format)
        terms, predicates = (spark.read.parquet(f"{given.codes}/{x}") for x in ("terms", "predicates"))
        Store(dictionary.encode(triples.distinct() if given.dedupe else triples, terms, predicates), terms, predicates).save(given.store)
    else:
        serve(Store.load(spark, given.store), given.port, semantics=given.semantics, lenient=given.lenient).serve_forever()


if __name__ == "__main__":
    main()
