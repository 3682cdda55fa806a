"""The statement store: two dictionaries and the coded statements, as Parquet.

Statements are partitioned by predicate, and in a partition range-partitioned
and sorted by (o, s), so a lookup by predicate and object reads one directory
and, by row-group statistics, few row groups of it. A predicate with a third of
all statements is spread over as many files as its share asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import CODED, DICTIONARY, PatternNode, TreeQuery
from loomgraph.operators import bags, dictionary
from loomgraph.plans import compiler, sparql
from loomgraph.tables import parts_for, written

#: With more predicates than this, statements are only range-partitioned: a directory each would be too many.
MOST_DIRECTORIES = 1000


@dataclass
class Store:
    """Coded statements with their dictionaries."""

    triples: DataFrame
    terms: DataFrame
    predicates: DataFrame

    @classmethod
    def build(cls, triples: DataFrame, dedupe: bool = False) -> Store:
        """A store of (s, p, o) terms; dedupe keeps one copy of each statement.

        Its three tables are written to the shared folder, so queries neither rank nor encode again.
        """
        given = triples.select("s", "p", "o")
        if dedupe:
            given = given.distinct()
        terms = dictionary.ranked(dictionary.subject_object_counts(given))
        predicates = dictionary.ranked(dictionary.predicate_counts(given))
        return cls(written(dictionary.encode(given, terms, predicates)), terms, predicates)

    def save(self, path: str, mode: str = "error") -> None:
        self.terms.write.mode(mode).parquet(f"{path}/terms")
        self.predicates.write.mode(mode).parquet(f"{path}/predicates")
        rows = self.triples.repartitionByRange(parts_for(self.triples), "p", "o", "s").sortWithinPartitions("p", "o", "s").write.mode(mode)
        many = self.predicates.count() > MOST_DIRECTORIES
        (rows if many else rows.partitionBy("p")).parquet(f"{path}/triples")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        read = spark.read
        return cls(read.schema(CODED).parquet(f"{path}/triples"), spark.read.schema(DICTIONARY).parquet(f"{path}/terms"), spark.read.schema(DICTIONARY).parquet(f"{path}/predicates"))

    def decoded(self) -> DataFrame:
        """The statements as terms."""
        return dictionary.decoded(self.triples, self.terms, self.predicates)

    def merge(self, other: Store) -> Store:
        """Both stores' statements, each as often as the store that has it more often."""
        return Store.build(bags.union_rows(self.decoded(), other.decoded()))

    def _coded(self, query: TreeQuery) -> TreeQuery:
        """The query with constants and predicates as codes, looked up at once; unknown ones match nothing."""
        nodes = list(query.root.walk())
        constants = {n.label for n in nodes if n.defined} | {o for _, _, (kind, o) in query.patterns if kind == "const"}
        edges = {n.edge for n in nodes if n.edge} | {p for _, p, _ in query.patterns}
        found = {r["term"]: r["code"] for r in self.terms.where(F.col("term").isin(*constants)).collect()} if constants else {}
        known = {r["term"]: r["code"] for r in self.predicates.where(F.col("term").isin(*edges)).collect()} if edges else {}

        def copy(node: PatternNode) -> PatternNode:
            made = PatternNode(found.get(node.label, -1) if node.defined else node.label, node.defined)
            for child in node.children:
                copy(child).attach(made, known.get(child.edge, -1))
            return made

        patterns = [(s, known.get(p, -1), (k, found.get(o, -1) if k == "const" else o)) for s, p, (k, o) in query.patterns]
        return TreeQuery(copy(query.root), query.variable, query.is_count, patterns)

    def query(self, text: str, semantics: str = "reference", lenient: bool = False) -> DataFrame:
        """The answer to a query: terms in one column, or a count; decoded last."""
        coded = self._coded(sparql.parse(text, lenient))
        out = compiler.answer(self.triples, coded, semantics)
        return out if coded.is_count else dictionary.decode(out, self.terms, coded.variable)
