"""Data model: statements, pattern trees and errors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: A statement; the object is an IRI as well, for others are dropped when statements are loaded.
TRIPLES = T.StructType([T.StructField(c, T.StringType(), False) for c in "spo"])
#: A statement in codes; its order is (p, o, s).
CODED = T.StructType([T.StructField(c, T.LongType(), False) for c in "spo"])
DICTIONARY = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("freq", T.LongType(), False), T.StructField("code", T.LongType(), False)])

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


class QueryError(ValueError):
    """The text of a query can't be read."""


class UnsupportedQueryError(QueryError):
    """A query that is read but is not a single-variable tree pattern."""


@dataclass
class PatternNode:
    """A variable or constant of a pattern; its edge says `parent edge node`."""

    label: str
    defined: bool = False
    edge: str | None = None
    parent: PatternNode | None = None
    children: list[PatternNode] = field(default_factory=list)

    def attach(self, parent: PatternNode, prop: str) -> None:
        if self.parent is not None:
            raise UnsupportedQueryError(f"?{self.label} is the object of two patterns and the subject of others")
        self.parent, self.edge = parent, prop
        parent.children.append(self)

    @property
    def is_root(self) -> bool:
        return self.parent is None

    @property
    def height(self) -> int:
        return 1 + max((c.height for c in self.children), default=0)

    def walk(self) -> Iterator[PatternNode]:
        yield self
        for child in self.children:
            yield from child.walk()

    def order(self) -> None:
        """Puts bound leaves first, as they select most, then taller subtrees before shorter ones."""
        self.children.sort(key=lambda c: (not c.defined, -c.height))
        for child in self.children:
            child.order()

    def __str__(self) -> str:
        def lines(node: PatternNode, indent: str) -> Iterator[str]:
            edge = f"{node.edge} -> " if node.edge else ""
            yield indent + edge + (f"<{node.label}>" if node.defined else f"?{node.label}")
            for child in node.children:
                yield from lines(child, indent + "  ")

        return "\n".join(lines(self, ""))


@dataclass
class TreeQuery:
    """A query: the root of its pattern, the result's name, whether it counts, and all its triple patterns."""

    root: PatternNode
    variable: str
    is_count: bool = False
    patterns: list[tuple] = field(default_factory=list)
