"""Pattern queries against a brute-force evaluator, and what the parser refuses."""

import itertools
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.model import PatternNode, QueryError, UnsupportedQueryError
from loomgraph.plans import compiler, sparql

EDGES = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("pq"), st.sampled_from("abcd")), max_size=14)
QUERIES = [
    "SELECT ?x { ?x <p> <b> }",
    "SELECT ?x { ?x <p> ?y }",
    "SELECT ?x { ?x <p> ?y ; <q> ?z }",
    "SELECT ?x { ?x <p> ?y . ?y <q> ?z }",
    "SELECT ?x { ?x <p> ?y . ?y <q> <a> ; <p> ?z . ?x <q> ?w }",
]


def brute(triples: list, node: PatternNode, semantics: str) -> Counter:
    """The semantics of a pattern, statement by statement."""

    def above(child: PatternNode) -> Counter:
        weight = of(child) if child.children else None
        found: Counter = Counter()
        for s, p, o in triples:
            if p == child.edge and (not child.defined or o == child.label):
                found[s] += 1 if weight is None else weight[o]
        return found

    def of(n: PatternNode) -> Counter:
        parts = [above(c) for c in n.children]
        out = Counter()
        for x in parts[0]:
            m = parts[0][x]
            for other in parts[1:]:
                m = min(m, other[x]) if semantics == "reference" else m * other[x]
            out[x] = m
        return +out

    return of(node)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(EDGES, st.sampled_from(QUERIES), st.sampled_from(compiler.SEMANTICS))
def test_trees_match_brute_force(spark, edges, text, semantics):
    triples = spark.createDataFrame(edges, "s string, p string, o string")
    query = sparql.parse(text)
    got = Counter(r["x"] for r in compiler.answer(triples, query, semantics).collect())
    assert got == brute(edges, query.root, semantics)
    if semantics == "reference":
        assert Counter(r["id"] for r in compiler.literal_bindings(triples, query.root).collect()) == got


def test_count_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "s string, p string, o string")
    assert compiler.answer(empty, sparql.parse("SELECT (COUNT(?x) AS ?n) { ?x <p> ?y }")).collect()[0]["n"] == 0


def test_shared_variables_join_in_sparql_only(spark):
    rows = [("a", "p", "u"), ("a", "q", "u"), ("b", "p", "u"), ("b", "q", "v")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    query = sparql.parse("SELECT ?x { ?x <p> ?z ; <q> ?z }")
    assert sorted(r["x"] for r in compiler.answer(triples, query).collect()) == ["a", "b"]
    assert [r["x"] for r in compiler.answer(triples, query, "sparql").collect()] == ["a"]


def test_unconnected_patterns(spark):
    triples = spark.createDataFrame([("a", "p", "u"), ("b", "q", "v")], "s string, p string, o string")
    query = sparql.parse("SELECT ?x { ?x <p> ?y . ?z <q> ?w }")
    assert [r["x"] for r in compiler.answer(triples, query).collect()] == ["a"]
    with pytest.raises(UnsupportedQueryError):
        compiler.answer(triples, query, "sparql")


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("ASK { ?x a ?y }", "write a SELECT"),
        ("SELECT ?x ?y ?z { ?x a ?y }", "names 3 variables"),
        ("SELECT ?x ?y { ?x a ?y }", "names 2 variables"),
        ("SELECT (SUM(?x) AS ?n) { ?x a ?y }", "the head may hold COUNT alone"),
        ("SELECT (COUNT() AS ?n) { ?x a ?y }", "COUNT() counts nothing"),
        ("SELECT (COUNT(*) AS ?n) { ?x a ?y }", "COUNT takes one variable"),
        ("SELECT ?y { ?x a ?y }", "?y is the subject of no pattern"),
        ("SELECT ?x { ?x a ?y . ?y a ?x }", "?x is the object of a pattern"),
        ("SELECT ?x { ?x a ?x }", "?x is the object of a pattern"),
        ("SELECT ?x { <a> a ?x }", "subject must be a variable"),
        ("SELECT ?x { ?x ?p ?y }", "predicate must be an IRI"),
        ("SELECT ?x { ?x a ?y . ?z a ?y . ?y a <c> }", "object of two patterns"),
        ("SELECT ?x { ?x a ?v . ?y a ?z . ?z a ?y }", "cycle"),
        ("SELECT DISTINCT ?x { ?x a ?y }", "DISTINCT is not supported"),
        ("SELECT ?x { ?x a ?y FILTER(?y != <b>) }", "FILTER is not supported"),
        ("SELECT ?x { ?x a ?y } ORDER BY ?x", "ORDER is not supported"),
        ("SELECT (COUNT(DISTINCT ?x) AS ?n) { ?x a ?y }", "DISTINCT"),
    ],
)
def test_refused(text, message):
    with pytest.raises(UnsupportedQueryError, match=message.replace("?", r"\?").replace("(", r"\(").replace(")", r"\)")):
        sparql.parse(text)


@pytest.mark.parametrize("text", ["", "SELECT ?x {", "SELECT ?x { ?x }", "SELECT ?x { ?x <p> <b> } }", "SELECT ?x { ?x u:p ?y }", "SELECT ?x { ?x ~ ?y }"])
def test_unreadable(text):
    with pytest.raises(QueryError):
        sparql.parse(text)


def test_syntax():
    query = sparql.parse(
        """PREFIX t: <http://e/#>  # a comment
        BASE <http://b/>
        select (count(?x) as ?n) where { ?x t:a ?c ; t:b <r> , t:c.d ; a "lit"@en . ?c t:e "1"^^t:int , 5 . }"""
    )
    assert (query.variable, query.is_count, query.root.label, query.root.height) == ("n", True, "x", 3)
    edges = Counter((c.edge, c.label) for c in query.root.children)
    assert edges == Counter([("http://e/#a", "c"), ("http://e/#b", "http://b/r"), ("http://e/#b", "http://e/#c.d"), (sparql.RDF_TYPE, "lit")])
    assert "?x" in str(query.root)


def test_lenient_ignores_what_it_cannot_do():
    query = sparql.parse("SELECT DISTINCT ?y ?x { ?x <p> ?y OPTIONAL { ?x <q> <c> } FILTER(?y > 3) } ORDER BY ?x LIMIT 3", lenient=True)
    assert query.variable == "x"
    assert {c.edge for c in query.root.children} == {"p", "q"}


def test_bound_leaves_and_tall_subtrees_come_first():
    query = sparql.parse("SELECT ?x { ?x <p> ?a . ?x <q> ?y . ?y <p> ?z . ?x <q> <c> }")
    assert [c.label for c in query.root.children] == ["c", "y", "a"]


def test_all_trees_of_two_leaves_agree(spark):
    rows = [*itertools.product("ab", "pq", "cd"), ("a", "p", "c"), ("a", "p", "c")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    query = sparql.parse("SELECT ?x { ?x <p> ?y ; <q> ?z }")
    assert Counter(r["x"] for r in compiler.answer(triples, query).collect()) == Counter(a=2, b=2)
    assert Counter(r["x"] for r in compiler.answer(triples, query, "sparql").collect()) == Counter(a=8, b=4)


SHARED = [
    "SELECT ?x { ?x <p> ?z ; <q> ?z }",
    "SELECT ?x { ?x <p> ?z ; <q> ?w . ?x <p> ?z }",
    "SELECT ?x { ?x <p> ?y ; <q> ?z . ?y <p> ?z }",
]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(EDGES, st.sampled_from(SHARED))
def test_shared_variables_match_brute_force(spark, edges, text):
    query, expected = sparql.parse(text), Counter()
    for rows in itertools.product(edges, repeat=len(query.patterns)):
        bound, good = {}, True
        for (s, p, o), (subject, edge, obj) in zip(rows, query.patterns, strict=True):
            good = good and p == edge and bound.setdefault(subject[1], s) == s and bound.setdefault(obj[1], o) == o
        if good:
            expected[bound["x"]] += 1
    triples = spark.createDataFrame(edges, "s string, p string, o string")
    assert Counter(r["x"] for r in compiler.answer(triples, query, "sparql").collect()) == +expected
