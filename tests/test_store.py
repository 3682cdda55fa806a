"""RDF files, the store, results, the endpoint, the command line and streaming."""

import threading
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from loomgraph import __main__ as cli
from loomgraph.results import to_xml
from loomgraph.server import serve
from loomgraph.sources import rdf
from loomgraph.sources.store import Store
from loomgraph.streaming.ingest import MergedStatements, stream_ntriples

NT = r"""<http://e/a> <http://e/p> <http://e/b> .
<http://e/a> <http://e/p> "plain" .
<http://e/a> <http://e/p> "tag"@en-GB .
<http://e/a> <http://e/p> "3"^^<http://www.w3.org/2001/XMLSchema#int> .
<http://e/a> <http://e/p> _:x .
_:x <http://e/p> <http://e/b> .
# <http://e/no> <http://e/p> <http://e/no> .

<http://e/a> <http://e/p> "a \"quote\" and <http://e/c> . " .
<http://e/c> <http://e/q> <http://e/café> . # after
<http://e/a> <http://e/p> <http://e/b> .
"""
TTL = """@prefix e: <http://e/> . @base <http://e/> .
e:a e:p e:b , "x"@en , 3.5 ; e:q <c> . PREFIX f: <http://f/>
f:x a e:T ; e:p [ e:q e:d ] . [] e:p e:b . e:l e:p ( e:a "y" ) . e:m e:p true .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://e/doc">
<e:T rdf:about="http://e/a" e:label="text"><e:p rdf:resource="#b"/><e:q>literal</e:q><e:r><e:U rdf:ID="u"/></e:r></e:T>
<rdf:Description rdf:nodeID="n"><e:p rdf:resource="http://e/c"/></rdf:Description>
<rdf:Description rdf:about="http://e/z"><e:p rdf:nodeID="n"/><e:s rdf:parseType="Resource"><e:p rdf:resource="http://e/c"/></e:s></rdf:Description></rdf:RDF>"""


def rows(df):
    return Counter(tuple(r) for r in df.select("s", "p", "o").collect())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("rdf")
    (d / "a.nt").write_text(NT)
    (d / "a.ttl").write_text(TTL)
    (d / "a.owl").write_text(XML)
    (d / "b.txt").write_text("nothing")
    return d


def test_ntriples_keeps_statements_of_iris(spark, files):
    assert rows(rdf.read(spark, f"{files}/a.nt", "ntriples")) == Counter({("http://e/a", "http://e/p", "http://e/b"): 2, ("http://e/c", "http://e/q", "http://e/café"): 1})
    kinds = {(r["s_kind"], r["o_kind"]): r["n"] for r in rdf.by_kind(rdf.statements(spark, f"{files}/a.nt", "ntriples")).collect()}
    assert kinds == {("iri", "iri"): 3, ("iri", "literal"): 4, ("iri", "blank"): 1, ("blank", "iri"): 1}


ODD = ["<u:a> <u:p> <u:b> .", "<u:a> <u:p> <u:b>  .", "<u:a><u:p><u:b>.", " <u:a> <u:p> <u:b> .", "<u:a> <u:p> <u:b> . # <x> .", "<u:a> <u:p> <u:b> . x", "<> <> <> .", "<u:a> <u:p> <u:b> <u:g>", "<u:a> u:p <u:b> .",
       "<u:\\u0041> <u:p> <u:b> .", "<u:a> <u:p> \"<u:b> .", "<u:a> <u:p> \"> <u:b> .\" .", "<u:a> <u:p <u:b> .", "<u:a> <u:p> <u:b> <u:g> .", "<u:a> <u:p> <u:b> <u:g> . # c", "<u:a> <u:p> <u:b> <u:g> <u:h> .", "<u:a> <u:p> <u:b> _:g .", "_:a <u:p> <u:b> .", "", None]


@pytest.mark.parametrize("graphs", [False, True])
def test_cut_lines_as_the_whole_form_matches_them(spark, graphs):
    import re

    found, form = Counter(), re.compile(rdf._QUAD if graphs else rdf._LINE)
    for m in filter(None, (form.match(x) for x in ODD if x)):
        found[tuple(re.sub(r"\\u([0-9A-F]{4})", lambda n: chr(int(n[1], 16)), x[1:-1]) if x.startswith("<") else x for x in m.groups())] += 1
    assert rows(rdf.parse_lines(spark.createDataFrame([(x,) for x in ODD], "value string"), graphs)) == found


def test_lines_are_cut_once(spark):
    """Conditions on the kinds stay above the projection that cuts a line."""
    for graphs in (False, True):
        parsed = rdf.parse_lines(spark.range(3).select(F.format_string("<u:%s> <u:p> <u:o> .", F.col("id").cast("string")).alias("value")), graphs)
        plan = parsed.where("s_kind = 'iri' AND o_kind = 'iri'").select("s", "p", "o")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == 1


def test_turtle(spark, files):
    got = rows(rdf.read(spark, f"{files}/a.ttl", "turtle"))
    assert got == Counter([("http://e/a", "http://e/p", "http://e/b"), ("http://e/a", "http://e/q", "http://e/c"), ("http://f/x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T")])


def test_trig_and_nquads(spark, files, tmp_path):
    (tmp_path / "a.trig").write_text("@prefix e: <http://e/> .\n{ e:a e:p e:b . e:c e:p e:d } e:g { e:a e:p e:b ; e:q e:c } GRAPH <http://e/h> { e:z e:p e:y . } e:k e:p e:l .")
    e = lambda *x: tuple(f"http://e/{y}" for y in x)
    assert rows(rdf.read(spark, f"{tmp_path}/a.trig", "trig")) == Counter([e(*"apb"), e(*"cpd"), e(*"apb"), e(*"aqc"), e(*"zpy"), e(*"kpl")])
    (tmp_path / "a.nq").write_text("<u:a> <u:p> <u:b> <u:g> .\n<u:a> <u:p> <u:b> .\n<u:a> <u:p> <u:b> _:g . # c\n<u:a> <u:p> .\n\n")
    assert rows(rdf.read(spark, f"{tmp_path}/a.nq", "nquads")) == Counter({("u:a", "u:p", "u:b"): 3})
    kinds = rdf.line_kinds(spark.read.text(f"{tmp_path}/a.nq"), graphs=True).collect()
    assert {r["kind"]: r["n"] for r in kinds} == {"statement": 3, "malformed": 1, "blank": 1}


def test_malformed_files(spark, tmp_path):
    (tmp_path / "good.ttl").write_text("<u:a> <u:p> <u:b> .")
    (tmp_path / "bad.ttl").write_text("<u:a> <u:p> .")
    assert rdf.statements(spark, str(tmp_path), "turtle", skip_malformed=True).count() == 1
    with pytest.raises(Exception, match="unexpected"):
        rdf.statements(spark, str(tmp_path), "turtle").count()


def test_rdfxml_by_file_name(spark, files):
    got = rows(rdf.read(spark, str(files), "rdfxml", "*.owl"))
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert got == Counter([("http://e/a", kind, "http://e/T"), ("http://e/a", "http://e/p", "http://e/doc#b"), ("http://e/a", "http://e/r", "http://e/doc#u"), ("http://e/doc#u", kind, "http://e/U")])


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="format"):
        rdf.read(spark, "x", "json")


def test_store_round_trip_merge_and_answers(spark, tmp_path):
    given = [("a&b", "p", "c"), ("a&b", "p", "c"), ("d", "p", "c"), ("c", "q", "d")]
    df = spark.createDataFrame(given, "s string, p string, o string")
    store = Store.build(df)
    store.save(str(tmp_path / "one"))
    again = Store.load(spark, str(tmp_path / "one"))
    assert rows(again.decoded()) == Counter(given)
    text = "SELECT ?x { ?x <p> ?y . ?y <q> <d> }"
    assert sorted(r["x"] for r in again.query(text).collect()) == ["a&b", "a&b", "d"]
    assert again.query("SELECT (COUNT(?x) AS ?n) { ?x <p> <nobody> }").first()["n"] == 0
    assert again.query("SELECT ?x { ?x <unknown> ?y }").count() == 0
    assert rows(Store.build(df, dedupe=True).decoded()) == Counter(set(given))
    other = Store.build(spark.createDataFrame([("d", "p", "c"), ("d", "p", "c"), ("new", "p", "c")], "s string, p string, o string"))
    assert rows(again.merge(other).decoded()) == Counter({("a&b", "p", "c"): 2, ("d", "p", "c"): 2, ("new", "p", "c"): 1, ("c", "q", "d"): 1})
    plan = again.triples.where("p = 0 AND o = 1").select("s")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,1)" in plan


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_codes_of_frequent_and_rare_terms(spark, tmp_path, monkeypatch, hot):
    """Whatever part of the dictionary is broadcast, and without the planner's own broadcasts."""
    from loomgraph.operators import dictionary

    monkeypatch.setattr(dictionary, "HOT", hot)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = [(f"s{k % 17}", f"p{k % 2}", f"o{k * k % 23}") for k in range(120)] + [("o1", "p0", "s1"), ("o1", "p0", "s1")]
        store = Store.build(spark.createDataFrame(given, "s string, p string, o string"))
        terms, predicates = ({r["term"]: r["code"] for r in x.collect()} for x in (store.terms, store.predicates))
        assert sorted(terms.values()) == list(range(len(terms)))
        assert rows(store.triples) == Counter((terms[s], predicates[p], terms[o]) for s, p, o in given)
        store.save(str(tmp_path / "saved"))
        assert rows(Store.load(spark, str(tmp_path / "saved")).decoded()) == Counter(given)
        assert hot == 0 or "SortMergeJoin" not in store.decoded()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_endpoint(spark):
    store = Store.build(spark.createDataFrame([("a&<b>", "p", "c")], "s string, p string, o string"))
    server = serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/any"
    try:
        text = urllib.request.urlopen(f"{at}?query={urllib.parse.quote('SELECT ?x { ?x <p> <c> }')}").read().decode()
        assert minidom.parseString(text).getElementsByTagName("uri")[0].firstChild.data == "a&<b>"
        text = urllib.request.urlopen(f"{at}?query={urllib.parse.quote('SELECT (COUNT(?x) AS ?n) { ?x <p> <c> }')}").read().decode()
        literal = minidom.parseString(text).getElementsByTagName("literal")[0]
        assert literal.firstChild.data == "1" and literal.getAttribute("datatype").endswith("#integer")
        for query in ("", "?query=", "?query=ASK%20%7B%7D"):
            with pytest.raises(urllib.error.HTTPError) as caught:
                urllib.request.urlopen(at + query)
            assert caught.value.code == 400
    finally:
        server.shutdown()


def test_command_line(spark, files, tmp_path):
    cli.main(["c", f"{tmp_path}/codes", "ntriples", f"{files}/a.nt"])
    cli.main(["l", f"{tmp_path}/codes", f"{tmp_path}/store", "ntriples", f"{files}/a.nt"])
    store = Store.load(spark, f"{tmp_path}/store")
    assert store.query("SELECT ?x { ?x <http://e/p> <http://e/b> }").count() == 2
    assert "".join(to_xml(store.query("SELECT ?x { ?x <http://e/q> ?y }"))).count("<uri>http://e/c</uri>") == 1


def test_streamed_batches_merge(spark, tmp_path):
    source, merged = tmp_path / "in", MergedStatements(spark, f"{tmp_path}/store")
    source.mkdir()
    for k, text in enumerate(["<u:a> <u:p> <u:b> .\n<u:a> <u:p> <u:b> .\n", '<u:a> <u:p> <u:b> .\n<u:c> <u:p> "x" .\n<u:c> <u:p> <u:d> .\n']):
        (source / f"{k}.nt").write_text(text)
        stream_ntriples(spark, str(source), merged, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(merged.current()) == Counter({("u:a", "u:p", "u:b"): 2, ("u:c", "u:p", "u:d"): 1})
    merged.merge(spark.createDataFrame([("z", "z", "z")], "s string, p string, o string"), 0)
    assert rows(merged.current())[("z", "z", "z")] == 0
    before = rows(merged.current())
    merged.compact()
    assert rows(merged.current()) == before
    merged.merge(spark.createDataFrame([("u:c", "u:p", "u:d")] * 2, "s string, p string, o string"), 7)
    merged.merge(spark.createDataFrame([("z", "z", "z")], "s string, p string, o string"), 1)
    assert rows(merged.current()) == Counter({("u:a", "u:p", "u:b"): 2, ("u:c", "u:p", "u:d"): 2})


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from loomgraph.tables import shared_folder

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[8]"))).startswith("file:")
