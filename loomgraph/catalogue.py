"""Queries over the star-schema tables, one or more for each operator, with their SQL."""

from __future__ import annotations

import threading
import urllib.parse
import urllib.request
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import codec
from loomgraph.operators import bags, dictionary, index
from loomgraph.plans import compiler, sparql
from loomgraph.results import document, rows
from loomgraph.server import serve
from loomgraph.sources import rdf
from loomgraph.sources.mapping import mapping_sql, triples
from loomgraph.sources.store import Store
from loomgraph.tables import new_path

#: Pattern queries: name -> text. Terms of the mapping are relative IRIs, predicates have an empty prefix.
PATTERNS = {
    "leaf_bound": "SELECT ?x WHERE { ?x <ofNation> <nation/7> }",
    "leaf_unbound": "SELECT ?x WHERE { ?x <hasPart> ?y }",
    "edge_join": "SELECT ?x WHERE { ?x <placedBy> ?c . ?c <segment> <segment/BUILDING> }",
    "star_bound": "SELECT ?x WHERE { ?x <ofNation> <nation/7> ; <segment> <segment/BUILDING> }",
    "path3": "SELECT ?x WHERE { ?x <placedBy> ?c . ?c <ofNation> ?n . ?n <inRegion> <region/2> }",
    "two_unbound": "SELECT ?x WHERE { ?x <hasPart> ?a ; <suppliedBy> ?b ; <priority> <priority/1-URGENT> }",
    "two_branches": "SELECT ?x WHERE { ?x <hasPart> ?p . ?p <brand> <brand/Brand#2> . ?x <suppliedBy> ?s . ?s <ofNation> <nation/3> }",
    "unknown_term": "SELECT ?x WHERE { ?x <ofNation> <nation/none> }",
    "count_tree": "SELECT (COUNT(?x) AS ?n) WHERE { ?x <hasPart> ?p . ?p <brand> <brand/Brand#2> . ?x <suppliedBy> ?s . ?s <ofNation> <nation/3> }",
    "count_empty": "SELECT (COUNT(?x) AS ?n) WHERE { ?x <ofNation> <nation/none> }",
    "ignored_component": "SELECT ?x WHERE { ?x <ofNation> <nation/7> . ?y <inRegion> <region/2> }",
    "fresh_objects": "SELECT ?x WHERE { ?x <ofNation> ?z . ?y <hasPart> ?z . ?x <segment> ?z }",
}
#: Those with the multiplicities of SPARQL.
PRODUCTS = ("two_unbound", "two_branches", "count_tree")
SHARED_LEAF = "SELECT ?x WHERE { ?x <hasPart> ?z ; <suppliedBy> ?w . ?x <hasPart> ?z }"


def pattern(spark: SparkSession, sf_dir: str, text: str, semantics: str = "reference") -> DataFrame:
    return compiler.answer(triples(spark, sf_dir), sparql.parse(text), semantics)


def _literal(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return compiler.literal_bindings(triples(spark, sf_dir), sparql.parse(PATTERNS[name]).root).withColumnRenamed("id", "x")


BASE = "http://example.org/tpch#"


def load_ntriples_uri_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, base = triples(spark, sf_dir), BASE
    iris = rdf.lines(given.select(*[F.concat(F.lit(base), F.replace(F.col(c), F.lit("#"), F.lit("-"))).alias(c) for c in "spo"]))
    others = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.explode(F.array(
            F.format_string('<%scustomer/%s> <%sname> "%s"@en .', F.lit(base), F.col("c_custkey").cast("string"), F.lit(base), F.col("c_name")),
            F.format_string('<%scustomer/%s> <%snote> "an \\"<%siri>\\" . inside" . # comment', F.lit(base), F.col("c_custkey").cast("string"), F.lit(base), F.lit(base)),
            F.format_string("<%scustomer/%s> <%sknows> _:b1 .", F.lit(base), F.col("c_custkey").cast("string"), F.lit(base)),
            F.format_string("_:b1 <%sknows> <%scustomer/%s> .", F.lit(base), F.lit(base), F.col("c_custkey").cast("string")),
            F.lit("# a comment"),
        )).alias("value")
    )
    parsed = rdf.parse_lines(iris.unionAll(others))
    return parsed.where("s_kind = 'iri' AND o_kind = 'iri'").select("s", "p", "o")


def answer_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store.build(triples(spark, sf_dir)).query(PATTERNS["path3"])


def code_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.ranked(dictionary.subject_object_counts(triples(spark, sf_dir)))


def encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store.build(triples(spark, sf_dir)).decoded()


def _saved(spark: SparkSession, sf_dir: str) -> Store:
    path = new_path(spark)
    Store.build(triples(spark, sf_dir)).save(path)
    return Store.load(spark, path)


def store_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).decoded()


def store_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).query(PATTERNS["two_branches"])


def store_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _merged_sides(spark, sf_dir)
    return Store.build(a).merge(Store.build(b)).decoded()


def _file(spark: SparkSession, folder: str, name: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(text.encode()))
    out.close()


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """A table of 25 rows at any scale."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()


def turtle_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark)
    body = "".join(f'e:nation{n} e:inRegion e:region{r} ; e:name "{name}"@en , """a "long" one""" ; e:near [ e:of e:region{r} ] .\n' for n, name, r in _nations(spark, sf_dir))
    _file(spark, folder, "nations.ttl", f"@prefix e: <{BASE}> . # nations\n{body}")
    return rdf.read(spark, folder, "turtle")


def trig_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark)
    body = "".join(f"GRAPH e:g{r} {{ e:nation{n} e:inRegion e:region{r} }}\n" for n, _, r in _nations(spark, sf_dir))
    _file(spark, folder, "nations.trig", f"PREFIX e: <{BASE}>\n{body}")
    return rdf.read(spark, folder, "trig")


def owl_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RDF/XML files of a directory by name: one file for each nation, and another that the pattern leaves out."""
    folder = new_path(spark)
    for n, name, r in _nations(spark, sf_dir):
        inner = f'<rdf:Description rdf:about="{BASE}nation{n}" e:name="{name}"><e:inRegion rdf:resource="{BASE}region{r}"/><e:note>text</e:note></rdf:Description>'
        _file(spark, folder, f"{n}.owl", f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:e="{BASE}">{inner}</rdf:RDF>')
    _file(spark, folder, "other.txt", "no RDF")
    return rdf.read(spark, folder, "rdfxml", "*.owl")


def nquads_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rdf.lines(triples(spark, sf_dir).select(*[F.concat(F.lit(BASE), F.replace(F.col(c), F.lit("#"), F.lit("-"))).alias(c) for c in "spo"]))
    quads = lines.select(F.regexp_replace("value", r" \.$", " <u:graph> .").alias("value"))
    return rdf.parse_lines(quads, graphs=True).select("s", "p", "o")


def rdf_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    lines = F.array(F.format_string("<u:s%s> <u:p> <u:o> .", key), F.format_string("<u:s%s> <u:p> <u:o>", key), F.format_string("<u:s%s> u:p <u:o> .", key), F.lit("# note"), F.lit(" "))
    return rdf.line_kinds(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.explode(lines).alias("value")))


def result_xml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(pattern(spark, sf_dir, PATTERNS["count_tree"]))


def endpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the endpoint answers to a query, line by line."""
    server = serve(Store.build(triples(spark, sf_dir)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}/?query={urllib.parse.quote(PATTERNS['count_tree'])}"
        text = urllib.request.urlopen(at).read().decode()
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "no int, line string")


def huffman_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = dictionary.huffman(dictionary.subject_object_counts(triples(spark, sf_dir)))
    return coded.agg(F.coalesce(F.sum(F.col("freq") * F.col("bits")), F.lit(0)).cast("long").alias("total_bits"), F.count(F.lit(1)).alias("terms"))


#: Factor and modulus of numbers that take one to four bytes.
NUMBERS = ((1, 64), (7, 16384), (104729, 1 << 22), (104729, 1 << 30))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.explode(F.array(*[key * a % m for a, m in NUMBERS])).alias("v"))


def varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 104729 % 1073741824).cast("long").alias("v"))
    twice = keys.withColumn("h", F.concat(codec.varint_hex(F.col("v")), codec.varint_hex(F.lit(5).cast("long"))))
    return twice.select("v", codec.varint_value(F.col("h")).cast("long").alias("decoded"), codec.varint_value(codec.varint_rest(F.col("h"))).cast("long").alias("rest"))


def merge_max_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _merged_sides(spark, sf_dir)
    return bags.union_rows(a, b)


def bag_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _merged_sides(spark, sf_dir)
    return bags.intersect_rows(a, b)


def _merged_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("s"), F.lit("hasPart").alias("p"), F.concat(F.lit("part/"), (F.col("l_partkey") % 50).cast("string")).alias("o"))
    return items.where("l_linenumber <= 4").drop("l_linenumber"), items.where("l_linenumber >= 3").drop("l_linenumber")


def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each line number that there is."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbers = sorted(r[0] for r in lines.select("l_linenumber").distinct().collect())
    return bags.merge_runs([lines.where(F.col("l_linenumber") == k).select(F.col("l_partkey").alias("v")) for k in numbers], "v")


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("ofNation").alias("p"), F.concat(F.lit("nation/"), (F.col("n_nationkey") * 2).cast("string")).alias("o"))
    return bags.lookup(requests, triples(spark, sf_dir).where("p = 'ofNation'"))


def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", codec.common_prefix_len(F.col("p_name"), F.col("p_type")).cast("long").alias("with_type"), codec.common_prefix_len(F.col("p_brand"), F.lit("Brand#1x")).cast("long").alias("with_brand"))


def iri_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    term = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("ub:"), name)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("?"), name)).when(F.col("c_custkey") % 4 == 2, F.lit("a")).otherwise(name)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", codec.expand_iri(term, {"ub": UB}).alias("iri"))


UB = "http://example.org/university#"


def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posting_texts(triples(spark, sf_dir))


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.nested(triples(spark, sf_dir)).select("p", F.inline("objects"))
    return lists.groupBy("p").agg(F.countDistinct("o").alias("n_objects"), F.sum(F.size("subjects")).alias("n_statements"))


def exists_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = compiler.bindings(triples(spark, sf_dir), sparql.parse("SELECT ?x { ?x <ofNation> ?n }").root)
    found = [bags.exists(bag, who).select(F.lit(who).alias("who"), "found") for who in ("customer/nobody", "customer/1")]
    return found[0].unionAll(found[1])


def result_xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pattern(spark, sf_dir, PATTERNS["two_branches"]))


def queries() -> dict:
    found = {name: partial(pattern, text=text) for name, text in PATTERNS.items()}
    found |= {f"{name}_sparql": partial(pattern, text=PATTERNS[name], semantics="sparql") for name in PRODUCTS}
    found |= {"shared_leaf_sparql": partial(pattern, text=SHARED_LEAF, semantics="sparql"), "two_unbound_literal": partial(_literal, name="two_unbound")}
    found |= {
        "scan_triples": triples,
        "scan_ordered": lambda spark, d: index.ordered(triples(spark, d)),
        "term_freq_so": lambda spark, d: dictionary.subject_object_counts(triples(spark, d)),
        "term_freq_p": lambda spark, d: dictionary.predicate_counts(triples(spark, d)),
        "dictionary_size": lambda spark, d: dictionary.subject_object_counts(triples(spark, d)).agg(F.count(F.lit(1)).alias("n_terms")),
        "index_levels": lambda spark, d: index.level_sizes(triples(spark, d)),
        "varint_len": lambda spark, d: _numbers(spark, d).select("v", (codec.varint_extra(F.col("v")) + 1).cast("int").alias("n_bytes")),
        "varint_hex": lambda spark, d: _numbers(spark, d).select("v", codec.varint_hex(F.col("v")).alias("encoded")),
        "sort_codes": lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey").orderBy("l_partkey"),
        "rdf_statement_kinds": lambda spark, d: rdf.by_kind(rdf.parse_lines(spark.read.parquet(f"{d}/supplier.parquet").select(F.explode(F.array(F.format_string("<u:s%s> <u:p> <u:o> .", F.col("s_suppkey").cast("string")), F.format_string('<u:s%s> <u:p> "x" .', F.col("s_suppkey").cast("string")), F.lit("_:a <u:p> <u:o> ."))).alias("value")))),
    }
    for f in (
        load_ntriples_uri_filter, nquads_source, turtle_source, trig_source, owl_directory, rdf_line_kinds, answer_decoded, code_rank, encode_roundtrip,
        store_loaded, store_answer, store_merged, huffman_cost, varint_roundtrip, merge_max_union, bag_intersect, kway_merge, batch_lookup, common_prefix,
        iri_expand, posting_lists, nested_index, exists_subject, result_xml_rows, result_xml_document, endpoint_lines,
    ):
        found[f.__name__] = f
    return found


def oracle_sql() -> dict[str, str]:
    t = f"WITH t AS ({mapping_sql()}) "
    edge = lambda p, o=None: f"SELECT s AS x FROM t WHERE p = '{p}'" + (f" AND o = '{o}'" if o else "")
    path3 = "SELECT a.s AS x FROM t a JOIN t b ON a.o = b.s JOIN t c ON b.o = c.s WHERE a.p = 'placedBy' AND b.p = 'ofNation' AND c.p = 'inRegion' AND c.o = 'region/2'"
    by_brand = "SELECT a.s AS x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'hasPart' AND b.p = 'brand' AND b.o = 'brand/Brand#2'"
    by_nation = "SELECT a.s AS x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'suppliedBy' AND b.p = 'ofNation' AND b.o = 'nation/3'"
    two_unbound = f"({edge('hasPart')} INTERSECT ALL {edge('suppliedBy')}) INTERSECT ALL {edge('priority', 'priority/1-URGENT')}"
    two_branches = f"{by_brand} INTERSECT ALL {by_nation}"
    grouped = lambda rows: f"(SELECT x, count(*) AS n FROM ({rows}) GROUP BY x)"
    times = f"SELECT u.x, u.n * v.n AS m FROM {grouped(by_brand)} u JOIN {grouped(by_nation)} v ON u.x = v.x"
    repeated = lambda counts: f"SELECT x FROM (SELECT x, unnest(range(m)) FROM ({counts}))"
    huffman = """WITH RECURSIVE t AS (MAPPING), freq AS (SELECT term, count(*) AS w FROM (SELECT s AS term FROM t UNION ALL SELECT o FROM t) GROUP BY term),
        start AS (SELECT list({'w': w, 'c': c} ORDER BY w) AS q FROM (SELECT w, count(*) AS c FROM freq GROUP BY w)),
        steps(q, bits) AS (
          SELECT q, CAST(0 AS BIGINT) FROM start
          UNION ALL SELECT list_sort(list_concat(rest, [new])), bits + new.w * new.c FROM (
            SELECT bits,
              CASE WHEN q[1].c > 1 THEN {'w': 2 * q[1].w, 'c': q[1].c // 2} ELSE {'w': q[1].w + q[2].w, 'c': CAST(1 AS BIGINT)} END AS new,
              CASE WHEN q[1].c > 1 THEN list_concat(CASE WHEN q[1].c % 2 = 1 THEN [{'w': q[1].w, 'c': CAST(1 AS BIGINT)}] ELSE [] END, q[2:])
                ELSE list_concat(CASE WHEN q[2].c > 1 THEN [{'w': q[2].w, 'c': q[2].c - 1}] ELSE [] END, q[3:]) END AS rest
            FROM steps WHERE len(q) > 1 OR q[1].c > 1))
        SELECT CAST(max(bits) AS BIGINT) AS total_bits, (SELECT count(*) FROM freq) AS terms FROM steps""".replace("MAPPING", mapping_sql())
    freq = "SELECT term, count(*) AS freq FROM (SELECT s AS term FROM t UNION ALL SELECT o FROM t) GROUP BY term"
    numbers = "SELECT unnest([" + ", ".join(f"(CAST(o_orderkey AS BIGINT) * {a}) % {m}" for a, m in NUMBERS) + "]) AS v FROM orders"
    nations = f"SELECT '{BASE}nation' || n_nationkey AS s, '{BASE}inRegion' AS p, '{BASE}region' || n_regionkey AS o FROM nation"
    whole = f"SELECT '{BASE}' || replace(s, '#', '-') AS s, '{BASE}' || p AS p, '{BASE}' || replace(replace(o, '#', '-'), ' ', '_') AS o FROM t"  # lines() writes _ for blanks
    merged = "SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY s, p, o) AS k FROM a UNION SELECT *, row_number() OVER (PARTITION BY s, p, o) AS k FROM b)"
    head = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head><variable name="n"/></head>\n<results>\n'
    literal = f"'<result><binding name=\"n\"><literal datatype=\"http://www.w3.org/2001/XMLSchema#integer\">' || (SELECT count(*) FROM ({two_branches})) || '</literal></binding></result>'"
    sides = """WITH i AS (SELECT l_linenumber, 'order/' || l_orderkey AS s, 'hasPart' AS p, 'part/' || (l_partkey % 50) AS o FROM lineitem),
        a AS (SELECT s, p, o FROM i WHERE l_linenumber <= 4), b AS (SELECT s, p, o FROM i WHERE l_linenumber >= 3) """
    prefix = lambda a, b: f"(SELECT max(n) FROM range(0, 1 + least(length({a}), length({b}))) r(n) WHERE left({a}, n) = left({b}, n))"
    return {
        "scan_triples": mapping_sql(),
        "scan_ordered": mapping_sql() + " ORDER BY p, o, s",
        "leaf_bound": t + edge("ofNation", "nation/7"),
        "leaf_unbound": t + edge("hasPart"),
        "edge_join": t + "SELECT a.s AS x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'segment' AND b.o = 'segment/BUILDING'",
        "star_bound": t + edge("ofNation", "nation/7") + " INTERSECT ALL " + edge("segment", "segment/BUILDING"),
        "path3": t + path3,
        "two_unbound": t + two_unbound,
        "two_unbound_literal": t + two_unbound,
        "two_branches": t + two_branches,
        "unknown_term": t + edge("ofNation", "nation/none"),
        "count_tree": t + f"SELECT count(*) AS n FROM ({two_branches})",
        "count_empty": t + f"SELECT count(*) AS n FROM ({edge('ofNation', 'nation/none')})",
        "ignored_component": t + edge("ofNation", "nation/7"),
        "fresh_objects": t + edge("ofNation") + " INTERSECT ALL " + edge("segment"),
        # counted for each pattern, then multiplied
        "two_unbound_sparql": t + repeated(f"SELECT x, a.n * b.n * c.n AS m FROM {grouped(edge('hasPart'))} a JOIN {grouped(edge('suppliedBy'))} b USING (x) JOIN {grouped(edge('priority', 'priority/1-URGENT'))} c USING (x)"),
        "two_branches_sparql": t + repeated(times),
        "count_tree_sparql": t + f"SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS n FROM ({times})",
        "shared_leaf_sparql": t + repeated(f"SELECT x, CAST(a.n * b.n AS BIGINT) AS m FROM (SELECT s AS x, sum(n * n) AS n FROM (SELECT s, o, count(*) AS n FROM t WHERE p = 'hasPart' GROUP BY s, o) GROUP BY s) a JOIN {grouped(edge('suppliedBy'))} b USING (x)"),
        "load_ntriples_uri_filter": t + whole,
        "nquads_source": t + whole,
        "turtle_source": nations,
        "trig_source": nations,
        "owl_directory": nations,
        "rdf_line_kinds": "SELECT unnest(['statement', 'malformed', 'blank']) AS kind, unnest([n, 2 * n, 2 * n]) AS n FROM (SELECT count(*) AS n FROM supplier)",
        "store_loaded": t + "SELECT s, p, o FROM t",
        "store_answer": t + two_branches,
        "store_merged": sides + merged,
        "huffman_cost": huffman,
        "result_xml_document": t + f"SELECT CAST(0 AS INTEGER) AS place, '{head}' AS xml UNION ALL SELECT 1, {literal} UNION ALL SELECT 2, '</results>\n</sparql>\n'",
        "endpoint_lines": t + f"SELECT CAST(no AS INTEGER) AS no, line FROM (SELECT unnest(range(7)) AS no, unnest(string_split('{head}', chr(10))[1:4] || [{literal}] || ['</results>', '</sparql>']) AS line) WHERE line IS NOT NULL",
        "answer_decoded": t + path3,
        "term_freq_so": t + freq,
        "term_freq_p": t + "SELECT p AS term, count(*) AS freq FROM t GROUP BY p",
        "dictionary_size": t + f"SELECT count(*) AS n_terms FROM ({freq})",
        "code_rank": t + f"SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) - 1 AS code FROM ({freq})",
        "encode_roundtrip": t + "SELECT s, p, o FROM t",
        "index_levels": t + "SELECT count(DISTINCT p) AS predicates, count(DISTINCT (p, o)) AS predicate_objects, count(*) AS statements FROM t",
        "posting_lists": t + "SELECT p, o, string_agg(s, ',' ORDER BY s) AS subjects FROM t GROUP BY p, o",
        "nested_index": t + "SELECT p, count(DISTINCT o) AS n_objects, count(*) AS n_statements FROM t GROUP BY p",
        "varint_len": f"SELECT v, CAST(CASE WHEN v <= 63 THEN 1 WHEN v <= 16383 THEN 2 WHEN v <= 4194303 THEN 3 ELSE 4 END AS INTEGER) AS n_bytes FROM ({numbers})",
        "varint_hex": f"""SELECT v, CASE WHEN v <= 63 THEN printf('%02X', v) WHEN v <= 16383 THEN printf('%02X%02X', 64 + (v & 63), v >> 6)
            WHEN v <= 4194303 THEN printf('%02X%02X%02X', 128 + (v & 63), (v >> 6) & 255, v >> 14)
            ELSE printf('%02X%02X%02X%02X', 192 + (v & 63), (v >> 6) & 255, (v >> 14) & 255, v >> 22) END AS encoded FROM ({numbers})""",
        "varint_roundtrip": "SELECT (o_orderkey * 104729) % 1073741824 AS v, (o_orderkey * 104729) % 1073741824 AS decoded, CAST(5 AS BIGINT) AS rest FROM orders",
        "merge_max_union": sides + merged,
        "bag_intersect": sides + "SELECT * FROM a INTERSECT ALL SELECT * FROM b",
        "kway_merge": "SELECT l_partkey AS v FROM lineitem ORDER BY v",
        "sort_codes": "SELECT l_partkey FROM lineitem ORDER BY l_partkey",
        "batch_lookup": t + "SELECT t.p, t.o, t.s FROM t JOIN nation ON t.p = 'ofNation' AND t.o = 'nation/' || (n_nationkey * 2)",
        "common_prefix": f"SELECT p_partkey, CAST({prefix('p_name', 'p_type')} AS BIGINT) AS with_type, CAST({prefix('p_brand', chr(39) + 'Brand#1x' + chr(39))} AS BIGINT) AS with_brand FROM part",
        "iri_expand": f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{UB}' || c_name WHEN 1 THEN '?' || c_name WHEN 2 THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' ELSE c_name END AS iri FROM customer",
        "exists_subject": t + "SELECT who, EXISTS (SELECT 1 FROM t WHERE p = 'ofNation' AND s = who) AS found FROM (VALUES ('customer/nobody'), ('customer/1')) v(who)",
        "result_xml_rows": t + f"SELECT '<result><binding name=\"x\"><uri>' || x || '</uri></binding></result>' AS xml FROM ({two_branches})",
        "rdf_statement_kinds": "SELECT unnest(['iri', 'iri', 'blank']) AS s_kind, unnest(['iri', 'literal', 'iri']) AS o_kind, n FROM (SELECT count(*) AS n FROM supplier)",
    }
