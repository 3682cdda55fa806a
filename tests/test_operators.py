"""Merges, bags, dictionaries, codecs."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import codec
from loomgraph.operators import bags, dictionary, index

A, B, C, D, E = [1, 2, 3], [4, 5, 6], [1, 2, 3, 4, 5, 6], [1, 3, 5], [2, 4, 6]
FF, G, H = [2, 4, 5, 6], [4, 6], [1, 2, 3, 4, 5]
MERGES = [(A, B, C), (B, A, C), (A, C, C), (C, A, C), (D, E, C), (E, D, C), (A, A, A), (A, FF, C), (FF, A, C), (C, G, C), (G, C, C), (H, G, C), (G, H, C)]
MERGES += [([1, 1, 2, 3, 3, 3], [1, 2, 2, 4], [1, 1, 2, 2, 3, 3, 3, 4]), ([], A, A), (A, [], A), ([], [], [])]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x int")


@pytest.mark.parametrize(("a", "b", "expected"), MERGES)
def test_union_keeps_the_larger_multiplicity(spark, a, b, expected):
    assert sorted(r["x"] for r in bags.union_rows(frame(spark, a), frame(spark, b)).collect()) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_bags(spark, a, b):
    left, right = frame(spark, a), frame(spark, b)
    assert Counter(r["x"] for r in bags.union_rows(left, right).collect()) == Counter(a) | Counter(b)
    assert Counter(r["x"] for r in bags.intersect_rows(left, right).collect()) == Counter(a) & Counter(b)
    factored = bags.intersect([bags.counted(left, "x"), bags.counted(right, "x")])
    assert Counter(r["id"] for r in bags.copies(factored).collect()) == Counter(a) & Counter(b)


def test_runs(spark):
    runs = [frame(spark, r) for r in ([1, 5, 10, 15, 20], [16, 17, 18], [2, 3, 4], [6, 7, 8, 9])]
    assert [r["x"] for r in bags.merge_runs(runs, "x").collect()] == sorted([1, 5, 10, 15, 20, 16, 17, 18, 2, 3, 4, 6, 7, 8, 9])


@pytest.mark.parametrize(("v", "n", "encoded"), [(0, 1, "00"), (63, 1, "3F"), (64, 2, "4001"), (16383, 2, "7FFF"), (16384, 3, "800001"), (4194303, 3, "BFFFFF"), (4194304, 4, "C0000001"), (1073741823, 4, "FFFFFFFF")])
def test_varint_goldens(spark, v, n, encoded):
    row = spark.createDataFrame([(v, encoded)], "v long, h string").select(
        (codec.varint_extra(F.col("v")) + 1).alias("n"), codec.varint_hex(F.col("v")).alias("h"), codec.varint_value(F.col("h")).alias("v")
    ).first()
    assert (row["n"], row["h"], row["v"]) == (n, encoded, v)


def test_varint_stream_and_limits(spark):
    values = [random.Random(3).randrange(1 << 30) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("h", F.concat(codec.varint_hex(F.col("v")), F.lit("05")))
    for r in df.select("v", codec.varint_value(F.col("h")).alias("a"), codec.varint_rest(F.col("h")).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["v"], "05")
    wide = spark.createDataFrame([(1 << 30,), (-1,), (None,)], "v long")
    assert [r[0] for r in wide.select(codec.varint_hex(F.col("v"))).collect()] == [None] * 3
    cut = spark.createDataFrame([("40",)], "h string")
    assert cut.select(codec.varint_value(F.col("h"))).first()[0] is None


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("", "a", 0), ("abc", "abd", 2), ("abc", "abcc", 3), ("same", "same", 4), ("x", "y", 0)])
def test_common_prefix(spark, a, b, n):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(codec.common_prefix_len(F.col("a"), F.col("b"))).first()[0] == n


def test_ranks_and_codes(spark):
    terms = ["aaa", "abc", "abcc", "ab", "abc", "cda", *[f"http://dbpedia.org/resource/{x}" for x in ("Autism", "Aristotle", "Alabama", "Abraham_Lincoln", "Abraham_Lincoln__1")]]
    counts = spark.createDataFrame([(t,) for t in terms], "term string").groupBy("term").count().withColumnRenamed("count", "freq")
    got = [(r["term"], r["code"]) for r in dictionary.ranked(counts, 3).orderBy("code").collect()]
    n = Counter(terms)
    assert got == [(t, k) for k, t in enumerate(sorted(n, key=lambda t: (-n[t], t)))]
    assert dictionary.ranked(counts.limit(0)).count() == 0


def test_ranks_without_reused_exchanges(spark):
    counts = spark.range(3000).selectExpr("concat('t', id % 1500) AS term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert sorted(r["code"] for r in dictionary.ranked(counts, 7).collect()) == list(range(1500))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_large_multiplicities_are_cut_into_spans(spark, monkeypatch):
    monkeypatch.setattr(bags, "SPAN", 8)
    bag = spark.createDataFrame([("a", 8), ("b", 9), ("c", 0), ("d", 25)], "id string, m long")
    assert Counter(r["id"] for r in bags.copies(bag).collect()) == Counter(a=8, b=9, d=25)


def test_long_lists_have_several_parts(spark):
    rows = [(f"s{k % 40}", "p", "o") for k in range(90)] + [("x", "p", f"o{k}") for k in range(50)] + [("y", "q", "o")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    lists = index.posting_lists(triples, most=20).collect()
    assert Counter((s, r["p"], r["o"]) for r in lists for s in r["subjects"]) == Counter(rows)
    assert sum((r["p"], r["o"]) == ("p", "o") for r in lists) > 2 and all(r["subjects"] == sorted(r["subjects"]) for r in lists)
    made = index.nested(triples, most=20).collect()
    assert Counter((s, r["p"], x["o"]) for r in made for x in r["objects"] for s in x["subjects"]) == Counter(rows)
    assert len([r for r in made if r["p"] == "p"]) > 3 and len([r for r in made if r["p"] == "q"]) == 1


def test_long_lists_are_one_text(spark):
    rows = [(f"s{k * 7 % 40}", "p", "o") for k in range(90)] + [("x", "p", f"o{k % 9}") for k in range(50)] + [(None, "q", "o"), ("y", "q", "o"), ("z", "q", None)]
    got = {(r["p"], r["o"]): r["subjects"] for r in index.posting_texts(spark.createDataFrame(rows, "s string, p string, o string"), most=20).collect()}
    keys = {(p, o) for _, p, o in rows}
    assert got == {key: ",".join(sorted(s for s, *rest in rows if tuple(rest) == key and s)) for key in keys}
    lists = index.posting_lists(spark.createDataFrame(rows, "s string, p string, o string"), most=20).collect()
    assert max(len(r["subjects"]) for r in lists) <= 20


def test_plans_without_skewed_or_growing_tasks(spark):
    """Long lists are broadcast whatever the threshold, and partitions follow the size, not the session's number."""
    from loomgraph import tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("s", "p", "o")], "s string, p string, o string")
        plan = index.nested(rows)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = spark.range(40_000_000).selectExpr("'s' AS s", "'p' AS p", "concat('o', id % 3) AS o")
    assert tables.parts_for(wide) > 40
    assert index.ordered(wide)._jdf.queryExecution().optimizedPlan().toString().count(f", {tables.parts_for(wide)}") == 1
    union = bags.union_rows(wide, wide)._jdf.queryExecution().executedPlan().toString()
    assert union.count("Exchange") == 1


def test_ordered_statements(spark):
    rows = [(f"s{k * 7 % 11}", f"p{k % 2}", f"o{k % 5}") for k in range(300)]
    got = [tuple(r) for r in index.ordered(spark.createDataFrame(rows, "s string, p string, o string")).collect()]
    assert got == sorted(rows, key=lambda r: (r[1], r[2], r[0]))


def test_huffman_is_prefix_free_and_optimal():
    codes = dictionary.huffman_codes([("a", 5), ("b", 9), ("c", 12), ("d", 13), ("e", 16), ("f", 45)])
    assert sum(n * codes[t][1] for t, n in [("a", 5), ("b", 9), ("c", 12), ("d", 13), ("e", 16), ("f", 45)]) == 224
    paths = ["".join(str(code >> k & 1) for k in range(bits)) for code, bits in codes.values()]
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)
    assert len({code for code, _ in codes.values()}) == 6
    assert dictionary.huffman_codes([]) == {}
    assert dictionary.huffman_codes([("only", 3)]) == {"only": (0, 0)}


def test_huffman_refuses_large_dictionaries(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "term string, freq long")
    with pytest.raises(ValueError, match="ranked"):
        dictionary.huffman(counts, most=1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 4), st.integers(1, 200)), min_size=1, max_size=60))
def test_huffman_lengths_cost_as_much_as_the_tree(freqs):
    terms = [(str(k), n) for k, n in enumerate(freqs)]
    codes = dictionary.huffman_codes(terms)
    lengths = [bits for bits, n in dictionary.huffman_lengths(list(Counter(freqs).items())) for _ in range(n)]
    assert len(lengths) == len(freqs)
    assert sum(n * bits for n, bits in zip(sorted(freqs, reverse=True), lengths, strict=True)) == sum(n * codes[t][1] for t, n in terms)


def test_huffman_codes_of_a_table(spark):
    freqs = {f"t{k}": 1 + k * k % 37 for k in range(90)}
    rows = dictionary.huffman(spark.createDataFrame(list(freqs.items()), "term string, freq long")).collect()
    assert {r["term"]: r["freq"] for r in rows} == freqs
    codes = dictionary.huffman_codes(list(freqs.items()))
    assert sum(r["freq"] * r["bits"] for r in rows) == sum(n * codes[t][1] for t, n in freqs.items())
    paths = ["".join(str(r["code"] >> k & 1) for k in range(r["bits"])) for r in rows]
    assert not any(i != j and b.startswith(a) for i, a in enumerate(paths) for j, b in enumerate(paths))
    assert dictionary.huffman(spark.createDataFrame([], "term string, freq long")).count() == 0
    one = dictionary.huffman(spark.createDataFrame([("only", 3)], "term string, freq long")).first()
    assert (one["code"], one["bits"]) == (0, 0)


def test_huffman_has_no_limit_of_terms(spark):
    counts = spark.range(1_000_001).select(F.col("id").cast("string").alias("term"), (1 + F.col("id") % 3).alias("freq"))
    assert dictionary.huffman(counts).agg(F.sum(F.pow(F.lit(2.0), -F.col("bits")))).first()[0] == 1


def test_levels_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "s string, p string, o string")
    assert tuple(index.level_sizes(empty).first()) == (0, 0, 0)
