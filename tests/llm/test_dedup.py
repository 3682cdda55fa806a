"""Near-duplicates of texts and vectors against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import lattice, neardup
from loomgraph.llm.components import components


def shingles(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    n = min(words, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def groups(nodes, links):
    to = {n: n for n in nodes}

    def find(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    return {i: len(s) for i, s in sets}, groups({i for i, _ in sets}, links)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_odd_rows(spark, odd_docs, odd_rows, words, percent):
    sizes, component = brute(odd_rows, words, percent)
    got = neardup.near_duplicates(odd_docs, words, percent).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])


def test_large_groups_chains_and_hubs(spark, monkeypatch):
    """Copies of a hub that are unlike each other, a chain, exact copies, and a passage that all share."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(80)]
    hub = [word() for _ in range(160)]
    texts = [hub]
    for _ in range(70):
        copy = list(hub)
        for at in rng.sample(range(160), 4):
            copy[at] = word()
        texts.append(copy)
    link = list(hub)
    for k in range(30):
        link = list(link)
        link[(k * 5) % 160] = word()
        texts.append(link)
    texts += [shared + [word() for _ in range(rng.randrange(15, 60))] for _ in range(60)]
    texts += [texts[-1]] * 20 + [[word() for _ in range(50)] for _ in range(30)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    _, component = brute(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == component


def test_hot_nodes_that_branch(spark, monkeypatch):
    """Pairs of near copies among documents with one template: all roots are large, and branch many times."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(150)]
    rows = []
    for k in range(300):
        own = [word() for _ in range(24)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:12] + [word() for _ in range(12)]))]
    _, component = brute(rows, 3, 85)
    assert len(set(component.values())) == 300
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == component


@pytest.mark.parametrize("least", [0.85, 0.8])
def test_sketches_rule_out_next_to_nothing(least):
    """At the threshold itself a pair's equal places are binomial; one of 100000 pairs may be lost."""
    from math import comb

    sketches = np.zeros((2, neardup.HASHES), dtype=np.uint8)
    lost = 0.0
    for equal in range(neardup.HASHES + 1):
        sketches[1] = np.arange(neardup.HASHES) >= equal
        if not len(neardup._alike(np.array([100, 100]), sketches, np.array([0, 1]), least)[0]):
            lost += comb(neardup.HASHES, equal) * least**equal * (1 - least) ** (neardup.HASHES - equal)
    assert lost < 1e-5


def test_nothing(spark, no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.deduplicated(no_docs).columns == no_docs.columns
    assert neardup.deduplicated(no_docs).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, odd_rows):
    _, component = brute(odd_rows, 5, 80)
    got = neardup.deduplicated(odd_docs)
    assert got.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([*{c for c in component.values()}, None])


def test_rows_are_told_by_id_and_text(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " more"), (None, texts[2]), (None, texts[2]), (3, texts[3]), (None, texts[3]), (None, None), (4, ""), (4, "")]
    got = neardup.deduplicated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3]), (None, None), (4, ""), (4, "")])


def pairs_at(similarity, n, seed):
    """Texts in pairs of about the given similarity of 3-word shingles, each pair of words of its own."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        own = [f"w{k}x{j}" for j in range(300)]
        other, edits = list(own), 0
        while True:
            at = rng.randrange(300)
            changed = [*other[:at], f"e{k}x{edits}", *other[at + 1 :]]
            a, b = shingles(" ".join(own), 3), shingles(" ".join(changed), 3)
            if len(a & b) / len(a | b) < similarity:
                break
            other, edits = changed, edits + 1
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    return rows


def test_recall_at_the_threshold_with_production_parameters(spark):
    rows = pairs_at(0.85, 1500, 17)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(1500)) >= 1499
    assert all(got[2 * k] == 2 * k for k in range(1500))


@pytest.mark.parametrize(("similarity", "most"), [(0.85, 3e-3), (0.8, 2e-2)])
def test_recall_where_all_nodes_branch(spark, similarity, most):
    """Signatures of pairs at the threshold: the roots and ten levels below them, as production has them."""
    rng = np.random.default_rng(19)
    a = rng.integers(0, 2**32, (1500, neardup.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    rows = [(k, side, x.astype("<u4").tobytes()) for side, xs in enumerate((a, b)) for k, x in enumerate(xs)]
    col = neardup.F.col
    at = spark.createDataFrame(rows, "pair long, side int, signature binary").select("pair", "side", "signature", neardup._roots(col("signature")).alias("at"))
    for depth in range(1, 11):
        at = at.select("pair", "side", "signature", neardup._branches(depth, col("at.path"), col("at.node"), col("signature")).alias("at"))
    met = at.groupBy("pair", "at.node").agg(neardup.F.countDistinct("side").alias("n")).where("n = 2").select("pair").distinct().count()
    assert 1 - met / 1500 <= most and neardup.loss(similarity, 10) <= most


def measured(spark, rows, monkeypatch):
    """Rows that are compared and confirmed, and the largest group in one task."""
    sizes = {"node": Counter(), "block": Counter()}
    ordered = neardup._ordered
    monkeypatch.setattr(neardup, "_ordered", lambda df, key: ordered(df, key) if sizes[key].update({(id(df), r[0]): r[1] for r in df.groupBy(key).count().collect()}) is None else None)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    monkeypatch.setattr(neardup, "_ordered", ordered)
    return sum(sizes["node"].values()) + sum(sizes["block"].values()), max([*sizes["node"].values(), *sizes["block"].values()]), got


@pytest.mark.parametrize(("kind", "chunk"), [("copies", 256), ("passage", 64)])
def test_rows_grow_with_the_input(spark, monkeypatch, kind, chunk):
    """Near copies of one text around the threshold, and unlike texts that share a passage: twice the rows, about twice the work."""
    monkeypatch.setattr(neardup, "LEAF", 16)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "SAMPLE", 32)
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(120)], []
    for k in range(800):
        if kind == "copies":
            text = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 6)):
                text[at] = word()
        else:
            text = base[:70] + [word() for _ in range(60)]
        rows.append((k, " ".join(text)))
    few, largest, _ = measured(spark, rows[:400], monkeypatch)
    many, largest_of_many, got = measured(spark, rows, monkeypatch)
    assert max(largest, largest_of_many) <= 3 * neardup.CHUNK
    assert many <= 2.6 * few, (few, many)
    assert got == brute(rows, 3, 85)[1]


def test_word_hashes_follow_words_alone():
    with np.errstate(over="ignore"):
        a = neardup._word_hashes(b"alpha beta  alpha\tgamma")
        b = neardup._word_hashes(b"   gamma alpha")
    assert a[0] == a[2] == b[1] and a[3] == b[0] and len(set(a.tolist())) == 3


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    expected = groups({n for x in links for n in x}, links)
    assert got == expected


def test_components_of_long_paths(spark):
    """The worst order of ids, and random ones: more hops than a label could walk in a bounded number of rounds."""
    rng = random.Random(10)
    paths, first = [[0, *range(300, 0, -1)]], 1000
    for _ in range(2):
        ids = list(range(first, first + 1000))
        rng.shuffle(ids)
        paths.append(ids)
        first += 1000
    links = [x for p in paths for x in zip(p, p[1:])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(p) for p in paths for n in p}


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((k, (centre + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.4])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k + j, rows[0][1], 0) for j in range(40)]
    k += 40
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [5.0], [1e30] * 24, [1e-30] * 24]
    return [*rows, *[(k + j, v, 0) for j, v in enumerate(odd)], (3, rows[3][1], rows[3][2])]


def test_vectors_without_id_or_with_one_id(spark):
    v, w = [1.0, 0.5, 0.25, 2.0], [-1.0, 3.0, 0.5, 0.0]
    rows = [(None, v, 0), (1, v, 0), (2, v, 0), (3, w, 0), (3, v, 0), (4, w, 1)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(None, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)])


def test_registered_query_on_planted_pairs(spark, tmp_path):
    """The query itself, on a table with pairs just at or above 0.93 and just below it, and a group of near copies."""
    import duckdb

    from loomgraph.llm import oracles, queries

    rng = np.random.default_rng(31)
    rows = []
    unit = lambda x: x / np.linalg.norm(x)
    for k in range(150):
        a, b = unit(rng.normal(size=64)), rng.normal(size=64)
        b = unit(b - (b @ a) * a)
        for c in (0.931, 0.9295, 0.96)[: 1 + k % 3]:
            rows += [a, c * a + np.sqrt(1 - c * c) * b]
    centre = unit(rng.normal(size=64))
    rows += [unit(centre + rng.normal(size=64) * 0.02) for _ in range(120)]
    table = [(k, x.astype(np.float32).tolist(), k % 2 if k < 100 else 3) for k, x in enumerate(rows)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op6_embedding_near_dedup(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({oracles.OP6})").fetchall()
    assert sum(r["n_links"] for r in got) > 10_000
    assert Counter(tuple(r) for r in got) == Counter(expected)


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 16)
    rows = vectors()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, n int")
    usable = {}
    for at, (i, v, label) in enumerate(rows):
        if label is not None and v and None not in v:
            x = np.array(np.float32(v), dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                usable[at] = (i, label, x / np.linalg.norm(x))
    n, links = defaultdict(int), []
    for a in usable:
        for b in usable:
            if a < b and usable[a][1] == usable[b][1] and len(usable[a][2]) == len(usable[b][2]) and usable[a][2] @ usable[b][2] >= 0.93:
                n[a] += 1
                n[b] += 1
                links.append((usable[a][0], usable[b][0]))
    component = groups({r[0] for r in rows}, links)
    got = lattice.near_vectors(df, 0.93).collect()
    expected = Counter((i, n[at], component[i], component[i] == i) for at, (i, _, _) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == expected
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    own = lattice.nearest_e8(x) / 2
    steps = lattice._STEPS / 2
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    assert (((x[:, None] - own[:, None] - steps[None]) ** 2).sum(axis=2) >= ((x - own) ** 2).sum(axis=1)[:, None] - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    frames = lattice.frames(64)
    met = (lattice.cells(a, frames)[:, :, :, None] == lattice.cells(b, frames)[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.999


def test_groups_stay_whole_after_a_skewed_join(spark):
    """A repartition by the key of a join is left out, and the join's skewed keys are dealt to several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(40_000).repartition(8).selectExpr("IF(id % 2 = 0, 7, id % 50) AS node", "id AS doc")
        right = spark.range(50).selectExpr("id AS node", "id AS size").distinct()
        seen = neardup._ordered(left.join(right, "node"), "node").mapInArrow(lambda batches: (neardup.pa.RecordBatch.from_arrays([neardup.pa.array(x["node"][:1])], names=["node"]) for x in neardup._groups(batches, "node")), "node long")
        assert sorted(r["node"] for r in seen.collect()) == list(range(1, 50, 2))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
