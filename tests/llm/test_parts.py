"""Sharding, mixing, the pipeline and the queries' SQL."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from loomgraph.llm import common, mixing, registry, sharding

DATA = Path("/root/testdata/sf0.001")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_sharding_laws(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(9)
    rows = [*odd_rows, *[(1000 + k, "hot copy " * 9) for k in range(400)], *[(2000 + k, "w " * rng.randrange(1, 90)) for k in range(400)]]
    got = sharding.shard(spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, unit int, shard string")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in got:
        groups[r["text_crc32"]] += r["size"] if r["text_crc32"] != zlib.crc32(b"hot copy " * 9) else 0
    largest = max(groups.values())
    assert max(load.values()) - min(load.values()) <= max(largest, 0.01 * sum(load.values()))
    assert Counter(map(tuple, sharding.shard(odd_docs).collect())) == Counter(map(tuple, sharding.shard(odd_docs).collect()))
    assert sharding.shard(no_docs).count() == 0


def test_groups_stay_whole_unless_they_exceed_a_shard(spark):
    """Equal texts lie in one shard; a group of a third of all rows is cut, and balance holds all the same."""
    rng = random.Random(11)
    rows = [(k, f"text {rng.randrange(120)} " * 6) for k in range(2400)] + [(5000 + k, "hot copy " * 9) for k in range(1200)] + [(7000 + k, f"single {k} " * rng.randrange(1, 9)) for k in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards, load, count = defaultdict(set), Counter(), Counter()
    hot = zlib.crc32(b"hot copy " * 9)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
        load[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert all(len(s) == 1 for c, s in shards.items() if c != hot) and len(shards[hot]) >= 6
    assert max(load.values()) <= 1.01 * min(load.values()) and max(count.values()) <= 1.5 * min(count.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_registered_sharding_by_brute_force(spark):
    """Sizes, checks, slots, law and groups of the query itself."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["op8_sharding"](spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    shards, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * max(load.values())


def test_packing_balances_all_dimensions():
    rng = np.random.default_rng(2)
    vectors = np.stack([rng.integers(1, 100, 500), rng.integers(1, 20, 500), np.ones(500)], axis=1).astype(float)
    of = sharding.pack(vectors, 8)
    loads = np.stack([np.bincount(of, weights=vectors[:, k], minlength=8) for k in range(3)])
    assert (loads.max(axis=1) <= 1.06 * loads.mean(axis=1)).all()
    even = sharding.even_out(vectors[:, 0], of, 8)
    load = np.bincount(even, weights=vectors[:, 0], minlength=8)
    assert load.max() - load.min() <= 2


def targets(sizes):
    """Shares by weight with caps, shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 3, 200, 700]))), rng.choice([None, "a", "b", "b", "b", "c", "é", "z"])) for k in range(600)]
    rows += [(600, "tiny", "only"), (601, None, "none"), (602, "x y z", "b"), (602, "x y z", "b"), (None, "no id", "a")]
    return rows, spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, source string, size string, target double")


def test_mixing(spark, no_docs):
    rows, df = corpus(spark)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    expected = targets(dict(sizes))
    got = mixing.allot(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.allot(df.repartition(5)).collect()))
    numbers = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    for s, n in sizes.items():
        own = [r for r in got if r["source_no"] == numbers[s]]
        assert {r["source_size"] for r in own} == {n}
        assert own[0]["target"] == pytest.approx(expected[s])
        assert abs(sum(r["taken"] for r in own) - expected[s]) <= 2 * mixing.BLOCK
    assert mixing.allot(no_docs).count() == 0


def test_slots_are_permutations_and_counts_add_up(spark):
    sizes = spark.createDataFrame([("a", 64 * 101), ("b", 64 * 7), ("c", 64 * 5000)], "source string, source_size long")
    plan = mixing.plan_sources(sizes).cache()
    drawn = defaultdict(list)
    for r in mixing.slots(plan).collect():
        drawn[r["source_no"]].append(r["block"])
    per_shard = Counter()
    for r in mixing.shard_counts(plan).collect():
        per_shard[r["source_no"]] += r["slots"]
    for r in plan.collect():
        uses = Counter(drawn[r["source_no"]])
        n = r["end_slot"] - r["first_slot"]
        assert sum(uses.values()) == n == per_shard[r["source_no"]]
        assert set(uses) <= set(range(r["blocks"]))
        assert {n // r["blocks"], -(-n // r["blocks"])} >= {uses[b] for b in range(r["blocks"])}


def test_taken_words_follow_from_the_slots(spark):
    """taken by brute force: a source's words in the order of its documents, cut into blocks, each as often as slots have it."""
    rows, df = corpus(spark, seed=5)
    df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in mixing.allot(df, buckets=7).collect()}
    place = {r["doc_id"]: r["b"] for r in df.select("doc_id", mixing.F.pmod(mixing.F.xxhash64("doc_id", mixing.n_words(mixing.F.col("text"))), mixing.F.lit(7)).alias("b")).collect()}
    of, sizes = {r["doc_id"]: (r["source"], words(r["text"])) for r in df.collect()}, Counter()
    for s, n in of.values():
        sizes[s] += n
    plan = mixing.plan_sources(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    numbers = {r["source"]: r["source_no"] for r in plan.collect()}
    uses = Counter((r["source_no"], r["block"]) for r in mixing.slots(plan).collect())
    for source in sizes:
        at = 0
        for i in sorted((i for i in of if of[i][0] == source), key=lambda i: (place[i], i)):
            taken = sum(uses[numbers[source], w // mixing.BLOCK] for w in range(at, at + of[i][1]))
            assert got[i]["taken"] == taken
            at += of[i][1]


def test_shards_counts_are_draws(spark):
    """Counts differ between shards as a multinomial draw's do, and add up to the totals."""
    sizes = spark.createDataFrame([("a", 64 * 3000), ("b", 64 * 3000), ("c", 64 * 3000)], "source string, source_size long")
    plan = mixing.plan_sources(sizes).cache()
    counts = mixing.shard_counts(plan).collect()
    total = {r["source_no"]: r["end_slot"] - r["first_slot"] for r in plan.collect()}
    n = sum(total.values())
    for k, t in total.items():
        own = [r["slots"] for r in counts if r["source_no"] == k]
        assert sum(own) == t
        spread = np.var([*own, *[0] * (mixing.SHARDS - len(own))]) / (n / mixing.SHARDS * (t / n) * (1 - t / n))
        assert 0.5 < spread < 1.7


def test_mix_keeps_columns_and_texts(spark):
    rows, df = corpus(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    kept = mixed.collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in kept} <= set(rows)
    assert max(Counter(r["doc_id"] for r in kept).values()) <= 6  # two rows share an id


def test_pipeline(spark):
    """Each stage's decisions on its own input, on a small corpus with a case for each."""
    path = DATA
    if not path.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "minhash_near_dedup", "mixing", "byte_bpe"]
    extra = spark.createDataFrame([(10**6, "12 34 56", None, "s", 8), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    current = docs.unionByName(extra)
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(path)).cache()
        if k < 4:
            assert out.columns == docs.columns
            assert out.exceptAll(current).count() == 0 or names[k] == "mixing"
        outs.append(out)
        current = out
    ids = [{r["doc_id"] for r in o.select("doc_id").collect()} for o in outs]
    assert not ids[0] & {10**6, 10**6 + 1}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{path}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{path}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & ids[0] - ids[1]) <= 1 and len(toxic & ids[1]) <= len(toxic) // 2
    assert ids[2] <= ids[1] and ids[3] <= ids[2] == {r["doc_id"] for r in outs[2].collect()} and ids[4] == ids[3]
    assert outs[4].count() == outs[3].count()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = registry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    expected = con.sql(registry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(expected)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_registered_queries():
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.queries()} == set(map(str, range(1, 11)))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run_drops_near_copies_and_keeps_texts(spark, tmp_path, monkeypatch):
    """run() on planted near copies: stage 3 by brute force on its own input, stage 5 by what its tokens decode to."""
    from test_dedup import brute

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    copies = docs.where("doc_id % 9 = 0").withColumn("doc_id", docs["doc_id"] + 10**7).withColumn("text", corpus_pipeline.F.concat("text", corpus_pipeline.F.lit(" one more ending")))
    docs.unionByName(copies).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(DATA / "labels.parquet")).write.parquet(str(tmp_path / "labels.parquet"))
    outs = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, write=corpus_pipeline.written: outs.append(write(df)) or outs[-1])
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert len(outs) == 4
    given = [(r["doc_id"], r["text"]) for r in outs[1].collect()]
    _, component = brute(given, 5, 80)
    assert len(set(component.values())) < len(component)
    assert Counter(r["doc_id"] for r in outs[2].collect()) == Counter(set(component.values()))
    assert Counter(r["decoded"] for r in corpus_pipeline.bpe.decode(last).collect()) == Counter(r["text"] or "" for r in outs[3].collect())


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Null and repeated rows, ties, long texts and columns with clashing names go through every stage; so does an empty table."""
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (odd_docs.withColumn("lang_pred", mixing.F.lit("x")).withColumn("taken", mixing.F.lit(1)), no_docs):
        current, before = given, {r["text"] for r in given.collect()}
        for _, stage in corpus_pipeline.STAGES[:4]:
            current = stage(spark, current, str(tmp_path)).cache()
            assert current.columns == given.columns and {r["text"] for r in current.collect()} <= before
        last = corpus_pipeline.STAGES[4][1](spark, current, str(tmp_path))
        assert last.count() == current.count()


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="no memory figures")
def test_workers_give_back_what_a_task_held(spark):
    """A worker that is idle after a task with 120 MB of small objects holds little of them, though one object stays behind them."""

    def own_mb(pid):
        return sum(map(int, re.findall(r"\n(?:Private_Dirty|Swap):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024

    def make():
        before, held = own_mb(os.getpid()), []

        def of(texts):
            held.extend(bytes([k % 256]) * 2000 for k in range(60_000))
            pa.stays = bytes([len(held) % 256]) * 2000
            return [pa.array([os.getpid()]), pa.array([before]), pa.array([own_mb(os.getpid())])]

        return of

    fields = [T.StructField("pid", T.LongType()), T.StructField("before", T.DoubleType()), T.StructField("during", T.DoubleType())]
    row = common.by_batches(spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1), fields, make, ["doc_id"]).collect()[0]
    assert row["during"] > row["before"] + 100
    assert own_mb(row["pid"]) < row["during"] - 90


def test_stages_send_a_text_once(spark, odd_docs):
    """The column that a function reads is the one that stays, not a second one beside it; a text of another type has its own."""
    fields = [T.StructField("n", T.LongType()), T.StructField("columns", T.LongType())]
    seen = []

    class Frame:
        """Notes the columns that go to Python."""

        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def select(self, *columns):
            return Frame(self.df.select(*columns))

        def mapInArrow(self, run, schema):
            seen.append(self.df.columns)
            return self.df.mapInArrow(run, schema)

    make = lambda: lambda texts: [pa.array([len(t.as_py() or "") for t in texts], pa.int64()), pa.array([0] * len(texts), pa.int64())]
    got = common.by_batches(Frame(odd_docs), fields, make, ["doc_id", "text", "lang"]).collect()
    assert seen == [["doc_id", "text", "lang"]]
    assert all(r["n"] == len(r["text"] or "") for r in got) and len(got) == odd_docs.count()
    numbers = common.by_batches(Frame(odd_docs), fields, make, ["n_chars", "lang"], "n_chars").collect()
    assert seen[1] == ["n_chars", "lang", "__text"] and all(r["n"] == len(str(r["n_chars"])) for r in numbers)


def test_pipeline_sends_texts_once(spark, odd_docs, tmp_path):
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        plan = stage(spark, odd_docs, str(tmp_path))._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" in plan and "__text" not in plan
