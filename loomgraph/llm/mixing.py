"""Mixing sources to target weights, by DataFrame and SQL functions alone.

A source's words, in the order of its documents (by hashed bucket, then id),
are packed into blocks of BLOCK words. A source has as many output slots as its
target has blocks. Every output shard's counts of the sources are one
multinomial draw, given these totals: all slots, source after source, are dealt
to the shards by a pseudorandom permutation, and the slots that a shard gets of
each source are counted. Plain draws would let a source stray from its target
by the root of its count. From the counts alone, a source's slots are numbered
shard by shard and mapped to its blocks by pseudorandom permutations of the
block numbers (swap-or-not rounds), one for each pass over the source, and the
blocks are joined by their number.

Targets: weights 5, 2, 1, repeating over the sources by code point, null last;
no target exceeds CAP times its source's size, and what that leaves is shared
again by weight. No block, and so no document, is used more than CAP times.

Defined cases: a null text has no words and is never taken; a source without
words has target 0; equal rows are rows of their own; no rows give no rows;
other columns are ignored, or kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import n_words, written

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK, SHARDS, BUCKETS, ROUNDS, SEED = 64, 64, 1024, 16, 20_240_501
#: Slots made from one row at most, so that no array grows with a source.
STEP = 4096


def plan_sources(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of (source, source_size): source_no, weight, target, blocks, first and last slot on the line.

    One task: its rows are the sources, tens of bytes each, not documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("source_no") % len(WEIGHTS) + 1)
    s = sizes.withColumn("source_no", F.row_number().over(ordered) - 1).withColumn("weight", w.cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.lit(CAP) * F.col("source_size") / F.col("weight")).asc(), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = (
        s.withColumn("full", F.sum("source_size").over(everything))
        .withColumn("left_words", F.col("full") - F.coalesce(F.sum(CAP * F.col("source_size")).over(before), zero))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        # the share of one unit of weight once all sources before this one are at their cap
        .withColumn("unit", F.col("left_words") / F.col("left_weight"))
        .withColumn("open", F.col("unit") * F.col("weight") <= CAP * F.col("source_size"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.struct((F.lit(CAP) * F.col("source_size") / F.col("weight")).alias("r"), "source_no", "unit"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("first_open.unit") * F.col("weight"), (CAP * F.col("source_size")).cast("double")), F.lit(0.0)))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        .withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
        .withColumn("high", F.round(F.sum("expected").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
        .withColumn("first_slot", F.coalesce(F.lag("high").over(ordered), zero))
        .withColumn("end_slot", F.least(F.col("high"), F.col("first_slot") + CAP * F.col("blocks")))
    )
    return s.select("source", "source_no", "source_size", "weight", "target", "blocks", "first_slot", "end_slot")


def shard_counts(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source_no, blocks, output shard, the number of slots drawn for it, and of the source's slots before it."""
    n = sources.agg(F.coalesce(F.max("end_slot"), F.lit(0)).alias("n")).first()["n"]
    drawn = _spans(sources.where(F.col("end_slot") > F.col("first_slot")), F.col("first_slot"), F.col("end_slot"), ["source_no", "blocks"])
    dealt = drawn.select("source_no", "blocks", F.pmod(F.expr(_permuted("slot", f"{n}L", "7")), F.lit(shards)).cast("int").alias("out_shard"))
    counts = dealt.groupBy("source_no", "blocks", "out_shard").agg(F.count(F.lit(1)).alias("slots"))
    before = Window.partitionBy("source_no").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def _spans(rows: DataFrame, start: Column, end: Column, keep: list[str]) -> DataFrame:
    """keep and slot: a row for each number from start to before end, made STEP at a time by all tasks."""
    spans = F.explode(F.sequence(start, end - 1, F.lit(STEP)))
    each = F.explode(F.sequence("__span", F.least(F.col("__span") + STEP, F.col("__end")) - 1))
    # by number, as these few small rows would otherwise be put into one task
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keep, end.alias("__end"), spans.alias("__span")).repartition(n, *keep, "__span").select(*keep, each.alias("slot"))


def slots(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each output slot: out_shard, source_no, block; made from the shards' counts."""
    counts = shard_counts(sources, shards)
    numbered = _spans(counts, F.col("before"), F.col("before") + F.col("slots"), ["source_no", "blocks", "out_shard"])
    return numbered.select("out_shard", "source_no", F.expr(_permuted("slot % blocks", "blocks", "source_no", "floor(slot / blocks)")).alias("block"))


def _permuted(x: str, n: str, *key: str) -> str:
    """SQL for a pseudorandom permutation of 0 to n - 1: in each round a number and its mirror swap or not."""
    keys = ", ".join(key)
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('x', {x}, 'y', 0L), (a, r) -> named_struct(
        'x', CASE WHEN (xxhash64({SEED}, {keys}, r, greatest(a.x, pmod(pmod(xxhash64({keys}, r, {SEED}), {n}) - a.x, {n}))) & 1) = 1
             THEN pmod(pmod(xxhash64({keys}, r, {SEED}), {n}) - a.x, {n}) ELSE a.x END, 'y', 0L), a -> a.x)"""


def allot(docs: DataFrame, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken; and the plan's number for each source."""
    # size and place of each document; texts are not needed again
    base = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int")))
    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = written(plan_sources(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), block))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    known = starts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "start", "source_no", "source_size", "target")
    known = known.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_no", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        base.withColumn("upto", F.sum("size").over(within))
        .join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select("doc_id", "size", "source_no", "source_size", "target", (F.col("start") + F.col("upto") - F.col("size")).alias("at"))
    )
    # a document's part of each block that it reaches into
    spanned = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    parts = placed.withColumn("block", F.explode_outer(spanned)).withColumn(
        "words", F.coalesce(F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block), F.lit(0))
    )
    uses = slots(sources).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    some = (
        parts.where("size > 0").join(uses.hint("shuffle_merge"), ["source_no", "block"], "left")
        .groupBy("doc_id", "size", "source_no", "source_size", "target", "at")
        .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    )
    columns = ["doc_id", "size", "source_size", "target", "taken", "source_no"]
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.select(columns).unionByName(none.select(columns))


def mix(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: each as many times as its words are taken, a rest by the odds of its hash.

    Columns and texts stay as they are.
    """
    shares = allot(docs).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    # rows with one id and size are one for this: their shares add up and are spread over them
    shares = shares.where("__size > 0").groupBy("__id", "__size").agg(F.sum("__taken").alias("__taken"), F.count(F.lit(1)).alias("__rows"))
    sized = docs.withColumn("__n", n_words(F.col("text").cast("string")))
    share = F.col("__taken") / (F.col("__size") * F.col("__rows"))
    odds = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor(share) + (odds < share - F.floor(share)).cast("long")).cast("int")
    joined = sized.join(shares, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")))
    return joined.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*[F.col(f"`{c}`") for c in docs.columns])
