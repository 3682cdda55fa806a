"""Sharding by vector bin packing of bytes, tokens and rows.

Documents with equal texts form a group, and a group goes to one shard as a
whole unless it exceeds a shard's room in bytes, tokens or rows; then it is cut
into pieces of a quarter of that room. What is placed is a group that holds more
than one UNITS-th of all bytes, tokens or rows, or such a piece, or the small
groups of one of UNITS hash buckets together. So the driver packs a number of
items that does not grow with the corpus: in falling order of size, each into
the shard where the dot product of its vector with the shard's residual capacity
is highest. Swaps then even out the bytes. The law that holds is `bytes`:
shards' sizes are near equal.

Slots are numbered lot by lot: a large group has several lots, dealt by row, so
that no task numbers a large share of all rows.

Defined cases: a null text counts as an empty one of size 1; equal rows are
rows of their own; rows with null doc_id are placed like others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import n_words, written

SHARDS, UNITS = 16, 8192
#: Pieces of a group that exceeds a shard's room are of one so-manieth of it.
PIECES = 4


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; vectors has a row (bytes, tokens, rows) for each unit."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1) * shards
    room = np.ones((shards, vectors.shape[1]))
    of = np.zeros(len(vectors), dtype=np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        fits = (room - share[k] >= -1e-12).all(axis=1)
        score = room @ share[k]
        # where it fits nowhere, the least overfull shard takes it
        best = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax((room - share[k]).min(axis=1))
        of[k] = best
        room[best] -= share[k]
    return of


def even_out(sizes: np.ndarray, of: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Moves a unit, or swaps two, between the fullest and the emptiest shard while that brings them closer."""
    of, load = of.copy(), np.bincount(of, weights=sizes, minlength=shards)
    for _ in range(rounds):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        ours, theirs = np.flatnonzero(of == high), np.flatnonzero(of == low)
        # the size that should go over; a zero stands for no unit in return
        give, take = sizes[ours], np.append(sizes[theirs], 0.0)
        order = np.argsort(take)
        want = give - gap / 2
        at = np.clip(np.searchsorted(take[order], want), 0, len(take) - 1)
        at = np.where((at > 0) & (np.abs(take[order][at - 1] - want) < np.abs(take[order][at] - want)), at - 1, at)
        moved = give - take[order][at]
        best = int(np.argmin(np.abs(moved - gap / 2)))
        if not 0 < moved[best] < gap:
            break
        of[ours[best]] = low
        if order[at[best]] < len(theirs):
            of[theirs[order[at[best]]]] = high
        load[high] -= moved[best]
        load[low] += moved[best]
    return of


def place(lots: pd.DataFrame, shards: int) -> np.ndarray:
    """The shard of each lot (unit, group, size, tokens, n): lots of one group together, if they fit into one shard."""
    if not len(lots):
        return np.zeros(0, dtype=np.int64)
    vectors = lots[["size", "tokens", "n"]].to_numpy(float)
    share = vectors / np.maximum(vectors.sum(axis=0), 1) * shards
    item = np.arange(len(lots))
    for rows in lots.groupby("group").indices.values():  # lots without a group are items of their own
        whole = share[rows].sum(axis=0).max()
        # one item, or pieces of lots that follow each other
        piece = np.zeros(len(rows), dtype=np.int64) if whole <= 1 else (share[rows].max(axis=1).cumsum() * PIECES).astype(np.int64)
        item[rows] = rows[np.unique(piece, return_index=True)[1][np.unique(piece, return_inverse=True)[1]]]
    _, item = np.unique(item, return_inverse=True)
    items = np.zeros((item.max() + 1, 3))
    np.add.at(items, item, vectors)
    return even_out(items[:, 0], pack(items, shards), shards)[item]


def shard(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: that is another law's)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    base = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            n_words(text).alias("tokens"),
            F.xxhash64(raw).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = base.groupBy("text_key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("tokens", F.greatest("tokens", F.lit(0)))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    part = F.greatest(*[F.col(c) * float(units) / max(total[c], 1) for c in ("size", "tokens", "n")])
    # each of these holds over one units-th of a total: three times units of them at most
    cut = groups.where((part > 1) & (F.col("n") > 1)).select("text_key", F.ceil(F.least(part, F.col("n").cast("double"))).cast("long").alias("lots"))
    # by row, as a group's rows may all have one id
    spread = F.xxhash64("row", "text_key")
    lot = F.when(F.col("lots").isNull(), F.pmod(F.xxhash64("text_key", F.lit(7)), F.lit(units))).otherwise(
        units + F.pmod(F.xxhash64("text_key", F.pmod(spread, F.col("lots"))), F.lit(1 << 48))
    )
    placed = base.join(F.broadcast(cut), "text_key", "left").withColumn("unit", lot).withColumn("group", F.when(F.col("lots").isNotNull(), F.col("text_key")))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    vectors = placed.groupBy("unit", "group").agg(*sums).orderBy("unit", "group").toPandas()
    vectors["shard"] = place(vectors, shards)
    vectors["first"] = vectors.groupby("shard")["n"].cumsum() - vectors["n"]
    rows = [(int(u), int(s), int(f)) for u, s, f in vectors[["unit", "shard", "first"]].itertuples(index=False)]
    where = spark.createDataFrame(rows, "unit long, shard int, first long")
    within = Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size")
    return placed.join(F.broadcast(where), "unit").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
