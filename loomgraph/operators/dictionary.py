"""Dictionary of terms: counts, codes, encoding and decoding."""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.tables import parts_for, written


def subject_object_counts(triples: DataFrame) -> DataFrame:
    """(term, freq) over subjects and objects."""
    return triples.select(F.explode(F.array("s", "o")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("p").alias("term")).agg(F.count(F.lit(1)).alias("freq"))


def ranked(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """(term, freq, code): codes from 0 in falling order of count, ties by term, so frequent terms have small codes.

    Rows are range-partitioned, sorted and numbered in their partition, once:
    the table is written, as bounds that are sampled anew for a second reading
    could part the rows otherwise. Partitions then add the rows before them, whose
    number is counted at once: the result only reads what is written.
    """
    n = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("freq").desc(), F.col("term")]
    # a partition's number in the upper bits, a row's number in its partition in the lower 33
    placed = written(counts.select("term", "freq").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition
    sizes = dict(placed.groupBy(part.cast("int").alias("__part")).agg(F.count(F.lit(1)).alias("__size")).collect())
    before = itertools.accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0)
    return placed.select("term", "freq", (F.element_at(F.array(*map(F.lit, before)), (part + 1).cast("int")) + low).cast("long").alias("code"))


def huffman_codes(counts: list[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """term -> (code, bits) of a Huffman tree over the counts: a path's bits from the lowest, 0 left, 1 right.

    For dictionaries that fit on the driver; huffman() makes codes at any size. Ties are broken by term, so codes are the same each time.
    """
    if not counts:
        return {}
    order = itertools.count()
    heap: list = [(freq, next(order), term) for term, freq in sorted(counts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], next(order), (a[2], b[2])))
    codes: dict[str, tuple[int, int]] = {}
    open_ = [(heap[0][2], 0, 0)]
    while open_:
        node, code, depth = open_.pop()
        if isinstance(node, str):
            codes[node] = (code, depth)
        else:
            open_ += [(node[0], code, depth + 1), (node[1], code | 1 << depth, depth + 1)]
    return codes


def huffman_lengths(classes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bits, n) from the shortest: n terms have codes of so many bits; classes are (freq, terms that have it).

    Huffman's method on groups of nodes of one weight. Different counts sum up to
    the statements at most, so there are few classes at any size.
    """
    left, made, heap = [n for _, n in classes], [[] for _ in classes], [(freq, k) for k, (freq, _) in enumerate(classes)]
    heapq.heapify(heap)
    while heap:
        freq, k = heapq.heappop(heap)
        if left[k] > 1:
            children, n, weight = [(k, 2)], left[k] // 2, 2 * freq
            left[k] %= 2
            again = [(freq, k)]
        elif heap:
            other, j = heapq.heappop(heap)
            children, n, weight = [(k, 1), (j, 1)], 1, freq + other
            left[k], left[j] = 0, left[j] - 1
            again = [(other, j)]
        else:
            break
        for entry in [*again, (weight, len(made))]:
            if entry[1] == len(made) or left[entry[1]]:
                heapq.heappush(heap, entry)
        left.append(n)
        made.append(children)
    # a group's nodes by depth, from the root down: children were made before their parents
    depths: list[dict[int, int]] = [{} for _ in made]
    total: dict[int, int] = {}
    for k in reversed(range(len(made))):
        if k == len(made) - 1:
            depths[k] = {0: 1}
        for child, per in made[k]:
            for depth, n in depths[k].items():
                depths[child][depth + 1] = depths[child].get(depth + 1, 0) + per * n
        if k < len(classes):
            for depth, n in depths[k].items():
                total[depth] = total.get(depth, 0) + n
        depths[k] = {}
    return sorted(total.items())


def huffman(counts: DataFrame, most: int | None = None) -> DataFrame:
    """(term, freq, code, bits) by Huffman's method, at any size; refuses dictionaries of more than `most` terms if that is given.

    Terms are ranked by falling count, so codes get longer with the rank: the
    driver sees how many terms have each count and gives spans of ranks their
    lengths. Codes are canonical; the first bit is the lowest, as in huffman_codes().
    """
    terms = ranked(counts)
    classes = [(r["freq"], r["n"]) for r in terms.groupBy("freq").agg(F.count(F.lit(1)).alias("n")).collect()]
    if most is not None and sum(n for _, n in classes) > most:
        raise ValueError(f"more than {most} terms; use ranked()")
    rank, bits, value = F.col("code"), F.lit(None), F.lit(None)
    spans, begin, code, before = [], 0, 0, 0
    for length, n in huffman_lengths(classes):
        code <<= length - before
        spans.append((begin + n, length, code - begin))
        begin, code, before = begin + n, code + n, length
    for end, length, shift in reversed(spans):
        bits, value = F.when(rank < end, length).otherwise(bits), F.when(rank < end, rank + shift).otherwise(value)
    coded = terms.select("term", "freq", value.cast("long").alias("__code"), bits.cast("int").alias("bits"))
    path = F.reverse(F.lpad(F.bin("__code"), F.col("bits"), F.lit("0")))
    return coded.select("term", "freq", F.when(F.col("bits") == 0, 0).otherwise(F.conv(path, 2, 10).cast("long")).cast("long").alias("code"), "bits")


#: Codes below this are of the most frequent terms, which are broadcast; so are predicates, if there are no more.
HOT = 1 << 17


def _few(predicates: DataFrame) -> DataFrame:
    return F.broadcast(predicates) if predicates.limit(HOT + 1).count() <= HOT else predicates


def _looked_up(rows: DataFrame, terms: DataFrame, column: str, given: str, wanted: str, n: int, split: bool = False) -> DataFrame:
    """rows with the column's values, one column of the dictionary, replaced by the other; rows without one go.

    Rows meet their part of the dictionary in n partitions and are not sorted.
    With split, those of the most frequent terms meet a broadcast part of it and
    are not sent around; rows are then read twice.
    """
    rest = [c for c in rows.columns if c != column]
    pairs = lambda of: of.select(F.col(given).alias(column), F.col(wanted).alias("__to"))
    met = lambda some, known: some.repartition(n, column).join(pairs(known).hint("shuffle_hash"), column)
    if split:
        hot = pairs(terms.where(F.col("code") < HOT))
        if given == "code":
            near, far = rows.where(F.col(column) < HOT), rows.where(F.col(column) >= HOT)
        else:
            near, far = rows, rows.join(F.broadcast(hot.select(column)), column, "left_anti")
        near = near.join(F.broadcast(hot), column)
        found = near.unionByName(met(far, terms.where(F.col("code") >= HOT)))
    else:
        found = met(rows, terms)
    return found.select(*rest, F.col("__to").alias(column))


def encode(triples: DataFrame, terms: DataFrame, predicates: DataFrame) -> DataFrame:
    """(s, p, o) in codes; statements with unknown terms go."""
    n = parts_for(triples)
    p = _few(predicates).select(F.col("term").alias("p"), F.col("code").alias("pc"))
    rows = triples.join(p, "p").select("s", F.col("pc").alias("p"), "o")
    rows = _looked_up(rows, terms, "o", "term", "code", n, split=True)
    return _looked_up(rows, terms, "s", "term", "code", n).select("s", "p", "o")


def decoded(codes: DataFrame, terms: DataFrame, predicates: DataFrame) -> DataFrame:
    """Coded statements as terms."""
    n = parts_for(codes)
    rows = _looked_up(codes, terms, "o", "code", "term", n, split=True)
    rows = _looked_up(rows, terms, "s", "code", "term", n)
    p = _few(predicates).select(F.col("code").alias("p"), F.col("term").alias("pt"))
    return rows.join(p, "p").select("s", F.col("pt").alias("p"), "o")


def decode(codes: DataFrame, terms: DataFrame, column: str = "id") -> DataFrame:
    """codes with the column's codes replaced by their terms."""
    rest = [c for c in codes.columns if c != column]
    return codes.join(terms.select(F.col("code").alias(column), "term"), column).select(*rest, F.col("term").alias(column))


def code_of(terms: DataFrame, term: str) -> int | None:
    """A constant's code; None if it is unknown."""
    row = terms.where(F.col("term") == term).select("code").first()
    return row["code"] if row else None
