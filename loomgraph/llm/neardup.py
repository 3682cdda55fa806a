"""Near-duplicate documents by chosen-path set similarity join.

A document's set holds the hashes of its distinct shingles, and its signature
the set's smallest token under each of HASHES hash functions; its sketch is one
byte of each of these. Documents with equal sets are one class, named by a hash
of the set. Trees of minwise tokens are grown over the classes: in TREES
independent trees a root has ROOTS paths of two chosen tokens, so a class goes
to one child for each. Small nodes, of LEAF classes at most, are compared
exhaustively by sketch; what is alike enough there is confirmed on the full
sets. Members of large nodes are first linked to the node's centre, the member
that agrees most with the node's most common sketch, in chunks. Then:

* a node whose members all have one component is settled and dropped;
* a node with CHUNK members at most outside its main component is compared:
  the main component's members need not meet each other, so pieces of them meet
  the others. A piece and the others are at most about 2 CHUNK rows, and all
  pieces together at most twice the node;
* every other node branches by one more chosen token, by two on every second
  level (BRANCHING), however it is made up, until all nodes are of these kinds.
  What is left after DEPTH levels is compared piece with piece, which is exact.

Two classes of similarity s share none of the paths with odds of
(1 - s^2)^(TREES * ROOTS): 2e-7 at 0.85, 5e-6 at 0.8. If all nodes branched to
any depth, the odds would stay below 6e-5 and 3e-3 (`loss` gives them; paths
choose among HASHES places, each path its own, so they are nearly independent).
Sketches, the same for all nodes, rule out a pair at the threshold with odds of
1e-7 at 0.85 and 1e-6 at 0.8 (bytes that are equal by chance only help).

Only links needed to connect components are kept, so results do not grow with
the square of a group. Sets that meet for confirmation hold TOKENS tokens at
most at a time, if no single one holds more.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; equal rows are in one class; rows with one doc_id and
different texts keep a row each; a null doc_id is a row that is linked with
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import WORD, by_batches, forget, trimmed, written
from loomgraph.llm.components import components

HASHES, TREES, ROOTS, DEPTH, LEAF, CHUNK = 128, 6, 2, 24, 64, 4096
#: Chosen tokens by which a node branches on the first, second, third ... level below the roots, repeating.
BRANCHING = (1, 2)
#: What a pair's share of equal places may lie below the threshold to be confirmed on full sets: 5 deviations or more.
ALIKE_SLACK = 0.18
SAMPLE = 256  # members that a large node's most common sketch is taken from
SALTS = 16  # tasks at least that the rows of one node are dealt to where they meet what is known of it
TOKENS = 1 << 22  # tokens of the sets that meet in one block
_rng = np.random.default_rng(20_240_611)
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_SPREAD = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-case UTF-8: sums of byte values times powers, from prefix sums."""
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    if len(_powers[0]) <= len(raw):
        n = 1 << len(raw).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers[0][: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text the one of all its words."""
    hashes = _word_hashes((text or "").encode().lower())
    n = min(words, len(hashes))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _PLACES[k]
    return np.unique(_mixed(total))


def signature(tokens: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(tokens), 2048):
        part = tokens[at : at + 2048]
        best = np.minimum(best, ((part[None, :] ^ _FLIP[:, None]) * _SPREAD[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype("<u4")


def sketch(places: np.ndarray) -> bytes:
    """One byte of each place of a signature."""
    return (places & np.uint32(0xFF)).astype(np.uint8).tobytes()


def loss(similarity: float, levels: int) -> float:
    """Odds that two sets of a similarity meet in no node if all their nodes branch on so many levels."""
    gone = 0.0
    for level in reversed(range(levels)):
        gone = (1 - similarity + similarity * gone) ** BRANCHING[level % len(BRANCHING)]
    return (1 - similarity**2 * (1 - gone)) ** (TREES * ROOTS)


def _name(tokens: np.ndarray) -> int:
    """64 bits that tell a set; with its size they name its class."""
    total = tokens.sum(dtype=np.uint64) * _PLACES[62] + _mixed(tokens * _PLACES[63]).sum(dtype=np.uint64)
    return int(_mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of id and text) and text of each row."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def described(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, n_shingles, the class, signature and sketch of its set."""

    def make():
        def of(texts: pa.Array) -> list[pa.Array]:
            n, names, signatures, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for text in texts:
                    tokens = shingle_set(text.as_py(), words)
                    n.append(len(tokens))
                    names.append(_name(tokens))
                    places = signature(tokens)
                    signatures.append(places.tobytes())
                    sketches.append(sketch(places))
            return [pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())]

        return of

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType())]
    return by_batches(rows, fields, make, ["doc_id", "row_key"])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch's numbers as arrays, sketches as rows of bytes, other bytes as objects."""
    found = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if not pa.types.is_binary(column.type):
            found[name] = column.to_numpy(zero_copy_only=False)
        elif name in ("sketch", "common"):
            found[name] = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        else:
            found[name] = column.to_numpy(zero_copy_only=False)
    return found


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of all rows with one key, from batches in which equal keys follow each other."""
    rest: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        if rest:
            columns = {k: np.concatenate([rest[k], v]) for k, v in columns.items()}
        keys = columns[key]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield {k: v[a:b] for k, v in columns.items()}
        rest = {k: v[cuts[-1] :] for k, v in columns.items()}
    if rest:
        yield rest


class _Union:
    def __init__(self, labels: np.ndarray):
        self.to = {x: x for x in labels.tolist()}

    def find(self, x: int) -> int:
        while self.to[x] != x:
            self.to[x] = self.to[self.to[x]]
            x = self.to[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.to[max(a, b)] = min(a, b)
        return a != b


def _alike(n: np.ndarray, sketches: np.ndarray, component: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Members with an alike sketch in another component, and for each a label of those that hang together."""
    if len(n) == 2:
        good = np.count_nonzero(sketches[0] == sketches[1]) >= (least - ALIKE_SLACK) * HASHES and n.min() >= (least - 1e-9) * n.max()
        return np.arange(2 * good), np.zeros(2 * good, dtype=np.int64)
    _, own, sizes = np.unique(component, return_inverse=True, return_counts=True)
    # a byte of all sketches after the other, so that equal ones are summed in few passes
    columns, need = np.ascontiguousarray(sketches.T), int(np.ceil((least - ALIKE_SLACK) * HASHES))
    label, involved = np.arange(len(n)), np.zeros(len(n), dtype=bool)
    for i in np.flatnonzero(own != sizes.argmax()):
        equal = (columns == columns[:, i : i + 1]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        js = np.flatnonzero((equal >= need) & (own != own[i]) & (np.minimum(n[i], n) >= (least - 1e-9) * np.maximum(n[i], n)))
        if len(js):
            involved[i] = involved[js] = True
            joined = np.unique(np.append(label[js], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    some = np.flatnonzero(involved)
    return some, label[some]


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """All rows with one key in one task, one after the other.

    Dealt by a hash of the key: a repartition by the key itself would be left
    out after a join by it, and a skewed join deals a key to several tasks.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key)


def _parts(n: np.ndarray) -> list[np.ndarray]:
    """Places of sets of sizes n, as they may meet: all together, or part with part where they hold more than TOKENS."""
    if n.sum() <= TOKENS:
        return [np.arange(len(n))]
    part = (np.cumsum(n) - n) // (TOKENS // 2)
    each = [np.flatnonzero(part == k) for k in np.unique(part)]
    return [np.concatenate([a, b]) if a is not b else a for k, a in enumerate(each) for b in (each[k + 1 :] or [a])]


def _to_confirm(nodes: DataFrame, least: float) -> DataFrame:
    """Of (node, doc, component, n_shingles, sketch): (block, doc, component) to confirm on full sets.

    A node's members with alike ones of another component fall into blocks of
    those that hang together; equal blocks of several nodes are one.
    """

    def rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(d) for _, d, _ in found]
        columns = [np.repeat(np.array([b for b, _, _ in found], dtype=np.int64), sizes), *(np.concatenate([np.zeros(0, dtype=np.int64), *(x[k] for x in found)]) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "doc", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for table in _groups(batches, "node"):
            doc, component, n = table["doc"], table["component"], table["n_shingles"]
            if len(doc) < 2 or (component == component[0]).all():
                continue
            some, label = _alike(n, table["sketch"], component, least)
            for value in np.unique(label):
                ks = some[label == value]
                ks = ks[np.argsort(doc[ks])]
                for part in _parts(n[ks]):
                    own = ks[part]
                    with np.errstate(over="ignore"):
                        block = int(_mixed(_mixed(doc[own].astype(np.uint64) + np.uint64(1)) * _PLACES[np.arange(len(own)) % 64]).sum(dtype=np.uint64).view(np.int64))
                    out.append((block, doc[own], component[own]))
            if sum(len(d) for _, d, _ in out) > 20_000:
                yield rows(out)
                out = []
        yield rows(out)

    return _ordered(nodes, "node").mapInArrow(trimmed(run), "block long, doc long, component long").distinct()


def _confirmed(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the blocks' members that full sets confirm, as many as join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "block"):
            doc, links = table["doc"], []
            tokens = [np.frombuffer(x, dtype="<u8") for x in table["tokens"]]
            n = np.array(list(map(len, tokens)))
            starts = np.cumsum(n) - n
            # tokens as numbers of the block's own vocabulary: one set is marked in it, and all are counted at once
            vocabulary, number = np.unique(np.concatenate(tokens), return_inverse=True)
            marked = np.zeros(len(vocabulary), dtype=bool)
            _, label, sizes = np.unique(table["component"], return_inverse=True, return_counts=True)
            for i in np.flatnonzero(label != sizes.argmax()):
                js = np.flatnonzero((label != label[i]) & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n)))
                if not len(js):
                    continue
                own = number[starts[i] : starts[i] + n[i]]
                marked[own] = True
                if 4 * len(js) > len(n):
                    shared = np.add.reduceat(marked[number], starts, dtype=np.int64)[js]
                else:
                    shared = np.array([np.count_nonzero(marked[number[starts[j] : starts[j] + n[j]]]) for j in js])
                marked[own] = False
                good = js[100 * shared >= percent * (n[i] + n[js] - shared)]
                if len(good):
                    joined, first = np.unique(label[good], return_index=True)
                    links += [(int(doc[i]), int(doc[j])) for j in good[first]]
                    label[np.isin(label, joined)] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # what is wanted grows with the corpus, so it is not broadcast while it is small either
    known = blocks.hint("shuffle_merge").join(sets, blocks["doc"] == sets["rep"]).select("block", "doc", "component", "tokens")
    return _ordered(known, "block").mapInArrow(trimmed(run), "a long, b long")


def _token(signature: Column, place: int) -> Column:
    return F.substring(signature, 4 * (place % HASHES) + 1, 4)


def _roots(signature: Column) -> Column:
    """The paths of two chosen tokens: (path number, node)."""
    paths = range(TREES * ROOTS)
    return F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.xxhash64(F.lit(k), _token(signature, 2 * k), _token(signature, 2 * k + 1)).alias("node")) for k in paths]))


def _branches(depth: int, path: Column, node: Column, signature: Column) -> Column:
    """A node's children (path, node): its path and one more chosen token each, at a place of that path alone."""
    used = 2 * TREES * ROOTS
    child = [path * n + k for n in [BRANCHING[(depth - 1) % len(BRANCHING)]] for k in range(n)]
    token = [signature.substr(4 * (used + F.pmod(F.xxhash64(F.lit(depth), c), F.lit(HASHES - used))).cast("int") + 1, F.lit(4)) for c in child]
    return F.explode(F.array(*[F.struct(c.alias("path"), F.xxhash64(F.lit(depth), c, node, t).alias("node")) for c, t in zip(child, token, strict=True)]))


def _centres(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, centre) of large nodes: the member that agrees most with the most common sketch of some members."""
    some = nodes.join(sizes, "node").where(F.pmod(F.xxhash64("doc", "node"), F.ceil(F.col("size") / SAMPLE)) == 0)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            sorted_ = np.sort(table["sketch"], axis=0)
            # the longest run of equal values in each place
            n, best, value = len(sorted_), np.zeros(HASHES, dtype=np.int64), sorted_[0].copy()
            run = np.ones(HASHES, dtype=np.int64)
            best[:] = 1
            for k in range(1, n):
                run = np.where(sorted_[k] == sorted_[k - 1], run + 1, 1)
                value = np.where(run > best, sorted_[k], value)
                best = np.maximum(best, run)
            yield pa.RecordBatch.from_arrays([pa.array(table["node"][:1]), pa.array([value.tobytes()], pa.binary())], names=["node", "common"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _columns(batch)
            equal = (table["sketch"] == table["common"]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal, pa.int64())], names=["node", "doc", "equal"])

    made = _ordered(some.select("node", "sketch"), "node").mapInArrow(trimmed(common), "node long, common binary")
    judged = nodes.join(made, "node").select("node", "doc", "sketch", "common").mapInArrow(trimmed(agree), "node long, doc long, equal long")
    return judged.groupBy("node").agg(F.max_by("doc", F.struct("equal", "doc")).alias("centre"))


def _sets(rows: DataFrame, reps: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep and tokens (the sorted set) of the wanted classes, written."""

    def make():
        last: list = [None]

        def of(texts: pa.Array) -> list[pa.Array]:
            names, tokens = [], []
            with np.errstate(over="ignore"):
                for text in texts:
                    text = text.as_py()
                    if text == last[0]:  # a repeated row: the join puts it after the first
                        names.append(None)
                        tokens.append(None)
                        continue
                    last[0] = text
                    found = shingle_set(text, words)
                    names.append(_name(found))
                    tokens.append(found.astype("<u8").tobytes())
            return [pa.array(names, pa.int64()), pa.array(tokens, pa.binary())]

        return of

    keys = wanted.join(reps.select(F.col("rep").alias("doc"), "row_key"), "doc").select(F.col("doc").alias("rep"), "row_key")
    texts = rows.select("row_key", "text").join(keys.hint("shuffle_merge"), "row_key")
    made = by_batches(texts, [T.StructField("class", T.LongType()), T.StructField("tokens", T.BinaryType())], make, ["rep"])
    return written(made.where(F.col("class") == F.col("rep")).drop("class"))


def _chunked(starred: DataFrame) -> DataFrame:
    """Of (centre, doc): blocks (block, doc, component) of a centre and some of its members each."""
    pieces = starred.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / (LEAF - 1)).alias("pieces"))
    dealt = starred.join(pieces, "centre").withColumn("block", F.xxhash64("centre", F.pmod(F.xxhash64("doc"), F.col("pieces"))))
    heads = dealt.select("block", F.col("centre").alias("doc")).distinct()
    return dealt.select("block", "doc").union(heads).withColumn("component", F.col("doc"))


def _unsettled(large: DataFrame, reps: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of large nodes (node, doc, path): what to compare exhaustively (node, doc, component), and the tables that it is read from."""
    current = large.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    every, tables = None, []
    zero, salt = F.lit(0).cast("long"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    for depth in range(1, DEPTH + 1):
        # members by component first, so a hot node is summed before it is shuffled
        by_component = current.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
        stats = by_component.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        salted = stats.drop("parts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = written(current.withColumn("salt", salt).join(salted, ["node", "salt"]).drop("salt"))
        tables.append(held)
        # the main component's members in pieces, each with all the others
        few, pieces = F.col("size") - F.col("most") <= CHUNK, F.ceil(F.col("most") / CHUNK)
        to = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("doc"), pieces))).otherwise(F.sequence(zero, pieces - 1))
        # after the last level, piece with piece
        blocks = F.ceil(F.col("size") / CHUNK)
        mine = F.pmod(F.xxhash64("doc"), blocks)
        pairs = F.transform(F.sequence(zero, blocks - 1), lambda x: F.least(mine, x) * 1_000_003 + F.greatest(mine, x) + 1_000)
        shown = held if depth == DEPTH else held.where(few)
        part = shown.withColumn("piece", F.explode(F.when(few, to).otherwise(pairs))).select(F.xxhash64("node", "piece").alias("node"), "doc", "component")
        every = part if every is None else every.union(part)
        rest = held.where(~few)
        if depth == DEPTH or rest.isEmpty():
            return every, tables
        signed = rest.select("node", "doc", "component", "path").join(reps.select(F.col("rep").alias("doc"), "signature"), "doc")
        current = signed.select("doc", "component", _branches(depth, F.col("path"), F.col("node"), F.col("signature")).alias("at")).select("doc", "component", "at.path", "at.node")


def _classes(docs: DataFrame, words: int, percent: int, usable: Column) -> tuple[DataFrame, DataFrame]:
    """A row for each of docs (doc_id, row_key, n_shingles, class), and (class, n_shingles, first) for the classes of usable rows.

    first is the least row of the class's component: (no_id, doc_id, row_key), rows without id last.
    """
    least, given = percent / 100, rows_of(docs)
    known = written(described(given, words))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    firsts = known.where(usable & (F.col("n_shingles") > 0)).groupBy("class", "n_shingles").agg(F.min_by(F.struct(row.alias("first"), "signature", "sketch"), row).alias("r"))
    reps = written(firsts.select(F.col("class").alias("rep"), "n_shingles", F.col("r.first").alias("first"), F.col("r.first.row_key").alias("row_key"), F.col("r.signature").alias("signature"), F.col("r.sketch").alias("sketch")))
    told = reps.select(F.col("rep").alias("doc"), "n_shingles", "sketch")
    roots = written(reps.select(F.col("rep").alias("doc"), _roots(F.col("signature")).alias("at")).select("doc", "at.path", "at.node"))
    sizes = roots.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    nodes = written(roots.join(sizes, "node"))
    forget(roots)

    # small nodes are compared exhaustively; members of large ones with the centre of their node, in chunks
    small = nodes.where(F.col("size") <= LEAF).select("node", "doc")
    large = nodes.where(F.col("size") > LEAF).select("node", "doc", "path", "size")
    centres = written(_centres(large.select("node", "doc").join(told, "doc"), large.select("node", "size").distinct()))
    starred = written(large.join(centres, "node").where("doc != centre").select("centre", "doc").distinct())
    chunks = _chunked(starred).select(F.col("block").alias("node"), "doc")
    met = small.union(chunks).withColumn("component", F.col("doc")).join(told, "doc")
    alike = written(_to_confirm(met, least))
    sets = _sets(given, reps, alike.select("doc").distinct(), words)
    first = written(_confirmed(alike, sets, percent))
    labels = components(first)

    # what these links leave open in large nodes
    open_, tables = _unsettled(large.select("node", "doc", "path"), reps, labels)
    left = written(_to_confirm(open_.join(told, "doc"), least))
    more = _sets(given, reps, left.select("doc").distinct().join(sets.select(F.col("rep").alias("doc")), "doc", "left_anti"), words)
    second = written(_confirmed(left, sets.unionByName(more), percent))
    final = components(first.union(second))

    # a component's least row; classes without links are components of their own
    linked = final.join(reps.select(F.col("rep").alias("node"), "first"), "node")
    leasts = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = final.join(leasts, "component").select(F.col("node").alias("rep"), "least")
    classes = written(reps.join(found, "rep", "left").select(F.col("rep").alias("class"), "n_shingles", F.coalesce("least", "first").alias("first")))
    rows = written(known.select("doc_id", "row_key", "n_shingles", "class"))
    forget(known, reps, nodes, centres, starred, alike, sets, first, labels, *tables, left, more, second, final)
    return rows, classes


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    rows, classes = _classes(docs, words, percent, F.col("doc_id").isNotNull())
    joined = rows.join(classes, ["class", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("first.doc_id"), F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; columns as they are.

    Rows are told by id and text: the row with the smallest id of a group stays,
    one without id if there is no other, and of rows alike in both any one. Rows
    that share an id but not their texts are rows of their own. Rows without
    words stay.
    """
    _, classes = _classes(docs, words, percent, F.lit(True))
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), text))
    stay = classes.select(F.col("first.row_key").alias("__row")).distinct()
    worded = F.coalesce(text.rlike(WORD), F.lit(False))
    return keyed.where(worded).join(stay, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row").unionByName(docs.where(~worded))
