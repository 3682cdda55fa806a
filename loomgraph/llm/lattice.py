"""Near-duplicate vectors by lattice hashing.

In each of TABLES tables a vector of unit length is projected by a random
orthonormal frame to eight dimensions, scaled, and decoded to the nearest point
of the lattice E8: the better of the nearest points of D8 and of D8 shifted by
one half. The vector goes to that cell and to those of its PROBES nearest
neighbouring points. Only ids travel to the cells, with BITS signs of random
projections; of vectors whose signs are alike there, those that hang together
form blocks. Equal blocks of several cells are one, and for each block its
members' vectors are fetched and compared by cosine in double precision.

A pair that shares several cells counts in the first alone, so links are
counted exactly and no table of pairs is made: a comparison gives each vector's
number of links, and as many links as connect components. Large cells are
compared piece by piece; there is no cap on cells. How many vectors of a label
share a cell grows with their number: finer cells come with a larger SCALE and
more TABLES.

At cosine 0.93 a pair of 64 dimensions shares no cell with odds below 1e-3, and
its signs rule it out with odds of 1e-6 (five deviations).

Equal vectors of one label are one class with a multiplicity.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component, or whose label is null, is linked with nothing; vectors of different
lengths are not compared; equal rows are linked with each other; a row with a
null vec_id is linked with nothing; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, written
from loomgraph.llm.components import components
from loomgraph.llm.neardup import _groups, _mixed, _ordered, _Union

TABLES, PROBES, SCALE, BITS, CHUNK, SEED = 5, 3, 2.0, 128, 4096, 20_240_701


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Twice the nearest point of E8 for each row, in whole numbers."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(axis=1)
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
        return near

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(better[:, None], half, whole)).astype(np.int64)


def _shortest() -> np.ndarray:
    """Twice the 240 shortest vectors of E8: two places of plus or minus one, or halves with an even number of minus signs."""
    found = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = np.zeros(8, dtype=np.int64)
                    v[i], v[j] = a, b
                    found.append(v)
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    return np.concatenate([np.array(found), signs[(signs < 0).sum(axis=1) % 2 == 0]])


_STEPS = _shortest()


def frames(dim: int) -> np.ndarray:
    """A table's projection each: orthonormal rows, scaled to keep lengths on average; shorter vectors are padded."""
    rng = np.random.default_rng([SEED, dim])
    size = max(dim, 8)
    return np.stack([np.linalg.qr(rng.normal(size=(size, 8)))[0].T[:, :dim] for _ in range(TABLES)]) * np.sqrt(size / 8) * SCALE


def cells(unit: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """For each row and table the hashes of its own cell and of the nearest neighbouring ones."""
    out = np.empty((len(unit), TABLES, PROBES + 1), dtype=np.int64)
    odd = np.random.default_rng(SEED).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        for t, frame in enumerate(projections):
            x = unit @ frame.T
            own = nearest_e8(x)
            rest = 2 * x - own
            # distance to own + step: |rest - step|^2 = |rest|^2 - 2 rest.step + 8
            order = np.argpartition(-(rest @ _STEPS.T), PROBES - 1, axis=1)[:, :PROBES]
            points = np.concatenate([own[:, None, :], own[:, None, :] + _STEPS[order]], axis=1)
            out[:, t] = _mixed((points.astype(np.uint64) * odd).sum(axis=2) + np.uint64(t + 1)).view(np.int64)
    return out


def _signs(unit: np.ndarray) -> np.ndarray:
    """BITS signs of random projections for each row, in 64-bit words."""
    planes = np.random.default_rng([SEED, BITS, unit.shape[1]]).normal(size=(unit.shape[1], BITS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def most_unlike(least: float) -> int:
    """Signs in which a pair of cosine `least` may differ: five deviations more than on average."""
    odds = np.arccos(least) / np.pi
    return int(np.ceil(BITS * odds + 5 * np.sqrt(BITS * odds * (1 - odds))))


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of unit length from the bytes of single or double numbers."""
    x = np.stack([np.frombuffer(r, dtype="<f4" if len(r) == 4 * dim else "<f8") for r in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _described(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim (null if unusable), two prints, the vector's numbers: single ones where they are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                column = batch.column(2)
                # a null component reads as not a number
                flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0, column.offsets.to_numpy()
                size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
                dims, prints, raw = np.zeros(len(size), dtype=np.int64), np.zeros((2, len(size)), dtype=np.int64), np.full(len(size), None, dtype=object)
                for dim in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == dim)
                    x = flat[ends[rows][:, None] + np.arange(dim)]
                    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    rows, x = rows[good], x[good]
                    h = _mixed(np.ascontiguousarray(x).view(np.uint64) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    dims[rows] = dim
                    prints[0, rows], prints[1, rows] = h.sum(axis=1, dtype=np.uint64).view(np.int64), _mixed(h).sum(axis=1, dtype=np.uint64).view(np.int64)
                    single = x.astype("<f4")
                    exact = (single == x).all(axis=1)
                    for k, row in enumerate(rows):
                        raw[row] = (single[k] if exact[k] else x[k].astype("<f8")).tobytes()
                none = dims == 0
                arrays = [pa.array(dims, pa.int32(), mask=none), *(pa.array(p, pa.int64(), mask=none) for p in prints), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["vec_id", "label", "dim", "print1", "print2", "vector"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.mapInArrow(run, "vec_id long, label string, dim int, print1 long, print2 long, vector binary")


def _salted(own: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Cells of other labels and lengths are other cells."""
    return _mixed(own.view(np.uint64) ^ _mixed(salt.view(np.uint64))[:, None, None]).view(np.int64)


def _hashed(reps: DataFrame) -> DataFrame:
    """(cell, in_table, rep, signs) for each representative and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rep, dims, salt = (part.column(k).to_numpy() for k in range(3))
                raw = np.array(part.column(3).to_pylist(), dtype=object)
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    if int(dim) not in known:
                        known[int(dim)] = frames(int(dim))
                    x = _units(raw[rows], int(dim))
                    own, each = _salted(cells(x, known[int(dim)]), salt[rows]), TABLES * (PROBES + 1)
                    signs = np.array([s.tobytes() for s in _signs(x)], dtype=object)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.ravel()), pa.array(np.tile(np.repeat(np.arange(TABLES), PROBES + 1), len(rows)), pa.int32()), pa.array(np.repeat(rep[rows], each)), pa.array(np.repeat(signs, each), pa.binary())],
                        names=["cell", "in_table", "rep", "signs"],
                    )

    return reps.select("rep", "dim", "salt", "vector").mapInArrow(run, "cell long, in_table int, rep long, signs binary")


def _blocks(met: DataFrame, most: int) -> DataFrame:
    """Of (node, cell, in_table, rep, side, crossed, signs): (block, rep, side, crossed, first) to compare by cosine.

    Members of a node whose signs differ in `most` places at most hang together;
    in a crossed node only those of different sides meet. first is the first
    cell, as (in_table, cell), that has the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            rep, side, crossed = table["rep"], table["side"], bool(table["crossed"][0])
            if len(rep) < 2:
                continue
            signs = np.frombuffer(b"".join(table["signs"]), dtype=np.uint64).reshape(len(rep), -1)
            label, involved = np.arange(len(rep)), np.zeros(len(rep), dtype=bool)
            for i in range(0, len(rep), 64):
                alike = np.bitwise_count(signs[i : i + 64, None, :] ^ signs[None, :, :]).sum(axis=2, dtype=np.uint8) <= most
                alike &= side[i : i + 64, None] != side[None, :] if crossed else rep[i : i + 64, None] != rep[None, :]
                for k in np.flatnonzero(alike.any(axis=1)):
                    js = np.append(np.flatnonzero(alike[k]), i + k)
                    involved[js] = True
                    joined = np.unique(label[js])
                    if len(joined) > 1:
                        label[np.isin(label, joined)] = joined[0]
            some = np.flatnonzero(involved)
            if not len(some):
                continue
            some = some[np.lexsort((rep[some], label[some]))]
            cuts = np.flatnonzero(np.diff(label[some], prepend=-1))
            with np.errstate(over="ignore"):
                salted = _mixed(rep[some].astype(np.uint64) * np.uint64(2) + side[some].astype(np.uint64) + np.uint64(int(crossed) << 62))
                names = _mixed(np.add.reduceat(salted, cuts)).view(np.int64)
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, np.diff([*cuts, n]))), pa.array(rep[some]), pa.array(side[some], pa.int32()), pa.array(np.full(n, crossed)), pa.array(table["in_table"][some], pa.int32()), pa.array(table["cell"][some])],
                names=["block", "rep", "side", "crossed", "in_table", "cell"],
            )

    found = _ordered(met, "node").mapInArrow(run, "block long, rep long, side int, crossed boolean, in_table int, cell long")
    return found.groupBy("block", "rep", "side", "crossed").agg(F.min(F.struct("in_table", "cell")).alias("first"))


def _compared(blocks: DataFrame, least: float) -> DataFrame:
    """Of blocks with vectors: (a, b, n): a's n vectors more that it links with (b null), or a link a - b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for table in _groups(batches, "block"):
            rep, n, side, dim = table["rep"], table["n"], table["side"], int(table["dim"][0])
            t, cell, crossed = int(table["in_table"][0]), table["cell"][0], bool(table["crossed"][0])
            if dim not in known:
                known[dim] = frames(dim)
            x = _units(table["vector"], dim)
            own = _salted(cells(x, known[dim]), table["salt"])
            links, tree, union = np.zeros(len(rep), dtype=np.int64), [], _Union(np.arange(len(rep)))
            for at in range(0, len(rep), 512):
                i, j = np.nonzero(x[at : at + 512] @ x.T >= least)
                i = i + at
                good = (side[i] < side[j]) if crossed else (i < j)
                i, j = i[good], j[good]
                first = np.ones(len(i), dtype=bool)
                for before in range(t):
                    first &= ~(own[i, before][:, :, None] == own[j, before][:, None, :]).any(axis=(1, 2))
                for k in range(PROBES + 1):
                    mine = own[i, t, k]
                    first &= ~((mine < cell) & (own[j, t] == mine[:, None]).any(axis=1))
                i, j = i[first], j[first]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                tree += [(int(rep[a]), int(rep[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if union.join(a, b)]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*rep[some].tolist(), *(a for a, _ in tree)], pa.int64()),
                    pa.array([*[None] * len(some), *(b for _, b in tree)], pa.int64()),
                    pa.array([*links[some].tolist(), *[0] * len(tree)], pa.int64()),
                ],
                names=["a", "b", "n"],
            )

    return _ordered(blocks, "block").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    known = written(_described(vectors).withColumn("linked", F.col("dim").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    same = ["label", "dim", "print1", "print2"]
    classes = known.where("linked").groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.min_by("vector", "vec_id").alias("vector"))
    # a vec_id may stand for several vectors, so classes have names of their own
    reps = written(classes.withColumn("salt", F.xxhash64("label", "dim")).withColumn("rep", F.xxhash64("salt", "print1", "print2")))
    hashed = written(_hashed(reps))
    large = written(hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK))
    # a large cell's members meet piece by piece; each pair of pieces is a node of its own
    met = hashed.join(large, "cell", "left").withColumn("pieces", F.ceil(F.coalesce("size", F.lit(1)) / CHUNK))
    met = met.withColumn("piece", F.pmod(F.xxhash64("rep"), "pieces")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    met = met.withColumn("node", F.when(F.col("pieces") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("piece", "other"), F.greatest("piece", "other"))))
    # in a node of two pieces both are there once; a piece with itself is a node of one side
    met = met.withColumn("crossed", F.col("piece") != F.col("other")).withColumn("side", (F.col("piece") > F.col("other")).cast("int"))
    blocks = _blocks(met.select("node", "cell", "in_table", "rep", "side", "crossed", "signs"), most_unlike(least))
    wanted = blocks.select("block", "rep", "side", "crossed", "first.in_table", "first.cell").join(reps.select("rep", "n", "dim", "salt", "vector"), "rep")
    found = written(_compared(wanted, least))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    labels = components(found.where("b is not null").select("a", "b"))
    firsts = labels.join(reps.select(F.col("rep").alias("node"), "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("least"))
    linked = labels.join(firsts, "component").select(F.col("node").alias("rep"), "least")
    told = written(
        reps.join(links, reps["rep"] == links["a"], "left")
        .join(linked, "rep", "left")
        .select(*same, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    )
    rows = written(known.drop("vector"))
    forget(known, reps, hashed, large, found, labels)
    joined = rows.join(told, same, "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(F.col("linked"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
