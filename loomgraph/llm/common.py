"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.tables import forget, new_path, shared_folder, written

__all__ = ["WORD", "by_batches", "forget", "n_words", "new_path", "renamed", "shared_folder", "table", "trimmed", "written"]

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def renamed(df: DataFrame, new: list[str]) -> DataFrame:
    """df without the columns whose names the new ones take (names match without case)."""
    taken = {x.lower() for x in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives back what its allocators keep of freed memory.

    Workers outlive tasks, and an executor's memory has to hold them beside its heap.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            # what run() held is freed when it ends, before the rest
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def by_batches(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str],
    text: str = "text",
    rows: int = 256,
) -> DataFrame:
    """Adds fields computed from text, a slice of rows at a time, in Arrow batches.

    make() runs once in each task and returns the function of one slice; keep
    names the columns that stay, of which those with a new field's name go. A
    text that stays is sent once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    given = df.select(*[F.col(f"`{c}`") for c in keep])
    at_text = keep.index(text) if text in keep and given.schema[text].dataType == T.StringType() else len(keep)
    if at_text == len(keep):
        given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(given.schema[c] for c in keep), *fields])
    types = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [a.cast(t.type) for a, t in zip(f(part.column(at_text)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *types.names])

    return given.mapInArrow(trimmed(run), schema)
