"""Statements that arrive in batches: each batch is merged into what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import bags

COUNTS = "s string, p string, o string, m long"


class MergedStatements:
    """(s, p, o) of all batches so far, each statement as often as the batch that has it most often.

    A batch is kept as counts in a folder named by its number, so it costs what
    it holds itself, and one that runs again changes nothing; reading takes the
    largest count of each statement. compact() puts all batches into one base.
    Whole folders alone are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        top, fs = self._at(kind)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if fs.exists(self._at(f"{kind}/{n}/_SUCCESS")[0]))

    def _folders(self) -> list[str]:
        bases = self._whole("bases")[-1:]
        return [f"bases/{n}" for n in bases] + [f"batches/{n}" for n in self._whole("batches") if not bases or n > bases[0]]

    def _counts(self) -> DataFrame | None:
        folders = [f"{self.path}/{x}" for x in self._folders()]
        return self.spark.read.schema(COUNTS).parquet(*folders).groupBy("s", "p", "o").agg(F.max("m").alias("m")) if folders else None

    def current(self) -> DataFrame | None:
        counts = self._counts()
        return None if counts is None else bags.unfolded(counts, "m")

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if number in self._whole("batches") or number <= max(self._whole("bases"), default=-1):
            return
        batch.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("m")).write.mode("overwrite").parquet(f"{self.path}/batches/{number}")

    def compact(self) -> None:
        """One base of all batches; what it replaces is deleted, so readers of the state before should have ended."""
        old, numbers = self._folders(), self._whole("batches")
        if len(old) < 2:
            return
        self._counts().repartitionByRange("p", "o", "s").sortWithinPartitions("p", "o", "s").write.mode("overwrite").parquet(f"{self.path}/bases/{numbers[-1]}")
        for name in old:
            where, fs = self._at(name)
            fs.delete(where, True)


def stream_ntriples(spark: SparkSession, directory: str, store: MergedStatements, checkpoint: str):
    """A query that merges N-Triples files as they arrive in a directory."""
    from loomgraph.sources.rdf import parse_lines

    lines = spark.readStream.text(directory)
    triples = parse_lines(lines).where((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return triples.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
