"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where such tables go if the session names no folder and one process is the whole cluster, as in tests.
OWN_SHARED = "file:///tmp/loomgraph-shared"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without it only a local session has one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
    return OWN_SHARED


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; what is there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Estimated bytes of a partition and the most partitions that parts_for() gives.
EACH, MOST_PARTITIONS = 8 << 20, 1 << 13


def parts_for(df: DataFrame) -> int:
    """Partitions by the planner's estimate of the size, so that a task's share doesn't grow with the input; about 10 bytes a statement are estimated."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 50:  # nothing is known of the source
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(MOST_PARTITIONS, -(-size // EACH)))


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            where = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if where.getName().startswith("loomgraph-"):
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
