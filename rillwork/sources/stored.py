"""Intermediate tables in the shared folder: they cut the lineage of iterations and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rillwork.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rillwork-")
        spark.conf.set("spark.rillwork.dir", base)
    return base


#: Rows that a Python worker gets at once where a row is a tile of up to some hundred kB; by default it would get 64 MB.
TILES = 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a row group of such tables, which a reader has in memory at once; a file may have thousands of tiles, as dry ones are next to nothing in it.
GROUP, A_GROUP = "parquet.block.row.count.limit", 128


#: Tasks of a shuffle; Spark would make no more of them than there are cores, as it goes by compressed bytes.
PARTS, MERGED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def stored(df: DataFrame, name: str, batch: int | None = None, tasks: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back. batch: rows that its Python workers get at once, at most, where they aren't Spark's default;
    such rows are large, so readers get row groups of few of them. tasks: how many each of its shuffles has, where that is more than there are cores."""
    path, conf = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = {k: conf.get(k) for k in (BATCH, PARTS, MERGED)}
    if batch:
        conf.set(BATCH, str(min(batch, int(before[BATCH])) if int(before[BATCH]) > 0 else batch))
    if tasks and tasks > df.sparkSession.sparkContext.defaultParallelism:
        conf.set(PARTS, str(tasks))
        conf.set(MERGED, "false")
    try:
        (df.write.option(GROUP, A_GROUP) if batch else df.write).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle. For tables that grow with the grid or the candidates: Spark guesses sizes from compressed files, in which
    a dry tile is next to nothing, and would send them whole through the driver to every task."""
    return df.hint("merge")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows; one made of Python's would go through Python workers in every job that reads it."""
    return spark.range(0).selectExpr(*("CAST(NULL AS {1}) AS {0}".format(*c.split(" ", 1)) for c in schema.split(", ")))


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
