"""What the corpus operators share: stored intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rillwork.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rillwork-")
        spark.conf.set("spark.rillwork.dir", base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """Join of rows with one row per key of groups, whatever share of the rows a key holds.

    groups has a column `size` with the rows of its key (as has `sizes`, where that is cheaper to read). The rows of keys with more than
    total / HOT_SHARE of them are dealt to as many parts as the largest key needs, and these groups are repeated for each part; only
    such keys, at most HOT_SHARE of them, and that number reach the driver. A null key meets nothing, and its rows are dealt to parts too.
    """
    most, part = max(1, total // HOT_SHARE), unused(rows, "_part")
    hot = (groups if sizes is None else sizes).filter(F.col(size) > most).select(key, size).collect()
    parts = max((-(-r[1] // most) for r in hot), default=1)
    is_hot = F.col(key).isin([r[0] for r in hot]) if hot else F.lit(False)
    # a row's part follows from its values and its task, so a task that runs again deals as before
    many = F.when(F.col(key).isNull(), HOT_SHARE).when(is_hot, parts).otherwise(1)
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), many).cast("int"))
    copies = groups.withColumn(part, F.explode(F.sequence(F.lit(0), F.when(is_hot, parts).otherwise(1) - 1)))
    return dealt.join(copies, [key, part], how).drop(part)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text makes a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)
