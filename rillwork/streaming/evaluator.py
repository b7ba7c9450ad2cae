"""An evaluator as a stream: requests for points come in, answers go out, and what was evaluated once isn't run again.

A micro-batch's outcomes and answers are folders named by its number, written over if the batch is tried again; so a restart gives no answer twice. Outcomes of
earlier batches are met by key, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators.search import RESULT, KeyOf, Space

REQUEST = "id string, level int, x array<array<double>>"
ANSWER = f"id string, place int, level int, {RESULT}, cached boolean, error string"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def answered(batch: DataFrame, number: int, space: Space, levels: tuple[int, ...], folder: str) -> None:
    """Answers one micro-batch of REQUEST."""
    spark = batch.sparkSession
    wrong = F.when(~F.coalesce(F.col("level").isin(*levels), F.lit(False)), F.concat(F.lit("level "), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(" is not there"))).when(
        F.col("x").isNull() | F.exists("x", lambda p: p.isNull() | (F.size(p) != space.dims)), F.lit(f"every point must have {space.dims} coordinates")
    )
    batch = batch.dropDuplicates(["id"]).withColumn("error", wrong).persist()
    try:
        known = _outcomes(spark, folder, number)
        fine = batch.filter("error IS NULL").select("id", "level", F.posexplode("x").alias("place", "u"))
        clipped = F.transform("u", lambda v: F.least(F.greatest(F.coalesce(v, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))
        points = fine.select("id", "level", "place", clipped.alias("u"), F.xxhash64("id", "place").alias("slot"))
        keyed = _keyed(points, space.key_of, levels).persist()
        new = keyed.join(known.select("key"), "key", "left_anti").groupBy("level", "key").agg(F.min("slot").alias("cand"), F.min_by("u", "slot").alias("u")).persist()
        out = spark.createDataFrame([], RESULT)
        for level in sorted(r[0] for r in new.select("level").distinct().collect()):
            at = new.filter(F.col("level") == level)
            ran = space.evaluate(level, None)(at.select("cand", "u"))
            more = {"status": F.lit("ok"), "cell_updates": F.lit(0).cast("bigint")}
            out = out.unionByName(at.select("key", "cand").join(ran.withColumns({k: v for k, v in more.items() if k not in ran.columns}), "cand").select(_NAMES))
        out.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")
        fresh = spark.read.schema(RESULT).parquet(f"{folder}/outcomes/batch={number}")
        both = known.select(*_NAMES, F.lit(True).alias("cached")).unionByName(fresh.withColumn("cached", F.lit(False)))
        first = F.row_number().over(Window.partitionBy("key").orderBy("slot")) > 1
        good = keyed.join(both, "key").select("id", "place", "level", *_NAMES, (F.col("cached") | first).alias("cached"), F.lit(None).cast("string").alias("error"))
        none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ANSWER.split(", ")}
        bad = batch.filter("error IS NOT NULL").select(*(F.col(k) if k in ("id", "level", "error") else v.alias(k) for k, v in none.items()))
        good.unionByName(bad).write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
    finally:
        batch.unpersist()


def _keyed(points: DataFrame, key_of: KeyOf, levels: tuple[int, ...]) -> DataFrame:
    out = None
    for level in levels:
        at = points.filter(F.col("level") == level)
        rows = at.join(key_of(at.select("slot", "u"), level).select(F.col("slot").cast("bigint").alias("slot"), "key"), "slot")
        out = rows if out is None else out.unionByName(rows)
    return out


def _outcomes(spark, folder: str, before: int) -> DataFrame:
    """What earlier batches have found."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/outcomes")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, batch int").option("basePath", f"{folder}/outcomes").parquet(f"{folder}/outcomes").filter(F.col("batch") < before).select(_NAMES)


def serve(requests: DataFrame, space: Space, levels: tuple[int, ...], folder: str, checkpoint: str):
    """Starts the stream over REQUEST rows: everything that is there is answered, in micro-batches; returns the started query."""
    step: Callable[[DataFrame, int], None] = lambda batch, number: answered(batch, number, space, levels, folder)
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
