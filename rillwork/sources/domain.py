"""The domain's tables as views of the stored ones: raster cells, depth series, assets, storms, design points, search traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX = 50
#: The same views for the SQL of the registered queries.
SQL = """cells AS (SELECT p_partkey AS cell, p_partkey // 50 AS r, p_partkey % 50 AS c, p_retailprice AS z, p_size * 0.001 AS n, p_size <= 3 AS wall FROM part),
traj AS (SELECT l_orderkey AS cell, l_linenumber AS step, max(l_quantity) / 100 AS h, max(l_quantity * (1 - l_discount + l_tax)) / 100 AS h2 FROM lineitem GROUP BY 1, 2),
assets AS (SELECT s_suppkey AS asset, (s_nationkey + 1) * 0.0625 AS threshold, 1.0 + s_nationkey * 0.25 AS weight FROM supplier),
asset_cells AS (SELECT s_suppkey AS asset, s_suppkey * 31 + k AS cell FROM supplier, range(8) AS t(k)),
guard AS (SELECT c_custkey AS cell FROM customer WHERE c_mktsegment = 'BUILDING'),
hyeto AS (SELECT event_type AS series, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000000 AS t, value AS rate FROM events),
theta AS (SELECT vec_id AS cand, label AS generation, k::INT - 1 AS k, least(greatest(embedding[k]::DOUBLE + 0.5, 0), 1) AS u FROM embeddings, range(1, 7) AS t(k)),
trace AS (SELECT o_orderkey AS eval_index, o_totalprice AS j, o_orderstatus <> 'F' AS feasible, CASE WHEN o_orderstatus <> 'F' THEN 0 ELSE o_totalprice / 1024 END AS violation,
          o_custkey % 10 AS breach, o_custkey AS key, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS level, o_orderkey // 64 AS generation FROM orders),
ensemble AS (SELECT l_orderkey AS cand, l_linenumber AS member, max(l_extendedprice) AS j, max(l_returnflag) <> 'R' AS feasible FROM lineitem GROUP BY 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, r, c, z, n, wall): one row per raster cell."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("cell"), F.expr(f"p_partkey div {NX}").alias("r"), (key % NX).alias("c"), F.col("p_retailprice").alias("z"), (F.col("p_size") / 1000).alias("n"), (F.col("p_size") <= 3).alias("wall")
    )


def traj(spark: SparkSession, sf_dir: str, within: DataFrame | None = None) -> DataFrame:
    """(cell, step, h, h2): depths of two runs; within: of these cells (cell) alone, whose rows are picked before any aggregation."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "cell")
    if within is not None:
        rows = rows.join(within.select("cell").distinct().hint("shuffle_hash"), "cell", "left_semi")
    return rows.groupBy("cell", F.col("l_linenumber").alias("step")).agg((F.max("l_quantity") / 100).alias("h"), (F.max(F.expr("l_quantity * (1 - l_discount + l_tax)")) / 100).alias("h2"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), ((F.col("s_nationkey") + 1) * 0.0625).alias("threshold"), (1.0 + F.col("s_nationkey") * 0.25).alias("weight"))


def asset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.explode(F.expr("sequence(s_suppkey * 31, s_suppkey * 31 + 7)")).alias("cell"))


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cell"))


def hyeto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, t, rate): knots of storms, in seconds from the first event on."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.agg(F.min("us").alias("first"))
    return e.crossJoin(F.broadcast(first)).select(F.col("event_type").alias("series"), ((F.col("us") - F.col("first")) / 1000000).alias("t"), F.col("value").alias("rate"))


def theta(spark: SparkSession, sf_dir: str, dims: int = 6) -> DataFrame:
    """(cand, generation, k, u): the coordinates of design points of so many dimensions, in [0, 1]."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cand"), F.col("label").alias("generation"), F.posexplode(F.slice("embedding", 1, dims)).alias("k", "x")).select(
        "cand", "generation", "k", F.least(F.greatest(F.col("x").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("u")
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evaluation of a search."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS eval_index", "o_totalprice AS j", "o_orderstatus <> 'F' AS feasible", "CASE WHEN o_orderstatus <> 'F' THEN 0D ELSE o_totalprice / 1024 END AS violation",
        "o_custkey % 10 AS breach", "o_custkey AS key", "CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS level", "o_orderkey div 64 AS generation",
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cand"), F.col("l_linenumber").alias("member")).agg(F.max("l_extendedprice").alias("j"), (F.max("l_returnflag") != "R").alias("feasible"))
