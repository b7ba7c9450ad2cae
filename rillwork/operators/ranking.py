"""Ranking of search traces: feasibility first, fronts, budgets, attribution and runs of good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators.storms import running


def deb_order() -> list[Column]:
    """Feasible rows first, by j; then by violation, those that broke down later first; ties by eval_index."""
    ok = F.col("feasible")
    return [F.desc("feasible"), F.when(ok, F.col("j")), F.when(~ok, F.col("violation")), F.when(~ok, -F.col("breach")), F.col("eval_index")]


def deb_struct() -> Column:
    """The same order as one value whose minimum is the best row."""
    ok = F.col("feasible")
    return F.struct((~ok).alias("o0"), F.when(ok, F.col("j")).alias("o1"), F.when(~ok, F.col("violation")).alias("o2"), F.when(~ok, -F.col("breach")).alias("o3"), F.col("eval_index").alias("eval_index"))


def pareto(points: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other row dominates in two figures to be small; equal rows all stay. Rows with a null in either aren't points.

    The least b of each a, then a running minimum over buckets of a: no pairs of points are made, no task has them all.
    """
    points = points.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    low = points.groupBy(a).agg(F.min(b).alias("_low"))
    cuts = low.agg(F.percentile_approx(a, [i / 256 for i in range(1, 256)], 2000).alias("_cuts"))
    with_cuts = low.crossJoin(F.broadcast(cuts))
    bucket = F.size(F.filter("_cuts", lambda x: x < F.col(a)))
    run = running(with_cuts, a, bucket, {"_run": F.col("_low")}).select(a, "_low", "_run")
    # a point stays if nothing before it is as low: its own a is where the running minimum first gets this low
    front = run.filter("_low = _run").groupBy("_run").agg(F.min(a).alias(a)).withColumnRenamed("_run", b)
    return points.join(front.hint("shuffle_hash"), [a, b], "left_semi")


def first_of_key(trace: DataFrame) -> DataFrame:
    """The first evaluation of each key: only it costs budget."""
    return trace.withColumn("is_first", F.col("eval_index") == F.min("eval_index").over(Window.partitionBy("key")))


def shapley(subsets: DataFrame, k: int) -> DataFrame:
    """From (mask, j): per primitive its Shapley value, and what leaving it out or having it alone changes."""
    s = F.bit_count(F.col("mask").cast("bigint"))
    weight = F.factorial(s) * F.factorial(k - s - 1) / F.factorial(F.lit(k))
    bits = subsets.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("(mask & shiftleft(1, i)) = 0")
    pairs = bits.withColumn("with_it", F.expr("mask | shiftleft(1, i)")).join(subsets.select(F.col("mask").alias("with_it"), F.col("j").alias("j2")), "with_it")
    gain = F.col("j2") - F.col("j")
    full = (1 << k) - 1
    return pairs.groupBy("i").agg(
        F.sum(weight * gain).alias("shapley"), F.max(F.when(F.col("with_it") == full, gain)).alias("leave_one_out"), F.max(F.when(F.col("mask") == 0, gain)).alias("alone")
    )


def kendall(pairs: DataFrame, x: str, y: str, order: str, by: str) -> DataFrame:
    """Kendall's tau-a of small groups; ties count 0. Groups are an archive's last evaluations, a bounded number."""
    a, b = pairs.alias("a"), pairs.alias("b")
    both = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    s = F.signum((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{y}") - F.col(f"b.{y}")))
    return both.groupBy(F.col(f"a.{by}").alias(by)).agg((F.sum(s) / F.count("*")).alias("tau"))


def longest_run(points: DataFrame, by: str, order: str, good: str, least: int) -> DataFrame:
    """Of each group the longest run of good rows in order, the first of equals, if it has `least` rows."""
    w = Window.partitionBy(by).orderBy(order)
    islands = points.withColumn("island", F.sum(F.when(F.col(good), 0).otherwise(1)).over(w)).filter(good)
    runs = islands.groupBy(by, "island").agg(F.count("*").alias("n"), F.min(order).alias("start"), F.max(order).alias("stop")).filter(F.col("n") >= least)
    return runs.groupBy(by).agg(F.min(F.struct(-F.col("n"), F.col("start"), F.col("stop"))).alias("m")).select(by, F.col("m.start").alias("start"), F.col("m.stop").alias("stop"))
