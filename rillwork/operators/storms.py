"""Storm series as tables of knots (series, t, rate), piecewise linear and constant beyond both ends; ledgers; peaks over time.

Time lookups join by bucket of time, never by a range alone: an interval is spread over the buckets that it touches, so a long series
is shared out among tasks. `bucket` is its length in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(knots: DataFrame) -> DataFrame:
    """(series, t0, t1, r0, r1) between neighbouring knots, and the constant ends (t0 or t1 null). Of equal times the later knot (here: the higher rate) rules."""
    one = knots.groupBy("series", "t").agg(F.max("rate").alias("rate"))
    w = Window.partitionBy("series").orderBy("t")
    inner = one.select("series", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.col("rate").alias("r0"), F.coalesce(F.lead("rate").over(w), "rate").alias("r1"))
    first = one.groupBy("series").agg(F.min("t").alias("t1"), F.min_by("rate", "t").alias("r0"))
    return inner.unionByName(first.select("series", F.lit(None).cast("double").alias("t0"), "t1", "r0", F.col("r0").alias("r1")))


def rate_at(knots: DataFrame, times: DataFrame, bucket: float = 600.0) -> DataFrame:
    """(series, at, rate) for each wanted (series, at)."""
    s = segments(knots)
    ends = s.filter("t0 IS NULL OR t1 IS NULL")
    low = F.floor(F.col("t0") / bucket)
    inner = s.filter("t0 IS NOT NULL AND t1 IS NOT NULL").withColumn("b", F.explode(F.sequence(low, F.floor(F.col("t1") / bucket))))
    wanted = times.withColumn("b", F.floor(F.col("at") / bucket))
    linear = F.col("r0") + (F.col("r1") - F.col("r0")) * ((F.col("at") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    within = wanted.join(inner, ["series", "b"]).filter("at >= t0 AND at < t1").select("series", "at", linear.alias("rate"))
    beyond = wanted.join(ends, "series").filter("(t0 IS NULL AND at < t1) OR (t1 IS NULL AND at >= t0)").select("series", "at", F.col("r0").alias("rate"))
    return within.unionByName(beyond)


def integral(knots: DataFrame, a: float, b: float) -> DataFrame:
    """(series, total) over [a, b], by exact trapezoids, constant ends included."""
    s = segments(knots).withColumn("from", F.greatest(F.coalesce("t0", F.lit(a)), F.lit(a))).withColumn("to", F.least(F.coalesce("t1", F.lit(b)), F.lit(b)))
    span = F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), F.col("t1") - F.col("t0"))

    def rate(t: str) -> Column:
        return F.when(span.isNull(), F.col("r0")).otherwise(F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col(t) - F.coalesce("t0", F.lit(0.0))) / F.coalesce(span, F.lit(1.0)))

    return s.filter(F.col("to") > F.col("from")).groupBy("series").agg(F.sum((rate("from") + rate("to")) / 2 * (F.col("to") - F.col("from"))).alias("total"))


def peaks(depths: DataFrame) -> DataFrame:
    """(cell, peak, t_peak): the highest depth and the first step that reaches it; no step where nothing was wet."""
    best = depths.groupBy("cell").agg(F.min(F.struct(-F.col("h"), F.col("step"))).alias("m"))
    return best.select("cell", (-F.col("m.col1")).alias("peak"), F.when(F.col("m.col1") < 0, F.col("m.step")).alias("t_peak"))


def ledger(steps: DataFrame, parts: list[str], run: str = "run", order: str = "step") -> DataFrame:
    """Running totals of the named volumes within each run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(run, order, *(F.sum(p).over(w).alias(p) for p in parts))


def running(df: DataFrame, order: str, bucket: Column, values: dict[str, Column], how=F.min) -> DataFrame:
    """Running minima (or sums) in the order of a column over a whole table, without a window that holds it in one task.

    `bucket` is a non-decreasing integer function of the order: each bucket is scanned by its own task, and what earlier
    buckets hold comes from one row for each of them, joined back. The columns of `values` get the running figure.
    """
    df = df.withColumn("_b", bucket)
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    per = df.groupBy("_b").agg(*(how(v).alias(f"_{k}") for k, v in values.items()))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_b", *(how(f"_{k}").over(ahead).alias(f"_{k}") for k in values))
    both = df.select("*", *(how(v).over(inside).alias(k) for k, v in values.items())).join(per, "_b", "left")
    merge = (lambda k: F.least(F.col(k), F.col(f"_{k}"))) if how is F.min else (lambda k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"_{k}"), F.lit(0)))
    return both.withColumns({k: merge(k) for k in values}).drop("_b", *(f"_{k}" for k in values))
