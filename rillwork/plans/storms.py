"""Queries of the storm, ledger and depth-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.operators import storms as S
from rillwork.plans.registry import query
from rillwork.sources import domain as D

V = f"WITH {D.SQL}"
TIMES = "times AS (SELECT series, i * 7001.5::DOUBLE - 20000 AS at_s FROM (SELECT DISTINCT series FROM hyeto), range(400) AS x(i))"
KNOTS = "k AS (SELECT series, t, max(rate) AS rate FROM hyeto GROUP BY 1, 2), sg AS (SELECT series, t AS t0, lead(t) OVER w AS t1, rate AS r0, lead(rate) OVER w AS r1 FROM k WINDOW w AS (PARTITION BY series ORDER BY t))"
LEDGER = "ld AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS rain, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS inflow, CASE WHEN event_type = 'error' THEN value ELSE 0 END AS outflow FROM events)"


def _times(spark, sf):
    series = D.hyeto(spark, sf).select("series").distinct()
    return series.select("series", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).select("series", (F.col("i") * 7001.5 - 20000).alias("at"))


@query(
    "a7_hyeto_rate",
    f"""{V}, {TIMES}, {KNOTS} SELECT t.series, t.at_s, round(CASE WHEN s.t0 IS NULL THEN (SELECT arg_min(rate, k.t) FROM k WHERE k.series = t.series) WHEN s.t1 IS NULL THEN s.r0
    ELSE s.r0 + (s.r1 - s.r0) * ((t.at_s - s.t0) / (s.t1 - s.t0)) END, 7) AS rate FROM times t ASOF LEFT JOIN sg s ON t.series = s.series AND t.at_s >= s.t0""",
)
def a7(spark, sf):
    return S.rate_at(D.hyeto(spark, sf), _times(spark, sf), 3600.0).select("series", F.col("at").alias("at_s"), F.round("rate", 7).alias("rate"))


@query(
    "a8_hyeto_integral",
    f"""{V}, {KNOTS}, p AS (SELECT series, greatest(t0, 1000) AS a, least(coalesce(t1, 3e6), 3e6) AS b, r0, coalesce((r1 - r0) / (t1 - t0), 0) AS m, t0 FROM sg
    UNION ALL SELECT series, 1000, least(min(t), 3e6), arg_min(rate, t), 0, 1000 FROM k GROUP BY series)
    SELECT series, round(sum((r0 + m * (a - t0) + r0 + m * (b - t0)) / 2 * (b - a)), 2) AS total FROM p WHERE b > a GROUP BY series""",
)
def a8(spark, sf):
    return S.integral(D.hyeto(spark, sf), 1000.0, 3e6).withColumn("total", F.round("total", 2))


@query("a9_is_zero", f"{V} SELECT series, bool_and(rate = 0) AS is_zero FROM hyeto GROUP BY series")
def a9(spark, sf):
    return D.hyeto(spark, sf).groupBy("series").agg(F.bool_and(F.col("rate") == 0).alias("is_zero"))


@query("a6_rain_units", f"{V} SELECT series, t, round(rate / 1000 / 3600, 15) AS rate_ms FROM hyeto")
def a6(spark, sf):
    return D.hyeto(spark, sf).select("series", "t", F.round(F.col("rate") / 1000 / 3600, 15).alias("rate_ms"))


@query("c14_forcing_scale", f"{V} SELECT m AS member, series, t, rate * f AS rate FROM hyeto, (VALUES ('nominal', 1.0::DOUBLE), ('wet', 1.5::DOUBLE), ('dry', 0.5::DOUBLE)) AS s(m, f)")
def c14(spark, sf):
    scales = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m, f in (("nominal", 1.0), ("wet", 1.5), ("dry", 0.5)))))
    return D.hyeto(spark, sf).withColumn("s", scales).select(F.col("s.m").alias("member"), "series", "t", (F.col("rate") * F.col("s.f")).alias("rate"))


@query("s10_peak_and_time", f"{V} SELECT cell, max(h) AS peak, CASE WHEN max(h) > 0 THEN min(step) FILTER (h = m) END AS t_peak FROM (SELECT *, max(h) OVER (PARTITION BY cell) AS m FROM traj) GROUP BY cell")
def s10(spark, sf):
    return S.peaks(D.traj(spark, sf))


@query("s10_running_peak", f"{V} SELECT cell, step, max(h) OVER (PARTITION BY cell ORDER BY step) AS peak FROM traj")
def s10b(spark, sf):
    return D.traj(spark, sf).selectExpr("cell", "step", "max(h) OVER (PARTITION BY cell ORDER BY step) AS peak")


@query("s14_volume", f"{V} SELECT step, round(sum(h) * 25, 6) AS volume_m3, count(*) AS n_cells FROM traj GROUP BY step")
def s14(spark, sf):
    return D.traj(spark, sf).groupBy("step").agg(F.round(F.sum("h") * 25, 6).alias("volume_m3"), F.count("*").alias("n_cells"))


@query(
    "s17_mass_ledger",
    f"""WITH {LEDGER}, c AS (SELECT run, step, sum(rain) OVER w AS rain, sum(inflow) OVER w AS inflow, sum(outflow) OVER w AS outflow FROM ld WINDOW w AS (PARTITION BY run ORDER BY step))
    SELECT run, step, round(rain, 6) AS rain, round(inflow, 6) AS inflow, round(outflow, 6) AS outflow, round(rain + inflow - outflow, 6) AS volume FROM c""",
)
def s17(spark, sf):
    kinds = {"rain": "view", "inflow": "click", "outflow": "error"}
    steps = D.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), *(F.when(F.col("event_type") == v, F.col("value")).otherwise(0.0).alias(k) for k, v in kinds.items()))
    c = S.ledger(steps, list(kinds))
    return c.select("run", "step", *(F.round(k, 6).alias(k) for k in kinds), F.round(F.col("rain") + F.col("inflow") - F.col("outflow"), 6).alias("volume"))


@query(
    "s18_step_stats",
    """WITH d AS (SELECT user_id AS run, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS dt FROM events)
    SELECT run, min(dt) AS dt_min, max(dt) AS dt_max, round(avg(dt), 6) AS dt_mean, count(dt) AS steps FROM d GROUP BY run""",
)
def s18(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    d = e.selectExpr("run", "(us - lag(us) OVER (PARTITION BY run ORDER BY us)) / 1000000 AS dt")
    return d.groupBy("run").agg(F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"), F.round(F.avg("dt"), 6).alias("dt_mean"), F.count("dt").alias("steps"))


@query("s19_lts_potential", f"{V}, s AS (SELECT step, max(h) * count(*) / sum(h) AS p FROM traj WHERE h > 0 GROUP BY step) SELECT round(max(p), 9) AS lts_potential FROM s")
def s19(spark, sf):
    per = D.traj(spark, sf).filter("h > 0").groupBy("step").agg((F.max("h") * F.count("*") / F.sum("h")).alias("p"))
    return per.agg(F.round(F.max("p"), 9).alias("lts_potential"))


@query("s20_health", f"{V} SELECT step, bool_or(h2 - 0.05 < -1e-6 OR isnan(h2)) AS unhealthy FROM traj GROUP BY step")
def s20(spark, sf):
    return D.traj(spark, sf).groupBy("step").agg(F.bool_or((F.col("h2") - 0.05 < -1e-6) | F.isnan("h2")).alias("unhealthy"))


@query(
    "s22_warm_start",
    f"""{V}, wet AS (SELECT cell, min(step) FILTER (h > 0.2) AS first_wet FROM traj GROUP BY cell), e AS (SELECT c_custkey AS cell, c_nationkey AS cand FROM customer),
    f AS (SELECT cand, min(first_wet) AS first_wet FROM e LEFT JOIN wet USING (cell) GROUP BY cand) SELECT cand, first_wet, (SELECT max(k) FROM (VALUES (0), (2), (4), (6)) AS t(k) WHERE k <= coalesce(first_wet, 7)) AS checkpoint FROM f""",
)
def s22(spark, sf):
    """The latest checkpoint not after the first step that wets a cell which the candidate edits."""
    wet = D.traj(spark, sf).groupBy("cell").agg(F.min(F.when(F.col("h") > 0.2, F.col("step"))).alias("first_wet"))
    e = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("cand"))
    f = e.join(wet, "cell", "left").groupBy("cand").agg(F.min("first_wet").alias("first_wet"))
    return f.withColumn("checkpoint", F.array_max(F.filter(F.array(*map(F.lit, (0, 2, 4, 6))), lambda k: k <= F.coalesce("first_wet", F.lit(7)))))


@query("s27_discharge_sum", f"{V} SELECT cell, round(sum(h * h2 * 10), 9) AS qx, round(sum((h2 - h) * 10), 9) AS qy FROM traj GROUP BY cell")
def s27(spark, sf):
    return D.traj(spark, sf).groupBy("cell").agg(F.round(F.sum(F.col("h") * F.col("h2") * 10), 9).alias("qx"), F.round(F.sum((F.col("h2") - F.col("h")) * 10), 9).alias("qy"))


@query("s12_boundary_flux", f"{V} SELECT cell % 4 AS side, round(sum(h2 - h) FILTER (h2 > h), 6) AS inflow, round(-sum(h2 - h) FILTER (h2 < h), 6) AS outflow FROM traj GROUP BY 1")
def s12(spark, sf):
    d = F.col("h2") - F.col("h")
    return D.traj(spark, sf).groupBy((F.col("cell") % 4).alias("side")).agg(F.round(F.sum(F.when(d > 0, d)), 6).alias("inflow"), F.round(-F.sum(F.when(d < 0, d)), 6).alias("outflow"))


@query("a5_max_floor", f"{V} SELECT step, greatest(max(h2 - h), 0) AS m FROM traj GROUP BY step")
def a5(spark, sf):
    return D.traj(spark, sf).groupBy("step").agg(F.greatest(F.max(F.col("h2") - F.col("h")), F.lit(0.0)).alias("m"))


@query("a4_fixed_sum", f"{V} SELECT r, round(sum(z), 6) AS total FROM cells GROUP BY r")
def a4(spark, sf):
    """A sum whose order is fixed: 16 lanes by column, each in order, then lanes pairwise."""
    lanes = D.cells(spark, sf).groupBy("r", (F.col("c") % 16).alias("lane")).agg(F.array_sort(F.collect_list(F.struct("c", "z"))).alias("v"))
    lanes = lanes.select("r", "lane", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["z"]).alias("s"))
    wide = lanes.groupBy("r").pivot("lane", list(range(16))).agg(F.first("s"))
    level = [F.coalesce(F.col(str(i)), F.lit(0.0)) for i in range(16)]
    while len(level) > 1:
        level = [level[i] + level[i + 1] for i in range(0, len(level), 2)]
    return wide.select("r", F.round(level[0], 6).alias("total"))


@query(
    "sync_windows",
    """SELECT event_type AS series, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS sync, count(*) AS n, round(sum(value), 6) AS rain, max(value) AS peak FROM events GROUP BY 1, 2""",
)
def sync_windows(spark, sf):
    """Sync intervals are tumbling windows; streaming/sync.py has the same over a stream."""
    from rillwork.streaming.sync import sync_totals

    e = D.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("series"), "value")
    return sync_totals(e, "1 hour").withColumn("rain", F.round("rain", 6))
