"""Queries of the ranking, sequence, attribution and corridor operators."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators import corridors as C
from rillwork.operators import design as G
from rillwork.operators import evaluation as E
from rillwork.operators import ranking as K
from rillwork.operators import search, surrogate
from rillwork.operators.storms import running
from rillwork.plans.raster import NY, _ny
from rillwork.plans.registry import query
from rillwork.sources import domain as D
from rillwork.sources.stored import shared_folder

V = f"WITH {D.SQL}"
ORDER = "feasible DESC, CASE WHEN feasible THEN j END, CASE WHEN NOT feasible THEN violation END, CASE WHEN NOT feasible THEN -breach END, eval_index"


@query("e11_deb_rank", f"{V} SELECT generation, eval_index, row_number() OVER (PARTITION BY generation ORDER BY {ORDER}) AS rank FROM trace")
def e11(spark, sf):
    w = Window.partitionBy("generation").orderBy(*K.deb_order())
    return D.trace(spark, sf).select("generation", "eval_index", F.row_number().over(w).alias("rank"))


BUCKET = "eval_index div 4096"


@query("e13_budget", f"{V}, f AS (SELECT eval_index, eval_index = min(eval_index) OVER (PARTITION BY key) AS is_first FROM trace) SELECT eval_index, is_first, sum(is_first::INT) OVER (ORDER BY eval_index)::BIGINT AS sims FROM f")
def e13(spark, sf):
    first = K.first_of_key(D.trace(spark, sf).select("eval_index", "key"))
    return running(first, "eval_index", F.expr(BUCKET), {"sims": F.col("is_first").cast("bigint")}, F.sum).select("eval_index", "is_first", "sims")


@query("e15_top_seeds", f"{V}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {ORDER}) AS k FROM trace WHERE level = 2) SELECT eval_index, key, j FROM b WHERE k = 1 ORDER BY {ORDER} LIMIT 4")
def e15(spark, sf):
    one = D.trace(spark, sf).filter("level = 2").groupBy("key").agg(F.min(K.deb_struct()).alias("o"), F.min_by("j", K.deb_struct()).alias("j"))
    return one.orderBy("o").limit(4).select("o.eval_index", "key", "j")


@query("e16_final_best", f"{V} SELECT eval_index, j FROM trace WHERE level = 1 AND feasible ORDER BY {ORDER} LIMIT 1")
def e16(spark, sf):
    return D.trace(spark, sf).filter("level = 1 AND feasible").agg(F.min(F.struct("j", "eval_index")).alias("m")).select("m.eval_index", "m.j")


PTS = "pt AS (SELECT l_orderkey AS id, l_linenumber AS k, l_extendedprice AS a, l_quantity * (1 - l_discount) AS b FROM lineitem)"


@query("e17_pareto", f"WITH {PTS}, lo AS (SELECT a, min(b) AS b FROM pt GROUP BY a), f AS (SELECT a, b, min(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lo) SELECT id, k, pt.a, pt.b FROM pt JOIN f ON pt.a = f.a AND pt.b = f.b WHERE m IS NULL OR f.b < m")
def e17(spark, sf):
    pts = D.table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS k", "l_extendedprice AS a", "l_quantity * (1 - l_discount) AS b")
    return K.pareto(pts, "a", "b").select("id", "k", "a", "b")


@query("e30_best_so_far", f"{V} SELECT eval_index, min(CASE WHEN feasible AND level = 1 THEN j END) OVER (ORDER BY eval_index) AS best FROM trace")
def e30(spark, sf):
    return running(D.trace(spark, sf), "eval_index", F.expr(BUCKET), {"best": F.when(F.col("feasible") & (F.col("level") == 1), F.col("j"))}).select("eval_index", "best")


@query("e30_status_counts", f"{V} SELECT level, feasible, count(*) AS n, min(j) AS best FROM trace GROUP BY 1, 2")
def e30b(spark, sf):
    return D.trace(spark, sf).groupBy("level", "feasible").agg(F.count("*").alias("n"), F.min("j").alias("best"))


@query("e31_seeds_study", f"{V} SELECT level, breach AS seed, median(j) AS median_j, min(j) AS min_j, max(j) AS max_j FROM trace GROUP BY 1, 2")
def e31(spark, sf):
    return D.trace(spark, sf).groupBy("level", F.col("breach").alias("seed")).agg(F.median("j").alias("median_j"), F.min("j").alias("min_j"), F.max("j").alias("max_j"))


@query("e21_utilization", f"{V} SELECT generation, least(1, round(sum(j) FILTER (feasible) / sum(j), 9)) AS u FROM trace GROUP BY generation")
def e21(spark, sf):
    return D.trace(spark, sf).groupBy("generation").agg(F.least(F.lit(1.0), F.round(F.sum(F.when(F.col("feasible"), F.col("j"))) / F.sum("j"), 9)).alias("u"))


@query("e7_kendall", f"{V}, a AS (SELECT generation AS g, eval_index AS i, j AS x, key AS y FROM trace) SELECT a.g AS generation, round(sum(sign((a.x - b.x) * (a.y - b.y))) / count(*), 9) AS tau FROM a JOIN a b ON a.g = b.g AND a.i < b.i GROUP BY 1")
def e7(spark, sf):
    """Generations have 64 rows at most."""
    return K.kendall(D.trace(spark, sf), "j", "key", "eval_index", "generation").withColumn("tau", F.round("tau", 9))


@query("e8_new_candidates", f"{V}, known AS (SELECT DISTINCT key FROM trace WHERE generation < 2) SELECT key, min(eval_index) AS eval_index, count(*) AS asked FROM trace WHERE generation >= 2 AND key NOT IN (SELECT key FROM known) GROUP BY key")
def e8(spark, sf):
    t = D.trace(spark, sf)
    return t.filter("generation >= 2").join(t.filter("generation < 2").select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("eval_index").alias("eval_index"), F.count("*").alias("asked"))


@query("e9_record_status", f"{V} SELECT eval_index, CASE WHEN NOT feasible AND breach = 0 THEN 'static_infeasible' WHEN NOT feasible THEN 'guard_abort' ELSE 'ok' END AS status, CASE WHEN NOT feasible AND breach = 0 THEN 1e300 ELSE j END AS j, CASE WHEN NOT feasible AND breach = 0 THEN 1e6 + violation ELSE violation END AS violation FROM trace")
def e9(spark, sf):
    static = ~F.col("feasible") & (F.col("breach") == 0)
    return D.trace(spark, sf).select("eval_index", F.when(static, "static_infeasible").when(~F.col("feasible"), "guard_abort").otherwise("ok").alias("status"), F.when(static, 1e300).otherwise(F.col("j")).alias("j"), F.when(static, 1e6 + F.col("violation")).otherwise(F.col("violation")).alias("violation"))


@query("e12_static_resample", f"{V}, a AS (SELECT generation, eval_index, feasible, row_number() OVER (PARTITION BY generation ORDER BY feasible DESC, CASE WHEN feasible THEN eval_index ELSE -eval_index END) AS k FROM trace) SELECT generation, eval_index, feasible FROM a WHERE k = 1")
def e12(spark, sf):
    """The first proposal of a slot that passes, else the last one."""
    pick = F.struct(~F.col("feasible"), F.when(F.col("feasible"), F.col("eval_index")).otherwise(-F.col("eval_index")), F.col("eval_index").alias("e"), F.col("feasible").alias("f"))
    return D.trace(spark, sf).groupBy("generation").agg(F.min(pick).alias("m")).select("generation", F.col("m.e").alias("eval_index"), F.col("m.f").alias("feasible"))


SUB = f"sub AS (SELECT m AS mask, (SELECT sum(r_regionkey * 3 + 1) FROM region WHERE (m >> r_regionkey) & 1 = 1)::DOUBLE AS s FROM range(32) AS t(m)), sb AS (SELECT mask, 100 - coalesce(s, 0) - (mask & 3) * 0.5::DOUBLE AS j FROM sub)"


def _subsets(spark, sf):
    regions = D.table(spark, sf, "region")
    bits = regions.crossJoin(spark.range(32).withColumnRenamed("id", "mask")).withColumn("v", F.expr("IF((shiftright(mask, r_regionkey) & 1) = 1, r_regionkey * 3 + 1, 0)"))
    return bits.groupBy("mask").agg(F.sum("v").alias("s")).select("mask", (100 - F.col("s") - F.expr("mask & 3") * 0.5).alias("j"))


@query("e27_ablation_subsets", f"WITH {SUB} SELECT mask, j FROM sb")
def e27(spark, sf):
    return _subsets(spark, sf)


@query("e28_shapley", f"WITH {SUB}, p AS (SELECT i, a.mask, b.j - a.j AS g, bit_count(a.mask::BIGINT) AS s FROM range(5) AS t(i), sb a JOIN sb b ON b.mask = a.mask | (1 << i) WHERE a.mask & (1 << i) = 0) SELECT i, round(sum(g * factorial(s::INT) * factorial((4 - s)::INT) / factorial(5)), 9) AS shapley, max(g) FILTER (mask | (1 << i) = 31) AS leave_one_out, max(g) FILTER (mask = 0) AS alone FROM p GROUP BY i")
def e28(spark, sf):
    return K.shapley(_subsets(spark, sf), 5).withColumn("shapley", F.round("shapley", 9))


@query("e3_sobol_bins", "SELECT k::INT AS k, b::BIGINT AS bin, 1::BIGINT AS n FROM range(12) AS x(k), range(64) AS y(b)")
def e3(spark, sf):
    """64 points put one into each of 64 bins of every coordinate."""
    return search.sobol_points(spark, 64, 12, 7).groupBy("k", F.floor(F.col("u") * 64).alias("bin")).agg(F.count("*").alias("n"))


@query("e2_random_points")
def e2(spark, sf):
    return search.random_points(spark, 256, 6, 11)


FLOW = "fl AS (SELECT cell, r, c, z - 1000 AS qx, (n - 0.025::DOUBLE) * 4000 AS qy FROM cells)"


def _flow(spark, sf):
    return D.cells(spark, sf).selectExpr("cell", "r", "c", "z - 1000 AS qx", "(n - 0.025D) * 4000 AS qy")


NEAR = f"""{FLOW}, nb AS (SELECT (r + i) * 50 + c + j AS cell, cell AS source, (qx * j + qy * i) / sqrt((i * i + j * j)::DOUBLE) AS inflow FROM fl, (SELECT a.d AS i, b.d AS j FROM (VALUES (-1), (0), (1)) AS a(d), (VALUES (-1), (0), (1)) AS b(d) WHERE a.d <> 0 OR b.d <> 0)
    WHERE r + i BETWEEN 0 AND {NY} - 1 AND c + j BETWEEN 0 AND 49), tg AS (SELECT DISTINCT cell FROM asset_cells WHERE cell < (SELECT count(*) FROM cells)),
    st AS (SELECT source AS start, max(inflow) AS inflow FROM nb SEMI JOIN tg USING (cell) WHERE inflow > 0 AND source NOT IN (SELECT cell FROM tg) GROUP BY source)"""


def _targets(spark, sf):
    """The cells of all assets as one target."""
    return D.asset_cells(spark, sf).join(D.cells(spark, sf).select("cell"), "cell", "left_semi").select(F.lit("assets").alias("target"), "cell").distinct()


@query("e22_corridor_starts", f"{V}, {NEAR} SELECT 'assets' AS target, start, round(inflow, 6) AS inflow FROM st")
def e22(spark, sf):
    return C.starts(_flow(spark, sf), _targets(spark, sf), D.NX, _ny(spark, sf)).withColumn("inflow", F.round("inflow", 6))


@query(
    "e23_corridor_trace",
    f"""WITH RECURSIVE {D.SQL}, {NEAR}, ok AS (SELECT * FROM nb WHERE inflow > 0 AND source NOT IN (SELECT cell FROM tg)), walk(start, i, cell, way, least) AS (SELECT start, 0, start, [start], 0.05::DOUBLE * inflow FROM st
    UNION ALL SELECT start, i, cell, way, least FROM (SELECT w.start, w.i + 1 AS i, k.source AS cell, list_append(w.way, k.source) AS way, w.least, row_number() OVER (PARTITION BY w.start ORDER BY k.inflow DESC, k.source) AS rn
    FROM walk w JOIN ok k ON k.cell = w.cell WHERE k.inflow > w.least AND NOT list_contains(w.way, k.source) AND w.i < 4 * (50 + {NY})) WHERE rn = 1) SELECT start, i, cell FROM walk""",
)
def e23(spark, sf):
    """The ways of all starts, upstream."""
    flow, targets, ny = _flow(spark, sf), _targets(spark, sf), _ny(spark, sf)
    return C.traces(C.starts(flow, targets, D.NX, ny), flow, targets, D.NX, ny)


@query("e23_chosen_corridors")
def e23b(spark, sf):
    """The four corridors with most water, over ground that isn't a wall; tests hold the choice against a plain loop."""
    flow, targets, ny = _flow(spark, sf), _targets(spark, sf), _ny(spark, sf)
    found = C.starts(flow, targets, D.NX, ny)
    return C.chosen(found, C.traces(found, flow, targets, D.NX, ny), D.cells(spark, sf).filter("NOT wall"), D.NX, ny, 4)


LINES = """ln AS (SELECT r_regionkey::BIGINT AS corridor, i, 10 + 20.0::DOUBLE * i AS x, 20 + r_regionkey * 15.0::DOUBLE + (i % 3) * 6 AS y FROM region, range(7) AS t(i)), sg AS (SELECT corridor, i, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ln WINDOW w AS (PARTITION BY corridor ORDER BY i)),
    ar AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, coalesce(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY corridor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY corridor) AS total FROM sg WHERE dx IS NOT NULL),
    hit AS (SELECT w.*, a.x + (w.s * a.total - a.s0) / a.d * a.dx AS px, a.y + (w.s * a.total - a.s0) / a.d * a.dy AS py, a.dx / a.d AS tx, a.dy / a.d AS ty, row_number() OVER (PARTITION BY w.cand, w.corridor ORDER BY a.i DESC) AS rn FROM wanted w JOIN ar a ON a.corridor = w.corridor AND a.s0 <= w.s * a.total)"""


def _pieces(spark, sf):
    points = D.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("corridor"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    return C.segments(points.selectExpr("corridor", "i", "10 + 20D * i AS x", "20 + corridor * 15D + (i % 3) * 6 AS y"))


@query("e25_arc_points", f"{V}, wanted AS (SELECT cand, (k % 5)::BIGINT AS corridor, max(u) AS s FROM theta WHERE k < 5 GROUP BY 1, 2), {LINES} SELECT cand, corridor, round(px, 6) AS px, round(py, 6) AS py, round(tx, 6) AS tx, round(ty, 6) AS ty FROM hit WHERE rn = 1")
def e25b(spark, sf):
    """Points and directions along five corridors, at a fraction of each one's length for every design point."""
    wanted = D.theta(spark, sf).filter("k < 5").select("cand", F.col("k").cast("bigint").alias("corridor"), F.col("u").alias("s"))
    return C.placed_at(wanted, _pieces(spark, sf)).select("cand", "corridor", *(F.round(c, 6).alias(c) for c in ("px", "py", "tx", "ty")))


ALONG = [{"kind": "berm", "length": (10, 40), "width": (4, 24), "height": (0.1, 1.5)}, {"kind": "mound", "width": (6, 10), "height": (0.2, 1.0)}]


@query(
    "c2_corridor_decode",
    f"""WITH {D.SQL.replace("range(1, 7)", "range(1, 8)")}, wanted AS (SELECT cand, 0::BIGINT AS corridor, max(u) FILTER (k = 0) AS s, max(u) FILTER (k = 1) AS o, max(u) FILTER (k = 2) AS l, max(u) FILTER (k = 3) AS h FROM theta GROUP BY cand
    UNION ALL SELECT cand, 1, max(u) FILTER (k = 4), max(u) FILTER (k = 5), NULL, max(u) FILTER (k = 6) FROM theta GROUP BY cand), {LINES},
    off AS (SELECT *, (o * 2 - 1) * 1.5 * CASE corridor WHEN 0 THEN 24 ELSE 10 END AS f, degrees(atan2(ty, tx)) + 90 AS a FROM hit WHERE rn = 1)
    SELECT cand, corridor::INT AS slot, CASE corridor WHEN 0 THEN 'berm' ELSE 'mound' END AS kind, round((px - ty * f) / 0.5) * 0.5 AS x, round((py + tx * f) / 0.5) * 0.5 AS y, CASE corridor WHEN 0 THEN round((10 + 30 * l) / 0.5) * 0.5 ELSE 0 END AS length,
    CASE corridor WHEN 0 THEN 14.0 ELSE 8.0 END AS width, CASE corridor WHEN 0 THEN round(a - 180 * floor(a / 180)) ELSE 0 END AS angle, round(CASE corridor WHEN 0 THEN 0.1 + 1.4 * h ELSE 0.2 + 0.8 * h END / 0.01) * 0.01 AS height FROM off""",
)
def c2(spark, sf):
    """Designs along corridors: a berm across the first one, a mound beside the second."""
    return C.decode(D.theta(spark, sf, 7), ALONG, _pieces(spark, sf))


@query("e24_corridor_clip", f"{V}, t AS (SELECT cell, step, h >= 0.2 AS good FROM traj), i AS (SELECT cell, step, good, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY step) AS g FROM t), r AS (SELECT cell, min(step) AS start, max(step) AS stop, count(*) AS n FROM i WHERE good GROUP BY cell, g HAVING count(*) >= 3) SELECT cell, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, start) AS k FROM r) WHERE k = 1")
def e24(spark, sf):
    return K.longest_run(D.traj(spark, sf).select("cell", "step", (F.col("h") >= 0.2).alias("good")), "cell", "step", "good", 3)


@query("e25_arc_length", f"{V}, c AS (SELECT cell, step, h, coalesce(sum(h) OVER (PARTITION BY cell ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(h) OVER (PARTITION BY cell) AS total FROM traj) SELECT cell, step, round((total / 2 - s0) / h, 6) AS part FROM c WHERE total / 2 > s0 + 1e-9 AND total / 2 <= s0 + h + 1e-9")
def e25(spark, sf):
    """The segment of each polyline that holds its middle, and how far along it that is."""
    w = Window.partitionBy("cell").orderBy("step")
    c = D.traj(spark, sf).select("cell", "step", "h", F.coalesce(F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s0"), F.sum("h").over(Window.partitionBy("cell")).alias("total"))
    return c.filter("total / 2 > s0 + 1e-9 AND total / 2 <= s0 + h + 1e-9").select("cell", "step", F.round((F.col("total") / 2 - F.col("s0")) / F.col("h"), 6).alias("part"))


@query("e6_normal_equations", f"{V} SELECT a.k AS i, b.k AS j, round(sum(a.u * b.u), 4) AS s FROM theta a JOIN theta b USING (cand) WHERE a.k <= b.k GROUP BY 1, 2")
def e6(spark, sf):
    t = D.theta(spark, sf).select("cand", "k", "u")
    return t.join(t.select("cand", F.col("k").alias("j"), F.col("u").alias("v")), "cand").filter("k <= j").groupBy(F.col("k").alias("i"), "j").agg(F.round(F.sum(F.col("u") * F.col("v")), 4).alias("s"))


@query("e5_cma_search")
def e5(spark, sf):
    """A short two-level search of an analytic objective, evaluated as tables."""

    def evaluate(level, incumbent):
        def run(points):
            square = F.aggregate("u", F.lit(0.0), lambda a, x: a + (x - 0.3) * (x - 0.3))
            return points.select("cand", (F.col("u")[0] > 0.1).alias("feasible"), (square + 0.01 * (level - 1)).alias("j"), F.greatest(0.1 - F.col("u")[0], F.lit(0.0)).alias("violation"))

        return run

    t = search.searched(spark, search.cma_levels(3, 5), search.Space(3, evaluate), [2, 1], [0.5, 0.5], 40, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}")
    return t.select("eval_index", "level", "feasible", "j")


#: A berm and a swale somewhere on the ground.
SPECS = [("berm", ("x", 10.0, 240.0), ("y", 10.0, 150.0), ("length", 10.0, 60.0), ("width", 8.0, 24.0), ("angle", 0.0, 180.0), ("height", 0.05, 0.6)), ("swale", ("x", 10.0, 240.0), ("y", 10.0, 150.0), ("length", 10.0, 60.0), ("width", 8.0, 24.0), ("angle", 0.0, 180.0), ("height", 0.05, 0.4))]


def search_problem(spark, sf, problem, specs, folder, levels=(2, 1), shares=(0.5, 0.5), budget=16, size=6, **more):
    """A search for designs on a problem's ground: levels are coarser grids, keys the quantized designs, static rules reject without a run."""
    known = {k: E.without_changes(E.coarsened(problem, k)) for k in set(levels)}
    rows = [(slot, kind, i, name, lo, hi) for slot, (kind, *names) in enumerate(specs) for i, (name, lo, hi) in enumerate(names)]
    rows = [(slot, kind, k, name, lo, hi) for k, (slot, kind, _, name, lo, hi) in enumerate(rows)]
    bounds = spark.createDataFrame(rows, "slot int, kind string, k int, name string, lo double, hi double")
    designs = lambda points, key: G.decode(points.select(F.col(key).cast("bigint").alias("cand"), F.posexplode("u").alias("k", "u")), bounds)
    keys = lambda points, level: G.content_keys(designs(points, "slot"), "search", level).select(F.col("cand").cast("int").alias("slot"), "key")

    def static(level):
        p = known[level]
        return lambda points: E.static_checks(G.materialize(designs(points, "slot"), p.editable, p.d, p.most_dz), p).select(F.col("cand").cast("int").alias("slot"))

    space = search.Space(len(rows), lambda level, incumbent: lambda points: E.evaluated(designs(points, "cand"), known[level], incumbent), keys, static)
    return search.searched(spark, search.cma_levels(len(rows), 11, size), space, list(levels), list(shares), budget, folder, **more)


@query("e5_search_runs")
def e5b(spark, sf):
    """A search for a berm and a swale over real runs, coarse ones first; every row is an evaluation."""
    from rillwork.plans.design import _problem
    from rillwork.plans.flow import STORM

    problem = _problem(spark, sf, params=replace(STORM, duration=60.0), max_volume=400.0, max_slope=0.2)
    return search_problem(spark, sf, problem, SPECS, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", budget=6, size=4).drop("u", "key")


@query("e6_surrogate_sums", f"""{V}, e AS (SELECT vec_id AS key, label, 1.0::DOUBLE AS a0, least(greatest(embedding[1]::DOUBLE + 0.5, 0), 1) AS a1, least(greatest(embedding[2]::DOUBLE + 0.5, 0), 1) AS a2, label::DOUBLE AS a3 FROM embeddings),
    t AS (SELECT unnest([{{'i': 0, 'v': a0}}, {{'i': 1, 'v': a1}}, {{'i': 2, 'v': a2}}, {{'i': 3, 'v': a1 * a1}}, {{'i': 4, 'v': a2 * a2}}, {{'i': 5, 'v': a1 * a2}}, {{'i': 6, 'v': a3}}]) AS x, key FROM e)
    SELECT a.x.i AS i, b.x.i AS k, round(sum(a.x.v * b.x.v), 6) AS s FROM t a JOIN t b USING (key) GROUP BY 1, 2""")
def e6b(spark, sf):
    """The sums that a model of all design points is solved from, over all folds."""
    u = lambda k: F.least(F.greatest(F.col("embedding")[k].cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    rows = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.array(u(0), u(1)).alias("u"), F.col("label").cast("double").alias("j"))
    s = surrogate.normal_sums(rows, 2).sum(axis=0)
    return spark.createDataFrame([(i, k, float(s[i, k])) for i in range(7) for k in range(7)], "i int, k int, s double").withColumn("s", F.round("s", 6))
