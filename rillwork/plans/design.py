"""Queries of the design, constraint and objective operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rillwork.functions import shapes
from rillwork.operators import checks as C
from rillwork.operators import design as G
from rillwork.operators import evaluation as E
from rillwork.operators import raster as R
from rillwork.plans.registry import query
from rillwork.sources import domain as D
from rillwork.sources.stored import stored

V = f"WITH {D.SQL}"
#: A specification of one straight primitive per candidate: name, lower and upper bound in the order of the coordinates.
SPEC = [("x", 20.0, 230.0), ("y", 5.0, 20.0), ("length", 10.0, 40.0), ("width", 4.0, 24.0), ("angle", 0.0, 0.0), ("height", 0.1, 1.5)]
#: The same for SQL; angle 0 keeps to exact arithmetic.
PRIM = "prim AS (SELECT cand, CASE WHEN cand % 2 = 0 THEN 'berm' ELSE 'cut' END AS kind, " + ", ".join(
    f"max(CASE WHEN k = {k} THEN round(({lo}::DOUBLE + {hi - lo}::DOUBLE * u) / {G.STEPS[n]}::DOUBLE) * {G.STEPS[n]}::DOUBLE END) AS {n}" for k, (n, lo, hi) in enumerate(SPEC)
) + " FROM theta GROUP BY cand)"
SAMPLE = "(x * 1.0 - least(greatest(x, p.x - p.length / 2), p.x + p.length / 2))"
EDITS = f"""{PRIM}, smp AS (SELECT p.cand, q.cell, p.kind, p.width, CASE WHEN p.kind = 'berm' THEN p.height ELSE -p.height END AS height, p.x - p.length / 2 AS x0, p.x + p.length / 2 AS x1, p.y AS py,
    (q.c + (j + 0.5::DOUBLE) / 4) * 5 AS sx, (q.r + (i + 0.5::DOUBLE) / 4) * 5 AS sy FROM prim p JOIN cells q ON NOT q.wall AND (q.c + 1) * 5 > p.x - p.length / 2 - p.width / 2 AND q.c * 5 < p.x + p.length / 2 + p.width / 2
    AND (q.r + 1) * 5 > p.y - p.width / 2 AND q.r * 5 < p.y + p.width / 2, range(4) AS a(i), range(4) AS b(j)),
    ds AS (SELECT cand, cell, height, kind, sqrt((sx - least(greatest(sx, x0), x1)) ** 2 + (sy - py) ** 2) / (width / 2) AS s FROM smp),
    us AS (SELECT cand, cell, height, s, CASE WHEN kind = 'cut' THEN (CASE WHEN s <= 0.5 THEN 0 ELSE (s - 0.5) * 2 END) ELSE s END AS u FROM ds),
    edits AS (SELECT cand, cell, greatest(-1.0, least(1.0, sum(CASE WHEN s >= 1 THEN 0 ELSE height * (1 - u * u) * (1 - u * u) END) / 16)) AS dz FROM us GROUP BY cand, cell HAVING sum(CASE WHEN s >= 1 THEN 0 ELSE 1 END) > 0)"""


def _theta(spark, sf):
    return D.theta(spark, sf)


def _primitives(spark, sf):
    spec = spark.createDataFrame([(0, "berm", k, n, lo, hi) for k, (n, lo, hi) in enumerate(SPEC)], "slot int, kind string, k int, name string, lo double, hi double")
    flat = G.decode(_theta(spark, sf), spec)
    cut = F.col("cand") % 2 == 1
    return flat.withColumns({"kind": F.when(cut, "cut").otherwise("berm"), "height": F.when(cut, -F.abs("height")).otherwise(F.abs("height"))})


def _edits(spark, sf):
    return G.materialize(_primitives(spark, sf), D.cells(spark, sf).filter("NOT wall").select("cell", "r", "c"), 5.0, 1.0)


def _asset_peaks(spark, sf, column="h"):
    peaks = D.traj(spark, sf).groupBy("cell").agg(F.max(column).alias("peak"))
    return G.asset_peaks(peaks, D.asset_cells(spark, sf))


@query("a10_quantize", f"{V} SELECT cand, k, round(u * 37 / 0.5) * 0.5::DOUBLE AS v FROM theta")
def a10(spark, sf):
    return _theta(spark, sf).select("cand", "k", shapes.quantized(F.col("u") * 37, 0.5).alias("v"))


@query("a11_softplus", f"{V}, x AS (SELECT cand, k, (u - 0.5) * 100 AS x FROM theta) SELECT cand, k, round(CASE WHEN x > 30 THEN x WHEN x < -30 THEN exp(x) ELSE ln(1 + exp(x)) END, 9) AS v FROM x")
def a11(spark, sf):
    return _theta(spark, sf).select("cand", "k", F.round(shapes.softplus((F.col("u") - 0.5) * 100), 9).alias("v"))


@query("a24_reflect", f"{V}, x AS (SELECT cand, k, u * 6 AS x FROM theta), y AS (SELECT cand, k, x - 2 * floor(x / 2) AS y FROM x) SELECT cand, k, round(CASE WHEN y > 1 THEN 2 - y ELSE y END, 12) AS v FROM y")
def a24(spark, sf):
    return _theta(spark, sf).select("cand", "k", F.round(shapes.reflected(F.col("u") * 6), 12).alias("v"))


@query("c1_decode", f"{V}, {PRIM} SELECT cand, kind, x, y, length, width, angle, CASE WHEN kind = 'berm' THEN height ELSE -height END AS height FROM prim")
def c1(spark, sf):
    return _primitives(spark, sf).select("cand", "kind", "x", "y", "length", "width", "angle", "height")


@query("a12_segment_ends", f"{V}, {PRIM} SELECT cand, round(x - cos(radians(k.a)) * length / 2, 9) AS x0, round(y - sin(radians(k.a)) * length / 2, 9) AS y0 FROM prim, (SELECT cand AS c2, max(CASE WHEN k = 4 THEN round(u * 180) END) AS a FROM theta GROUP BY 1) k WHERE cand = c2")
def a12(spark, sf):
    angle = _theta(spark, sf).filter("k = 4").select("cand", F.round(F.col("u") * 180).alias("a"))
    ax, ay = shapes.half_axis(F.col("length"), F.col("a"))
    return _primitives(spark, sf).join(angle, "cand").select("cand", F.round(F.col("x") - ax, 9).alias("x0"), F.round(F.col("y") - ay, 9).alias("y0"))


@query("a13_profile", f"{V}, d AS (SELECT cand, k, u / 0.4 AS s FROM theta), e AS (SELECT cand, k, s, CASE WHEN cand % 2 = 0 THEN s WHEN s <= 0.5 THEN 0 ELSE (s - 0.5) * 2 END AS v FROM d) SELECT cand, k, round(CASE WHEN s >= 1 THEN 0 ELSE (1 - v * v) * (1 - v * v) END, 9) AS p FROM e")
def a13(spark, sf):
    kind = F.when(F.col("cand") % 2 == 0, "berm").otherwise("cut")
    return _theta(spark, sf).select("cand", "k", F.round(shapes.profile(F.col("u"), F.lit(0.8), kind), 9).alias("p"))


TURNED = f"{PRIM}, turned AS (SELECT p.*, k.a, cos(radians(k.a)) AS ux, sin(radians(k.a)) AS uy FROM prim p JOIN (SELECT cand, max(CASE WHEN k = 4 THEN round(u * 180) END) AS a FROM theta GROUP BY 1) k USING (cand))"


def _turned(spark, sf):
    """The primitives, turned by their fifth coordinate."""
    angle = _theta(spark, sf).filter("k = 4").select("cand", F.round(F.col("u") * 180).alias("a"))
    return _primitives(spark, sf).drop("angle").join(angle.withColumnRenamed("a", "angle"), "cand")


@query("a14_bbox", f"""{V}, {TURNED} SELECT cand, round(x - abs(ux) * length / 2 - width / 2, 6) AS x_min, round(x + abs(ux) * length / 2 + width / 2, 6) AS x_max, round(y - abs(uy) * length / 2 - width / 2, 6) AS y_min,
    round(y + abs(uy) * length / 2 + width / 2, 6) AS y_max FROM turned""")
def a14(spark, sf):
    box = shapes.bounds(*(F.col(k) for k in ("x", "y", "length", "width", "angle")))
    return _turned(spark, sf).select("cand", *(F.round(v, 6).alias(k) for k, v in box.items()))


@query(
    "a15_footprint",
    f"""{V}, {TURNED}, pt AS (SELECT cand, i, x, y, ux, uy, (CASE WHEN i <= 16 THEN 1 ELSE -1 END) * length / 2 + cos(-pi() / 2 + pi() * (CASE WHEN i <= 16 THEN i ELSE i - 1 END) / 16) * width / 2 AS a,
    sin(-pi() / 2 + pi() * (CASE WHEN i <= 16 THEN i ELSE i - 1 END) / 16) * width / 2 AS b FROM turned, range(34) AS t(i)) SELECT cand, i, round(x + ux * a - uy * b, 6) AS px, round(y + uy * a + ux * b, 6) AS py FROM pt""",
)
def a15(spark, sf):
    ring = shapes.footprint(*(F.col(k) for k in ("x", "y", "length", "width", "angle")))
    return _turned(spark, sf).select("cand", F.posexplode(ring).alias("i", "p")).select("cand", "i", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("a29_theta_slice", f"{V} SELECT cand, k // 3 AS slot, count(*) AS n, round(sum(u), 9) AS s FROM theta GROUP BY 1, 2")
def a29(spark, sf):
    return _theta(spark, sf).groupBy("cand", F.expr("k div 3").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("u"), 9).alias("s"))


@query("a30_param_names", "SELECT DISTINCT 'p' || (k // 6)::INT || '.' || (['x', 'y', 'length', 'width', 'angle', 'height'])[(k % 6 + 1)::INT] AS name, k FROM range(18) AS t(k)")
def a30(spark, sf):
    names = F.array(*map(F.lit, G.LINEAR))
    return spark.range(18).select(F.concat(F.lit("p"), F.expr("id div 6").cast("string"), F.lit("."), F.element_at(names, (F.col("id") % 6 + 1).cast("int"))).alias("name"), F.col("id").alias("k"))


SIGNED = {"height": "(CASE WHEN kind = 'berm' THEN height ELSE -height END)"}
KEY_PARTS = ", ".join(f"round({SIGNED.get(k, k)} / {s}::DOUBLE)::BIGINT" for k, s in G.STEPS.items())


@query("a27_content_key", f"{V}, {PRIM} SELECT cand, sha256(concat_ws('|', 'problem', '1', '', concat_ws(',', 0, kind, {KEY_PARTS}))) AS key FROM prim")
def a27(spark, sf):
    return G.content_keys(_primitives(spark, sf).withColumn("slot", F.lit(0)), "problem", 1)


@query("a27_incumbent_key", f"{V}, {PRIM} SELECT cand, sha256(concat_ws('|', 'problem', '2', '0.25', concat_ws(',', 0, kind, {KEY_PARTS}))) AS key FROM prim")
def a27b(spark, sf):
    """Beside an incumbent a run may stop early, so its key is another one."""
    return G.content_keys(_primitives(spark, sf).withColumn("slot", F.lit(0)), "problem", 2, 0.25)


@query("a28_problem_hash", f"{V}, h AS (SELECT r, sha256(string_agg((z * 100)::BIGINT, ',' ORDER BY c)) AS row_hash FROM cells GROUP BY r) SELECT sha256(string_agg(row_hash, '' ORDER BY r)) AS problem_hash FROM h")
def a28(spark, sf):
    """Raster rows hash on their own; one hash of each row is what meets."""
    rows = D.cells(spark, sf).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", (F.col("z") * 100).cast("bigint").cast("string").alias("v")))).alias("v"))
    rows = rows.select("r", F.sha2(F.array_join(F.col("v.v"), ","), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.expr("array_sort(collect_list(struct(r, h))).h"), ""), 256).alias("problem_hash"))


TILE_HASH = "sha256(string_agg(round(z * 100)::BIGINT || ':' || round(n * 1000000)::BIGINT || ':' || wall::INT, ',' ORDER BY r * 50 + c))"


@query(
    "a28_tree_hash",
    f"""{V}, t AS (SELECT r // 16 * 4 + c // 16 AS node, {TILE_HASH} AS h FROM cells GROUP BY 1), u AS (SELECT node // 16 AS node, sha256(string_agg(h, ',' ORDER BY node)) AS h FROM t GROUP BY node // 16),
    w AS (SELECT sha256(string_agg(h, ',' ORDER BY node)) AS h FROM u) SELECT sha256('storm|' || h) AS problem_hash FROM w""",
)
def a28b(spark, sf):
    """The same by a tree of tiles, over heights, roughness and walls."""
    return C.tree_hash(D.cells(spark, sf), D.NX, "storm")


IO6_RULES = """SELECT 'roughness' AS rule, count(*) FILTER (NOT (n >= 0 AND n < 0.5)) AS failures FROM cells UNION ALL SELECT 'height', count(*) FILTER (NOT wall AND (z IS NULL OR isnan(z))) FROM cells
    UNION ALL SELECT 'cell_number', count(*) FILTER (cell <> r * 50 + c) FROM cells UNION ALL SELECT 'column', count(*) FILTER (NOT c BETWEEN 0 AND 49) FROM cells UNION ALL SELECT 'cell_twice', count(*) FROM (SELECT cell FROM cells GROUP BY cell HAVING count(*) > 1)
    UNION ALL SELECT 'cells_missing', (count(*) < (max(r) + 1) * 50)::INT FROM cells UNION ALL SELECT 'no_flow_cell', (count(*) FILTER (NOT wall) = 0)::INT FROM cells UNION ALL SELECT 'asset_threshold', count(*) FILTER (threshold < 0) FROM assets
    UNION ALL SELECT 'asset_weight', count(*) FILTER (weight < 0) FROM assets UNION ALL SELECT 'asset_without_cell', count(*) FROM assets WHERE asset NOT IN (SELECT asset FROM asset_cells SEMI JOIN cells USING (cell))
    UNION ALL SELECT 'editable_off_grid', 0 UNION ALL SELECT 'guard_off_grid', count(*) FROM guard WHERE cell NOT IN (SELECT cell FROM cells) UNION ALL SELECT 'nothing_editable', (count(*) FILTER (NOT wall) = 0)::INT FROM cells
    UNION ALL SELECT 'storm_order', count(*) FILTER (t < b) FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY k) AS b FROM knots) UNION ALL SELECT 'storm_rate', count(*) FILTER (rate < 0) FROM knots"""
SETTING_RULES = ("duration", "sync_interval", "cfl", "dt_max", "infiltration", "scheme", "crs", "cell_size", "levels_end", "level_shares", "method", "robustness", "sides")
KNOTS = "knots AS (SELECT event_type AS series, event_id AS k, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000000 AS t, value - 5 AS rate FROM events)"


@query("io6_problem_checks", f"{V}, {KNOTS} {IO6_RULES}" + "".join(f" UNION ALL SELECT '{k}', {int(k in ('crs', 'level_shares'))}" for k in SETTING_RULES))
def io6(spark, sf):
    """Every rule over the stored problem, and settings that break two of theirs."""
    e = D.table(spark, sf, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    storm = e.crossJoin(F.broadcast(e.agg(F.min("us").alias("first")))).select(F.col("event_type").alias("series"), F.col("event_id").alias("k"), ((F.col("us") - F.col("first")) / 1000000).alias("t"), (F.col("value") - 5).alias("rate"))
    return C.problem_checks(_problem(spark, sf), storm, C.Settings(crs=32633, ground_crs=32632, cell_size=5.0, levels=(2, 1), shares=(1.0,)))


@query("c3_materialize", f"{V}, {EDITS} SELECT cand, cell, round(dz + 0.000000123::DOUBLE, 6) AS dz FROM edits")
def c3(spark, sf):
    return _edits(spark, sf).withColumn("dz", F.round(F.col("dz") + 0.000000123, 6))


@query("c4_volumes", f"{V}, {EDITS} SELECT cand, round(sum(greatest(-dz, 0) * 25), 6) AS cut_m3, round(sum(greatest(dz, 0) * 25), 6) AS fill_m3 FROM edits GROUP BY cand")
def c4(spark, sf):
    return G.volumes(_edits(spark, sf), 25.0).withColumns({k: G.half_up(F.col(k), 6) for k in ("cut_m3", "fill_m3")})


@query("c5_volume_limit", f"{V}, {EDITS} SELECT cand, round(sum(abs(dz) * 25) - 150, 6) AS amount FROM edits GROUP BY cand HAVING sum(abs(dz) * 25) > 150")
def c5(spark, sf):
    total = F.col("cut_m3") + F.col("fill_m3")
    return G.volumes(_edits(spark, sf), 25.0).filter(total > 150).select("cand", G.half_up(total - 150, 6).alias("amount"))


@query(
    "c6_slope",
    f"""{V}, {EDITS}, e AS (SELECT cand, cell // 50 AS r, cell % 50 AS c, dz FROM edits), b AS (SELECT cand, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM e GROUP BY cand),
    g AS (SELECT cand, r, c FROM b, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c)), f AS (SELECT g.cand, g.r, g.c, coalesce(dz, 0) AS dz FROM g LEFT JOIN e USING (cand, r, c)),
    s AS (SELECT cand, abs(lead(dz) OVER (PARTITION BY cand, r ORDER BY c) - dz) / 5 AS a, abs(lead(dz) OVER (PARTITION BY cand, c ORDER BY r) - dz) / 5 AS b FROM f)
    SELECT cand, round(max(greatest(coalesce(a, b), coalesce(b, a))), 6) AS slope FROM s WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY cand""",
)
def c6(spark, sf):
    return G.steepest(_edits(spark, sf), D.NX, 5.0, 5.0).withColumn("slope", F.round("slope", 6))


#: Ground whose neighbours differ by less than a cut is deep.
FLAT = "flat AS (SELECT cell, r, c, wall, n, (z - 900) * 0.01::DOUBLE AS z FROM cells)"


def _flat(spark, sf):
    return D.cells(spark, sf).withColumn("z", (F.col("z") - 900) * 0.01)


@query(
    "c7_new_pits",
    f"""{V}, {EDITS}, {FLAT}, n AS (SELECT e.cand, e.cell, bool_and(q.z + e.dz < o.z + coalesce(e2.dz, 0) - 0.01) AS now, bool_and(q.z < o.z - 0.01) AS before, count(*) AS n FROM edits e JOIN flat q USING (cell)
    JOIN flat o ON o.r BETWEEN q.r - 1 AND q.r + 1 AND o.c BETWEEN q.c - 1 AND q.c + 1 AND o.cell <> q.cell LEFT JOIN edits e2 ON e2.cand = e.cand AND e2.cell = o.cell WHERE e.dz < 0 GROUP BY 1, 2)
    SELECT cand, cell FROM n WHERE now AND NOT before AND n = 8""",
)
def c7(spark, sf):
    return G.new_pits(_flat(spark, sf), _edits(spark, sf), D.NX)


@query(
    "e9_static_rejects",
    f"""{V}, {EDITS}, {FLAT}, v AS (SELECT cand, 'volume' AS rule, sum(abs(dz) * 25) - 150 AS amount FROM edits GROUP BY cand HAVING sum(abs(dz) * 25) > 150),
    e AS (SELECT cand, cell // 50 AS r, cell % 50 AS c, dz FROM edits), b AS (SELECT cand, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM e GROUP BY cand),
    g AS (SELECT cand, r, c FROM b, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c)), f AS (SELECT g.cand, g.r, g.c, coalesce(dz, 0) AS dz FROM g LEFT JOIN e USING (cand, r, c)),
    s AS (SELECT cand, abs(lead(dz) OVER (PARTITION BY cand, r ORDER BY c) - dz) / 5 AS a, abs(lead(dz) OVER (PARTITION BY cand, c ORDER BY r) - dz) / 5 AS b FROM f),
    t AS (SELECT cand, 'slope' AS rule, max(greatest(coalesce(a, b), coalesce(b, a))) - 0.08 AS amount FROM s WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY cand HAVING amount > 0),
    n AS (SELECT e.cand, e.cell, bool_and(q.z + e.dz < o.z + coalesce(e2.dz, 0) - 0.01) AS now, bool_and(q.z < o.z - 0.01) AS before, count(*) AS n FROM edits e JOIN flat q USING (cell)
    JOIN flat o ON o.r BETWEEN q.r - 1 AND q.r + 1 AND o.c BETWEEN q.c - 1 AND q.c + 1 AND o.cell <> q.cell LEFT JOIN edits e2 ON e2.cand = e.cand AND e2.cell = o.cell WHERE e.dz < 0 GROUP BY 1, 2),
    p AS (SELECT cand, 'new_pits' AS rule, count(*)::DOUBLE AS amount FROM n WHERE now AND NOT before AND n = 8 GROUP BY cand)
    SELECT cand, rule, round(amount, 6) AS amount FROM (SELECT * FROM v UNION ALL SELECT * FROM t UNION ALL SELECT * FROM p)""",
)
def e9_static(spark, sf):
    return E.static_checks(_edits(spark, sf), _problem(spark, sf)).withColumn("amount", G.half_up(F.col("amount"), 6))


def _problem(spark, sf, **more):
    from rillwork.plans.flow import STORM, _ground

    given = dict(
        cells=_ground(spark, sf), editable=D.cells(spark, sf).filter("NOT wall").select("cell", "r", "c"), assets=D.assets(spark, sf), asset_cells=D.asset_cells(spark, sf), guard=D.guard(spark, sf),
        params=STORM, nx=D.NX, d=5.0, max_volume=150.0, max_slope=0.08, cost_weight=0.001, cut_cost=2.0, fill_cost=3.0,
    )
    return E.Problem(**(given | more))


@query("e9_evaluate")
def e9_evaluate(spark, sf):
    """Every design point from its coordinates to its outcome; tests hold it against runs in arrays."""
    return E.evaluated(_primitives(spark, sf), E.without_changes(_problem(spark, sf)))


@query("e10_incumbent_aborts")
def e10(spark, sf):
    """The same beside an incumbent's objective: what can't be below it stops at a sync point."""
    known = E.without_changes(_problem(spark, sf, tolerance=1.0))
    return E.evaluated(_primitives(spark, sf), known, incumbent=0.0).groupBy("status").agg(F.count("*").alias("n"), F.min("j").alias("least_j"))


@query("c19_revalidation")
def c19b(spark, sf):
    """Every design point under half and one and a half times the storm, and on a grid of twice the cells along both axes."""
    designs = stored(_primitives(spark, sf), "designs")
    from rillwork.plans.flow import STORM

    problem = _problem(spark, sf, params=replace(STORM, duration=60.0))
    return E.revalidated(designs, {"finer grid": E.finer(problem), "rain x 0.5": E.scaled(problem, rain=0.5), "rain x 1.5": E.scaled(problem, rain=1.5)})


@query("c13_ensemble_runs")
def c13b(spark, sf):
    """Every design point under one storm after another; what isn't feasible under one doesn't run the next."""
    from rillwork.plans.flow import STORM

    problem = _problem(spark, sf, params=replace(STORM, duration=60.0))
    return E.ensemble_evaluated(_primitives(spark, sf), [E.without_changes(E.scaled(problem, rain=k)) for k in (1.0, 1.5)], 0.5, 0.5)


@query("c11_lower_bound", f"""{V}, pk AS (SELECT k AS cand, cell, max(h) AS peak FROM traj, range(1, 8) AS t(k) WHERE step <= k GROUP BY 1, 2), ap AS (SELECT cand, asset, max(peak) AS peak FROM pk JOIN asset_cells USING (cell) GROUP BY 1, 2),
    o AS (SELECT cand, (peak - threshold) / 0.05 AS x, weight AS w FROM ap JOIN assets USING (asset)) SELECT cand::INT AS step, round(sum(w * 0.05 * CASE WHEN x > 30 THEN x WHEN x < -30 THEN exp(x) ELSE ln(1 + exp(x)) END) + 0.001::DOUBLE * (2 * 12.5 + 3 * 7.5), 6) AS bound FROM o GROUP BY cand""")
def c11(spark, sf):
    """What the objective can't be below any more, step by step."""
    peaks = D.traj(spark, sf, D.asset_cells(spark, sf)).withColumn("cand", F.explode(F.sequence(F.col("step").cast("int"), F.lit(7)))).groupBy("cand", "cell").agg(F.max("h").alias("peak"))
    volumes = spark.range(1, 8).selectExpr("cast(id AS int) AS cand", "12.5D AS cut_m3", "7.5D AS fill_m3")
    return E.objective(peaks, volumes, _problem(spark, sf)).select(F.col("cand").alias("step"), F.round("j", 6).alias("bound"))


@query("c8_asset_peaks", f"{V}, p AS (SELECT cell, max(h) AS peak FROM traj GROUP BY cell) SELECT asset, greatest(coalesce(max(peak), 0), 0) AS peak FROM asset_cells LEFT JOIN p USING (cell) GROUP BY asset")
def c8(spark, sf):
    return _asset_peaks(spark, sf)


OBJ = "p AS (SELECT cell, max(h) AS p1, max(h2) AS p2 FROM traj GROUP BY cell), ap AS (SELECT asset, coalesce(max(p1), 0) AS a, coalesce(max(p2), 0) AS b FROM asset_cells LEFT JOIN p USING (cell) GROUP BY asset), o AS (SELECT a - threshold AS x, weight AS w, b - threshold AS y FROM ap JOIN assets USING (asset))"


@query("c9_objective", f"{V}, {OBJ} SELECT round(sum(w * 0.05 * CASE WHEN x / 0.05 > 30 THEN x / 0.05 WHEN x / 0.05 < -30 THEN exp(x / 0.05) ELSE ln(1 + exp(x / 0.05)) END), 6) AS j_risk, round(sum(greatest(x, 0)), 6) AS total_exceedance_m, count(*) FILTER (x > 0) AS assets_exceeding FROM o")
def c9(spark, sf):
    rows = _asset_peaks(spark, sf).join(D.assets(spark, sf), "asset")
    return G.risk(rows, 0.05, []).withColumns({"j_risk": F.round("j_risk", 6), "total_exceedance_m": F.round("total_exceedance_m", 6)})


@query("c10_guard_breach", f"{V}, d AS (SELECT step, cell, h2 - h - 0.01 AS x FROM traj SEMI JOIN guard USING (cell)) SELECT step, max(x) AS exceedance, min(cell) FILTER (x = m) AS cell FROM (SELECT *, max(x) OVER (PARTITION BY step) AS m FROM d) WHERE m > 0 GROUP BY step")
def c10(spark, sf):
    """Per sync point the guarded cell that rose most, the first of equals."""
    d = D.traj(spark, sf).join(D.guard(spark, sf), "cell", "left_semi").select("step", "cell", (F.col("h2") - F.col("h") - 0.01).alias("x"))
    return d.groupBy("step").agg(F.min(F.struct(-F.col("x"), F.col("cell"))).alias("m")).select("step", (-F.col("m.col1")).alias("exceedance"), F.col("m.cell").alias("cell")).filter("exceedance > 0")


@query("c10_guard_summary", f"{V}, d AS (SELECT max(h2) - max(h) AS x FROM traj SEMI JOIN guard USING (cell) GROUP BY cell) SELECT greatest(coalesce(max(x), 0), 0) AS worst, count(*) FILTER (x > 0.01) AS cells_worsened, greatest(coalesce(max(x), 0) - 0.01, 0) AS violation FROM d")
def c10b(spark, sf):
    d = D.traj(spark, sf).groupBy("cell").agg((F.max("h2") - F.max("h")).alias("delta"))
    return G.guard_worsening(d, D.guard(spark, sf), 0.01)


@query("c12_robust_cvar", f"{V}, e AS (SELECT cand, j, row_number() OVER (PARTITION BY cand ORDER BY j DESC, member) AS i, count(*) OVER (PARTITION BY cand) AS n FROM ensemble) SELECT cand, round(avg(j) + 0.5 * avg(j) FILTER (i <= greatest(1, least(n, ceil(0.5 * n)))), 6) AS j FROM e GROUP BY cand")
def c12(spark, sf):
    return G.robust(D.ensemble(spark, sf), 0.5, 0.5).withColumn("j", F.round("j", 6))


@query("c13_ensemble_fold", f"{V}, s AS (SELECT *, min(member) FILTER (NOT feasible) OVER (PARTITION BY cand) AS stop FROM ensemble) SELECT cand, count(*) AS members_run, bool_and(feasible) AS feasible, round(avg(j), 6) AS mean FROM s WHERE stop IS NULL OR member <= stop GROUP BY cand")
def c13(spark, sf):
    return G.folded(D.ensemble(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("c15_unresolved", f"{V}, {PRIM} SELECT cand FROM prim WHERE height <> 0 AND width < 10")
def c15(spark, sf):
    return _primitives(spark, sf).filter("height != 0 AND width < 2 * 5").select("cand")


@query("c16_outcome", f"{V} SELECT eval_index, CASE WHEN NOT feasible OR j >= 250000 THEN 'infeasible' WHEN breach = 0 THEN 'improved_meets_thresholds' ELSE 'improved_partial' END AS outcome FROM trace")
def c16(spark, sf):
    return D.trace(spark, sf).select("eval_index", G.outcome(F.col("feasible"), F.col("breach"), F.col("j") < 250000).alias("outcome"))


@query("c17_reproduction", f"{V}, p AS (SELECT cell, max(h) AS a, max(h2) AS b FROM traj GROUP BY cell) SELECT count(*) AS n, count(*) FILTER (a = b) AS same, bool_and(a = b) AS reproduced FROM p")
def c17(spark, sf):
    peak = lambda k: D.traj(spark, sf).groupBy("cell").agg(F.max(k).alias("h"))
    d = R.difference(peak("h"), peak("h2"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("delta") == 0).alias("same"), F.bool_and(F.col("delta") == 0).alias("reproduced"))


@query("c18_run_compare", f"{V}, {OBJ.split(', o AS')[0]} SELECT a.asset, a.a AS peak_before, a.b AS peak_after, a.b - a.a AS change, s.threshold, a.a > s.threshold AS exceeded_before, a.b > s.threshold AS exceeded_after FROM ap a JOIN assets s USING (asset)")
def c18(spark, sf):
    """What changed between two runs, asset by asset."""
    both = _asset_peaks(spark, sf).withColumnRenamed("peak", "peak_before").join(_asset_peaks(spark, sf, "h2").withColumnRenamed("peak", "peak_after"), "asset").join(D.assets(spark, sf), "asset")
    return both.selectExpr("asset", "peak_before", "peak_after", "peak_after - peak_before AS change", "threshold", "peak_before > threshold AS exceeded_before", "peak_after > threshold AS exceeded_after")


@query("c19_reversals", f"{V}, p AS (SELECT step, sum(h) AS a, sum(h2) AS b, bool_and(h2 - h <= 0.035) AS ok FROM traj GROUP BY step) SELECT step, round(b / a, 9) AS ratio, NOT (ok AND b < a) AS reversal FROM p")
def c19(spark, sf):
    p = D.traj(spark, sf).groupBy("step").agg(F.sum("h").alias("a"), F.sum("h2").alias("b"), F.bool_and(F.col("h2") - F.col("h") <= 0.035).alias("ok"))
    return p.selectExpr("step", "round(b / a, 9) AS ratio", "NOT (ok AND b < a) AS reversal")
