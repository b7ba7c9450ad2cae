"""Queries of the raster operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rillwork.operators import raster as R
from rillwork.plans.registry import query
from rillwork.sources import domain as D
from rillwork.sources import rasters
from rillwork.sources.stored import shared_folder

V = f"WITH {D.SQL}"
NY = "(SELECT max(r) + 1 FROM cells)"


def _ny(spark, sf):
    """Rows of the grid: the one driver figure that neighbour queries need."""
    return int(D.cells(spark, sf).agg(F.max("r") + 1).first()[0])


def _mask(spark, sf):
    """Rough ground: some two thirds of the cells, in patches."""
    return D.cells(spark, sf).filter("n < 0.033").select("cell", "r", "c")


def _edits(spark, sf):
    """Each part's dimension as a cut or fill; none where it is 25."""
    return D.table(spark, sf, "part").filter("p_size != 25").select(F.col("p_partkey").alias("cell"), ((F.col("p_size") - 25) * 0.125).alias("dz"))


EDITS = "edits AS (SELECT p_partkey AS cell, (p_size - 25) * 0.125 AS dz FROM part WHERE p_size <> 25)"
MASK = "mask AS (SELECT cell, r, c FROM cells WHERE n < 0.033::DOUBLE)"


@query("a1_cell_centers", f"{V} SELECT cell, 100 + (c + 0.5) * 5 AS x, 900 - (r + 0.5) * 5 AS y FROM cells")
def a1(spark, sf):
    x, y = R.centre(F.col("r"), F.col("c"), 100.0, 900.0, 5.0)
    return D.cells(spark, sf).select("cell", x.alias("x"), y.alias("y"))


@query(
    "r2_rasterize",
    f"""{V}, box AS (SELECT s_suppkey AS poly, (s_suppkey % 40) + 0.25 AS x, (s_suppkey * 7 % 30) + 0.25 AS y FROM supplier),
    hit AS (SELECT poly, cell, c + 0.5 AS px, r + 0.5 AS py, x, y FROM box, cells WHERE c + 0.5 > x AND c + 0.5 < x + 6 AND r + 0.5 > y AND r + 0.5 < y + 4)
    SELECT poly, cell FROM hit WHERE NOT (px > x + 2 AND px < x + 4 AND py > y + 1 AND py < y + 3)""",
)
def r2(spark, sf):
    """Rectangles with a hole, one per supplier."""
    box = D.table(spark, sf, "supplier").selectExpr("s_suppkey AS poly", "(s_suppkey % 40) + 0.25D AS x", "-((s_suppkey * 7 % 30) + 0.25D) AS y")
    ring = "array(struct(x + {0} AS x, y - {1} AS y), struct(x + {2} AS x, y - {1} AS y), struct(x + {2} AS x, y - {3} AS y), struct(x + {0} AS x, y - {3} AS y))"
    rings = box.selectExpr("poly", "0 AS ring", ring.format("0D", "0D", "6D", "4D") + " AS points").union(box.selectExpr("poly", "1 AS ring", ring.format("2D", "1D", "4D", "3D") + " AS points"))
    return R.rasterize(D.cells(spark, sf), R.edges_of(rings), 0.0, 0.0, 1.0)


@query("r3_mask_union", f"{V}, {MASK}, u AS (SELECT cell FROM mask UNION SELECT cell FROM guard) SELECT count(*) AS n_cells, min(cell) AS first_cell, max(cell) AS last_cell FROM u")
def r3(spark, sf):
    return _mask(spark, sf).select("cell").union(D.guard(spark, sf)).distinct().agg(F.count("*").alias("n_cells"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))


@query(
    "r4_outer_ring",
    f"""{V}, {MASK}, near AS (SELECT DISTINCT (r + i) * 50 + c + j AS cell FROM mask, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(i, j)
    WHERE r + i BETWEEN 0 AND {NY} - 1 AND c + j BETWEEN 0 AND 49) SELECT cell FROM near WHERE cell NOT IN (SELECT cell FROM mask)""",
)
def r4(spark, sf):
    return R.outer_ring(_mask(spark, sf), D.NX, _ny(spark, sf))


@query("r5_coarse_mask", f"{V}, {MASK} SELECT DISTINCT (r // 4) * 13 + c // 4 AS cell FROM mask")
def r5(spark, sf):
    return _mask(spark, sf).select(R.coarse_cell(F.col("r"), F.col("c"), D.NX, 4).alias("cell")).distinct()


@query("r6_editable_bbox", f"{V}, {MASK} SELECT min(c) + 0.5 AS x_min, max(c) + 0.5 AS x_max, min(r) + 0.5 AS y_min, max(r) + 0.5 AS y_max FROM mask")
def r6(spark, sf):
    return _mask(spark, sf).agg(*(f(F.col(v) + 0.5).alias(f"{n}_{k}") for v, n in (("c", "x"), ("r", "y")) for f, k in ((F.min, "min"), (F.max, "max"))))


@query(
    "r7_rebase",
    f"""{V}, s AS (SELECT floor(min(z) FILTER (NOT wall)) AS z_ref, max(z) FILTER (NOT wall) AS z_max FROM cells)
    SELECT cell, round(CASE WHEN wall THEN z_max - z_ref + 100 ELSE z - z_ref END, 6) AS z, wall FROM cells, s""",
)
def r7(spark, sf):
    return R.rebased(D.cells(spark, sf)).select("cell", F.round("z", 6).alias("z"), "wall")


@query(
    "r8_block_mean",
    f"""{V} SELECT r // 4 AS r, c // 4 AS c, round(avg(z) FILTER (NOT wall), 6) AS z, round(coalesce(avg(n) FILTER (NOT wall), avg(n)), 9) AS n, bool_and(wall) AS wall, count(*) AS n_cells
    FROM cells GROUP BY 1, 2""",
)
def r8(spark, sf):
    return R.block_mean(D.cells(spark, sf), 4).withColumns({"z": F.round("z", 6), "n": F.round("n", 9)})


@query(
    "r9_face_rises",
    f"""{V} SELECT cell, coalesce(lead(z) OVER (PARTITION BY r ORDER BY c) - z, 0) AS east, coalesce(lead(z) OVER (PARTITION BY c ORDER BY r) - z, 0) AS south FROM cells""",
)
def r9(spark, sf):
    return R.face_rises(D.cells(spark, sf))


CRESTS = """t AS (SELECT *, CASE WHEN {c} % 4 = 3 THEN {c} // 4 WHEN {c} % 4 = 0 AND {c} > 0 THEN {c} // 4 - 1 END AS side FROM cells), top AS (SELECT max(z) FILTER (NOT wall) + 100 AS high FROM cells),
    w AS (SELECT {r} // 4 AS r, side AS c, coalesce(max(z) FILTER (NOT wall), max(high)) AS crest FROM t, top WHERE side IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT {r} // 4 AS r, {c} // 4 AS c, coalesce(avg(z) FILTER (NOT wall), max(high)) AS z FROM cells, top GROUP BY 1, 2)
    SELECT w.r, w.c, round(greatest(crest, a.z, b.z), 6) AS crest FROM w JOIN k a ON a.r = w.r AND a.c = w.c JOIN k b ON b.r = w.r AND b.c = w.c + 1"""


@query("r10_face_crest", f"{V}, {CRESTS.format(r='r', c='c')}")
def r10(spark, sf):
    return R.crests(D.cells(spark, sf), 4, "r", "c").withColumn("crest", F.round("crest", 6))


@query("r10_south_crest", f"{V}, {CRESTS.format(r='c', c='r')}")
def r10b(spark, sf):
    """The faces between a block and its south neighbour: rows and columns change places."""
    return R.crests(D.cells(spark, sf), 4, "c", "r").withColumn("crest", F.round("crest", 6))


@query("r11_wet_friction", f"{V} SELECT cell, NOT wall AS wet, 9.81 * n * n AS gn2 FROM cells".replace("9.81", "9.81::DOUBLE"))
def r11(spark, sf):
    return D.cells(spark, sf).select("cell", (~F.col("wall")).alias("wet"), (9.81 * F.col("n") * F.col("n")).alias("gn2"))


@query(
    "r12_boundary",
    """WITH side AS (SELECT range AS pos FROM range(200)), seg AS (SELECT s_suppkey AS seg, s_suppkey * 13 % 200 AS lo, s_suppkey * 13 % 200 + 9 AS hi, s_nationkey % 3 AS kind FROM supplier),
    hit AS (SELECT pos, kind, row_number() OVER (PARTITION BY pos ORDER BY seg DESC) AS k FROM side JOIN seg ON pos BETWEEN lo AND hi)
    SELECT pos, coalesce(kind, -1) AS kind FROM side LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (pos)""",
)
def r12(spark, sf):
    """Side cells take the kind of the last segment that covers them, else wall (-1)."""
    seg = D.table(spark, sf, "supplier").selectExpr("s_suppkey AS seg", "s_nationkey % 3 AS kind", "explode(sequence(s_suppkey * 13 % 200, s_suppkey * 13 % 200 + 9)) AS pos")
    last = seg.groupBy("pos").agg(F.max_by("kind", "seg").alias("kind"))
    return spark.range(200).withColumnRenamed("id", "pos").join(last, "pos", "left").select("pos", F.coalesce("kind", F.lit(-1)).alias("kind"))


@query("r13_edit_overlay", f"{V}, {EDITS} SELECT cell, z + coalesce(dz, 0) AS z FROM cells LEFT JOIN edits USING (cell)")
def r13(spark, sf):
    return R.overlaid(D.cells(spark, sf), _edits(spark, sf)).select("cell", "z")


@query(
    "r14_edited_faces",
    f"""{V}, {EDITS}, e AS (SELECT cell, r, c, z + coalesce(dz, 0) AS z, dz FROM cells LEFT JOIN edits USING (cell)),
    f AS (SELECT cell, dz, coalesce(lead(z) OVER w - z, 0) AS east, lead(dz) OVER w AS dz2 FROM e WINDOW w AS (PARTITION BY r ORDER BY c)) SELECT cell, east FROM f WHERE dz IS NOT NULL OR dz2 IS NOT NULL""",
)
def r14(spark, sf):
    """Only faces next to an edited cell are made again."""
    cells, edits = D.cells(spark, sf), _edits(spark, sf).withColumn("r", F.expr(f"cell div {D.NX}"))
    rows = cells.join(edits.select("r").distinct(), "r", "left_semi")
    touched = edits.select("cell", (F.col("cell") % D.NX).alias("c")).select(F.explode(F.when(F.col("c") > 0, F.array(F.col("cell"), F.col("cell") - 1)).otherwise(F.array("cell"))).alias("cell")).distinct()
    return R.face_rises(R.overlaid(rows, edits.select("cell", "dz"))).select("cell", "east").join(touched, "cell", "left_semi")


@query(
    "r15_refine",
    f"""{V}, k AS (SELECT unnest([0, 1]) AS i), f AS (SELECT r AS pr, c AS pc, r * 2 + a.i AS fr, c * 2 + b.i AS fc FROM cells, k a, k b),
    g AS (SELECT *, greatest(0.0::DOUBLE, least((fr + 0.5::DOUBLE) / 2 - 0.5, {NY} - 1.0)) AS y, greatest(0.0::DOUBLE, least((fc + 0.5::DOUBLE) / 2 - 0.5, 49.0)) AS x FROM f),
    h AS (SELECT fr, fc, floor(y) AS r0, floor(x) AS c0, least(floor(y) + 1, {NY} - 1) AS r1, least(floor(x) + 1, 49) AS c1, y - floor(y) AS wy, x - floor(x) AS wx FROM g)
    SELECT fr, fc, round(a.z + (b.z - a.z) * wx + ((e.z + (f.z - e.z) * wx) - (a.z + (b.z - a.z) * wx)) * wy, 6) AS z FROM h JOIN cells a ON a.r = r0 AND a.c = c0
    JOIN cells b ON b.r = r0 AND b.c = c1 JOIN cells e ON e.r = r1 AND e.c = c0 JOIN cells f ON f.r = r1 AND f.c = c1""",
)
def r15(spark, sf):
    return R.refined(D.cells(spark, sf), 2, D.NX, _ny(spark, sf)).withColumn("z", F.round("z", 6))


@query(
    "r16_raster_delta",
    f"""{V}, p AS (SELECT cell, max(h) AS a, max(h2) AS b FROM traj GROUP BY cell), d AS (SELECT b - a AS delta FROM p)
    SELECT greatest(max(delta), 0) AS max_increase_m, greatest(-min(delta), 0) AS max_decrease_m, count(*) FILTER (delta > 0.01) AS cells_worsened,
    count(*) FILTER (delta < -0.01) AS cells_improved, count(*) FILTER (delta > 0.01) * 25.0::DOUBLE AS area_worsened_m2, count(*) FILTER (delta < -0.01) * 25.0::DOUBLE AS area_improved_m2 FROM d""",
)
def r16(spark, sf):
    peaks = D.traj(spark, sf).groupBy("cell").agg(F.max("h").alias("h"), F.max("h2").alias("h2"))
    return R.summary(peaks.select("cell", (F.col("h2") - F.col("h")).alias("delta")), 25.0)


@query(
    "r17_edit_window",
    f"""{V}, {EDITS}, e AS (SELECT r, c FROM cells JOIN edits USING (cell) WHERE abs(dz) > 0)
    SELECT greatest(coalesce(min(r), 0) - 2, 0) AS r0, least(coalesce(max(r), {NY} - 1) + 2, {NY} - 1) AS r1, greatest(coalesce(min(c), 0) - 2, 0) AS c0, least(coalesce(max(c), 49) + 2, 49) AS c1 FROM e""",
)
def r17(spark, sf):
    return R.window_of(D.cells(spark, sf), _edits(spark, sf).filter("dz != 0"), 2)


@query(
    "r18_region_of_interest",
    f"""{V}, m AS (SELECT cell FROM asset_cells UNION SELECT cell FROM guard), b AS (SELECT min(r) - 20 AS r0, max(r) + 20 AS r1, min(c) - 20 AS c0, max(c) + 20 AS c1 FROM cells SEMI JOIN m USING (cell)),
    k AS (SELECT greatest(r0, 0) AS r0, least(r1, {NY} - 1) AS r1, greatest(c0, 0) AS c0, least(c1, 49) AS c1 FROM b) SELECT *, 2 * (r1 - r0 + 1) * (c1 - c0 + 1) <= 50 * {NY} AS accepted FROM k""",
)
def r18(spark, sf):
    """Water travels 97 m here, over cells of 5 m."""
    wanted = D.asset_cells(spark, sf).select("cell").union(D.guard(spark, sf)).distinct()
    return R.region_of_interest(D.cells(spark, sf), wanted, 97.0, 5.0)


@query(
    "r19_roi_ring",
    f"""{V}, b AS (SELECT cell, r, c FROM cells WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 30 AND (r IN (5, 20) OR c IN (10, 30))) SELECT cell, row_number() OVER (ORDER BY r, c) - 1 AS k FROM b""",
)
def r19(spark, sf):
    """The ring of a window has a place for each cell in closed form; nothing is sorted in one task."""
    k = "CASE WHEN r = 5 THEN c - 10 WHEN r = 20 THEN 21 + 2 * 14 + c - 10 ELSE 21 + 2 * (r - 6) + CASE WHEN c = 30 THEN 1 ELSE 0 END END"
    return D.cells(spark, sf).filter("r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 30 AND (r IN (5, 20) OR c IN (10, 30))").selectExpr("cell", f"{k} AS k")


@query("r20_sub_terrain", f"{V} SELECT (r - 5) * 21 + c - 10 AS cell, z, n, wall FROM cells WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 30")
def r20(spark, sf):
    return D.cells(spark, sf).filter("r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 30").selectExpr("(r - 5) * 21 + c - 10 AS cell", "z", "n", "wall")


@query(
    "r21_outline",
    f"""{V}, {MASK} SELECT m.cell, i AS di, j AS dj FROM mask m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(i, j) WHERE NOT EXISTS (SELECT 1 FROM mask o WHERE o.r = m.r + i AND o.c = m.c + j)""",
)
def r21(spark, sf):
    return R.outline(_mask(spark, sf), D.NX, _ny(spark, sf))


@query("io1_raster_files", f"{V} SELECT r::INT AS r, c::INT AS c, CASE WHEN NOT wall THEN round(z::FLOAT::DOUBLE, 3) END AS value FROM (SELECT g.r, g.c, coalesce(wall, true) AS wall, z FROM (SELECT a.r, b.c FROM (SELECT DISTINCT r FROM cells) a, range(50) AS b(c)) g LEFT JOIN cells USING (r, c))")
def io1(spark, sf):
    """The grid's heights written as files of 64 rows of it each, and read back; walls have no value."""
    cells = D.cells(spark, sf)
    grids = cells.select(F.floor(F.col("r") / 64).cast("int").alias("k"), "r").groupBy("k").agg((F.max("r") - F.first("k") * 64 + 1).cast("int").alias("ny"))
    name = F.format_string("rows-%05d.tif", F.col("k"))
    grids = grids.select(name.alias("file"), F.lit(D.NX).alias("nx"), "ny", F.lit(0.0).alias("x0"), (-F.col("k") * 320.0).alias("y0"), F.lit(5.0).alias("dx"), F.lit(5.0).alias("dy"), F.lit(32632).alias("epsg"))
    parts = cells.filter("NOT wall").withColumn("k", F.floor(F.col("r") / 64).cast("int")).select(name.alias("file"), (F.col("r") % 64).alias("r"), "c", F.col("z").alias("value"))
    folder = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    rasters.write_raster(parts, grids, folder, rows=16).write.parquet(f"{folder}-written")
    back = rasters.read_raster(spark, folder)
    k = F.regexp_extract("file", r"rows-(\d+)\.tif", 1).cast("int")
    return back.select((F.col("r") + k * 64).alias("r"), "c", F.round("value", 3).alias("value"))
