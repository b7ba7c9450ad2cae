"""Queries of the simulation's expressions, one step, runs and the analytic cases."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rillwork.functions import hydraulics as H
from rillwork.operators import evaluation, flow, sides, tiles, validation
from rillwork.plans.registry import query
from rillwork.sources import domain as D
from rillwork.sources.stored import TILES, shuffled, stored

V = f"WITH {D.SQL}"
#: Pairs of states on both sides of a face, from the rows of lineitem.
PAIRS = "pr AS (SELECT l_orderkey AS face, l_linenumber AS k, floor(l_quantity / 10) * 0.25::DOUBLE AS hl, l_discount * 10 AS hr, (l_tax - 0.04) * 50 AS ul, (l_discount - 0.05) * 40 AS ur, l_tax AS vl, l_discount AS vr, l_tax - 0.03 AS rise FROM lineitem)"


def _pairs(spark, sf):
    return D.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS face", "l_linenumber AS k", "floor(l_quantity / 10) * 0.25D AS hl", "l_discount * 10 AS hr", "(l_tax - 0.04D) * 50 AS ul", "(l_discount - 0.05D) * 40 AS ur", "l_tax AS vl", "l_discount AS vr", "l_tax - 0.03D AS rise"
    )


def _c(*names):
    return tuple(F.col(n) for n in names)


@query("a16_velocity", f"WITH {PAIRS} SELECT face, k, round(2 * hl * ul / (hl * hl + CASE WHEN hl * hl > 1e-10 THEN hl * hl ELSE 1e-10 END), 7) AS u, round(sqrt(9.81::DOUBLE * hr), 7) AS c FROM pr")
def a16(spark, sf):
    return _pairs(spark, sf).select("face", "k", F.round(H.velocity(*_c("hl", "ul")), 7).alias("u"), F.round(H.celerity(F.col("hr")), 7).alias("c"))


@query("a17_reconstruction", f"WITH {PAIRS} SELECT face, k, round(greatest(hl - greatest(rise, 0), 0), 9) AS a, round(greatest(hr - greatest(-rise, 0), 0), 9) AS b FROM pr")
def a17(spark, sf):
    a, b = H.reconstructed(*_c("hl", "hr", "rise"))
    return _pairs(spark, sf).select("face", "k", F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


@query("a18_crest_face", f"WITH {PAIRS} SELECT face, k, round(greatest(hl - vl, 0), 9) AS a, round(greatest(hr - vr, 0), 9) AS b FROM pr")
def a18(spark, sf):
    a, b = H.over_crest(*_c("hl", "hr", "vl", "vr"))
    return _pairs(spark, sf).select("face", "k", F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


HLL = f"""{PAIRS}, s AS (SELECT *, sqrt(9.81::DOUBLE * hl) AS cl, sqrt(9.81::DOUBLE * hr) AS cr FROM pr), w AS (SELECT *, (ul + ur) / 2 + cl - cr AS us, (cl + cr) / 2 + (ul - ur) / 4 AS cs FROM s),
    b AS (SELECT *, CASE WHEN hl <= 1e-6 THEN ur - 2 * cr WHEN hr <= 1e-6 THEN ul - cl ELSE least(ul - cl, us - cs) END AS lo, CASE WHEN hl <= 1e-6 THEN ur + cr WHEN hr <= 1e-6 THEN ul + 2 * cl ELSE greatest(ur + cr, us + cs) END AS hi FROM w),
    m AS (SELECT *, CASE WHEN hl <= 1e-6 AND hr <= 1e-6 THEN 0 WHEN lo >= 0 THEN hl * ul WHEN hi <= 0 THEN hr * ur ELSE (hi * hl * ul - lo * hr * ur + lo * hi * (hr - hl)) / (hi - lo) END AS mass,
    CASE WHEN hl <= 1e-6 AND hr <= 1e-6 THEN 0 WHEN lo >= 0 THEN hl * ul * ul + 4.905::DOUBLE * hl * hl WHEN hi <= 0 THEN hr * ur * ur + 4.905::DOUBLE * hr * hr
    ELSE (hi * (hl * ul * ul + 4.905::DOUBLE * hl * hl) - lo * (hr * ur * ur + 4.905::DOUBLE * hr * hr) + lo * hi * (hr * ur - hl * ul)) / (hi - lo) END AS normal FROM b)"""


@query("a19_hll_flux", f"WITH {HLL} SELECT face, k, round(mass, 6) AS mass, round(normal, 6) AS normal, round(CASE WHEN mass > 1e-9 THEN mass * vl WHEN mass < -1e-9 THEN mass * vr ELSE 0 END, 6) AS tangential FROM m")
def a19(spark, sf):
    f = H.hll(*_c("hl", "ul", "vl", "hr", "ur", "vr"))
    return _pairs(spark, sf).select("face", "k", *(F.round(f[n], 6).alias(n) for n in ("mass", "normal", "tangential")))


@query("a21_friction", f"WITH {PAIRS} SELECT face, k, round(CASE WHEN hl < 1e-6 THEN 0 ELSE ul / (1 + 0.5::DOUBLE * 0.009::DOUBLE * abs(ul) * pow(hl, -7.0::DOUBLE / 3)) END, 7) AS q FROM pr")
def a21(spark, sf):
    q = H.friction(F.col("ul"), F.abs("ul"), F.col("hl"), F.lit(0.009), F.lit(0.5))
    return _pairs(spark, sf).select("face", "k", F.round(H.flushed(q), 7).alias("q"))


@query(
    "a21_sources",
    f"""WITH {PAIRS}, s AS (SELECT face, k, hl - 5e-7::DOUBLE AS h0, ul AS qx, vl AS qy, k = 7 AS wall FROM pr),
    f AS (SELECT *, greatest(-h0, 0) AS fix, greatest(h0, 0) + CASE WHEN wall THEN 0 ELSE 5e-5::DOUBLE END AS h1 FROM s), g AS (SELECT *, CASE WHEN wall THEN 0 ELSE least(2.5e-5::DOUBLE, h1) END AS seeped FROM f),
    d AS (SELECT *, h1 - seeped AS h, CASE WHEN h1 - seeped < 1e-6 THEN NULL ELSE 1 + 0.5::DOUBLE * 9.81::DOUBLE * 0.0009::DOUBLE * sqrt(qx * qx + qy * qy) * pow(h1 - seeped, -7.0::DOUBLE / 3) END AS drag FROM g)
    SELECT face, k, round(h, 9) AS h, round(coalesce(qx / drag, 0), 7) AS qx, round(coalesce(qy / drag, 0), 7) AS qy, round(fix, 9) AS fix, round(seeped, 9) AS seeped, h0 >= -1e-6 AS healthy FROM d""",
)
def a21b(spark, sf):
    """All sources of a step, in their order."""
    rows = _pairs(spark, sf).select("face", "k", (F.col("hl") - 5e-7).alias("h"), F.col("ul").alias("qx"), F.col("vl").alias("qy"), F.lit(0.03).alias("n"), (F.col("k") == 7).alias("wall"))
    out = flow.sourced(rows, 0.5, 1e-4, 5e-5)
    return out.select("face", "k", *(F.round(c, 9).alias(c) for c in ("h", "fix", "seeped")), *(F.round(c, 7).alias(c) for c in ("qx", "qy")), "healthy")


@query("a23_critical_depth", f"WITH {PAIRS} SELECT face, k, round(cbrt(ul * ul / 9.81::DOUBLE), 7) AS h FROM pr")
def a23(spark, sf):
    return _pairs(spark, sf).select("face", "k", F.round(H.critical_depth(F.col("ul")), 7).alias("h"))


@query("a25_inertial_discharge", f"WITH {PAIRS} SELECT face, k, round(CASE WHEN hl > 1e-6 THEN (ul - 9.81::DOUBLE * hl * 0.5 * rise) / (1 + 9.81::DOUBLE * 0.0009::DOUBLE * 0.5 * abs(ul) * pow(hl, -7.0::DOUBLE / 3)) ELSE 0 END, 6) AS q FROM pr")
def a25(spark, sf):
    return _pairs(spark, sf).select("face", "k", F.round(H.inertial_discharge(F.col("ul"), F.col("hl"), F.col("rise"), F.lit(0.0009), 0.5), 6).alias("q"))


@query("a26_bed_jump", f"WITH {PAIRS} SELECT face, k, CASE WHEN k % 2 = 0 THEN rise ELSE vr - vl END AS jump, CASE WHEN k % 2 = 0 THEN abs(rise) ELSE greatest(vl, vr) END AS climb FROM pr")
def a26(spark, sf):
    signed = F.col("k") % 2 == 0
    return _pairs(spark, sf).select("face", "k", F.when(signed, F.col("rise")).otherwise(F.col("vr") - F.col("vl")).alias("jump"), F.when(signed, F.abs("rise")).otherwise(F.greatest("vl", "vr")).alias("climb"))


@query("s1_initial_state", f"{V} SELECT cell, CASE WHEN wall THEN 0 ELSE greatest(greatest(0.05::DOUBLE, 1100 - z), 0) END AS h FROM cells")
def s1(spark, sf):
    return D.cells(spark, sf).select("cell", F.when(F.col("wall"), 0.0).otherwise(F.greatest(F.lit(0.05), 1100 - F.col("z"), F.lit(0.0))).alias("h"))


@query("s2_courant_rate", f"WITH {PAIRS} SELECT k, round(max(CASE WHEN hl > 1e-6 THEN (abs(ul) / hl + sqrt(9.81::DOUBLE * hl)) / 2 + (abs(ur) / hl + sqrt(9.81::DOUBLE * hl)) / 2 ELSE 0 END), 7) AS rate FROM pr GROUP BY k")
def s2(spark, sf):
    return _pairs(spark, sf).groupBy("k").agg(F.round(F.max(H.courant_rate(*_c("hl", "ul", "ur"), 2.0, 2.0)), 7).alias("rate"))


@query("s2_inertial_rate", f"WITH {PAIRS} SELECT k, round(max(CASE WHEN hl > 1e-6 THEN (sqrt(9.81::DOUBLE * hl) + greatest(abs(ul), abs(ur)) / hl) / 2 ELSE 0 END), 7) AS rate FROM pr GROUP BY k")
def s2b(spark, sf):
    return _pairs(spark, sf).groupBy("k").agg(F.round(F.max(flow.inertial_rate(*_c("hl", "ul", "ur"), 2.0, 3.0)), 7).alias("rate"))


@query(
    "a20_flux_update",
    f"""{V}, f AS (SELECT cell, n AS east, z * 1e-4::DOUBLE AS south, r, c, max(c) OVER (PARTITION BY r) AS c1, max(r) OVER (PARTITION BY c) AS r1 FROM cells), e AS (SELECT cell, r, c, CASE WHEN c < c1 THEN east ELSE 0 END AS e, CASE WHEN r < r1 THEN south ELSE 0 END AS s FROM f)
    SELECT cell, round(1 + 0.25::DOUBLE * ((coalesce(lag(e) OVER (PARTITION BY r ORDER BY c), 0) - e) / 5 + (coalesce(lag(s) OVER (PARTITION BY c ORDER BY r), 0) - s) / 4), 9) AS h FROM e""",
)
def a20(spark, sf):
    """What enters and leaves a cell through its four faces."""
    rows = D.cells(spark, sf).select("cell", "r", "c", F.col("n").alias("east"), (F.col("z") * 1e-4).alias("south"), F.lit(1.0).alias("h"))
    return flow.through_faces(rows, 0.25, 5.0, 4.0).select("cell", F.round("h", 9).alias("h"))


def _ground(spark, sf):
    """A dry ground whose heights differ by a hundredth of what the stored ones do."""
    z = F.when(F.col("wall"), 1200.0).otherwise((F.col("z") - 900) * 0.01)
    return D.cells(spark, sf).select("cell", "r", "c", z.alias("z"), "n", "wall", *(F.lit(0.0).alias(k) for k in ("h", "qx", "qy")))


@query("s7_one_step")
def s7(spark, sf):
    """The whole step as one query; tests hold it against arrays."""
    state = _ground(spark, sf).withColumns({"h": F.when(F.col("wall"), 0.0).otherwise(1.0), "qx": F.lit(0.1), "qy": F.lit(-0.05)})
    return flow.one_step(state, 0.01, 5.0, 5.0, rain=1e-5).select("cell", "h", "qx", "qy")


def _nations(spark, sf):
    """(cand, cell, dz): each nation is a candidate that raises the ground where its suppliers are."""
    at = D.table(spark, sf, "supplier").selectExpr("cast(s_nationkey AS bigint) AS cand", "explode(sequence(s_suppkey * 31, s_suppkey * 31 + 7)) AS cell")
    return at.groupBy("cand", "cell").agg((F.count("*") * 0.05).alias("dz"))


#: Two minutes of a storm of up to 80 mm/h, with a sync point each minute and jobs of twelve steps.
STORM = flow.Params(120.0, 60.0, rain=((0, 30 * validation.MMH), (60, 80 * validation.MMH), (120, 10 * validation.MMH)), infiltration=10 * validation.MMH, hold=12)


def _runs(spark, sf, p):
    cells = _ground(spark, sf)
    problem = evaluation.prepared(evaluation.Problem(cells, cells.select("cell", "r", "c"), D.assets(spark, sf), D.asset_cells(spark, sf), D.guard(spark, sf), p, D.NX, 5.0))
    cands = D.table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS cand")
    inside = _nations(spark, sf).join(shuffled(cells.select("cell")), "cell", "left_semi")
    return tiles.run_tiles(cands, problem.ground(inside), problem.domain, p), problem.domain


def _peaks(spark, sf, p):
    done, domain = _runs(spark, sf, p)
    cells = tiles.cells_of(done.state, domain)
    peaks = cells.groupBy("cand").agg(F.count("*").alias("n_cells"), F.round(F.sum("peak"), 9).alias("sum_peak"), F.max("t_peak").alias("t_peak"), F.min("first_wet").alias("first_wet"))
    return stored(peaks, "peaks", TILES)


@query("s15_candidate_runs")
def s15(spark, sf):
    """Peaks of one run for each nation's change of the ground."""
    return _peaks(spark, sf, STORM)


@query("s25_inertial_runs")
def s25(spark, sf):
    return _peaks(spark, sf, replace(STORM, scheme="inertial"))


@query("s15_run_ledger")
def s15b(spark, sf):
    """The ledger of each nation's run at its sync points: what is there is what fell less what seeped away."""
    done, _ = _runs(spark, sf, STORM)
    return done.ledger.withColumn("residual", F.col("volume") - (F.col("v0") + F.col("rain") - F.col("seeped") + F.col("fix")))


#: A stage over half of the north side, an inflow in the west that grows with time, an open south.
ENDS = (sides.Segment("north", "stage", 0.0, 125.0, level=0.1), sides.Segment("west", "inflow", knots=((0, 0.0), (12, 0.6), (60, 0.2))), sides.Segment("south", "open"))


@query("s12_side_ledger")
def s12b(spark, sf):
    """What has flowed in and out through each side by each sync point, for each nation's run beside a stage, an inflow and an open side; and the residual of the ledger."""
    done, _ = _runs(spark, sf, replace(STORM, duration=12.0, sync=6.0, sides=ENDS))
    moved = sum((F.col(f"in_{s}") - F.col(f"out_{s}") for s in sides.SIDES), F.lit(0.0)) / 25.0
    rows = done.ledger.withColumn("residual", F.col("volume") - (F.col("v0") + F.col("rain") - F.col("seeped") + F.col("fix") + moved))
    return rows.select("cand", "number", "t", "residual", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"in_{s}").alias("inflow"), F.col(f"out_{s}").alias("outflow")) for s in sides.SIDES))).alias("x")).select("cand", "number", "t", "residual", "x.*")


SEGMENTS = "sg AS (SELECT s_suppkey AS segment, CASE s_nationkey % 4 WHEN 0 THEN 'west' WHEN 1 THEN 'east' WHEN 2 THEN 'north' ELSE 'south' END AS side, CASE s_suppkey % 4 WHEN 0 THEN 'wall' WHEN 1 THEN 'open' WHEN 2 THEN 'stage' ELSE 'inflow' END AS kind, s_nationkey * 7.5::DOUBLE - 10 AS start, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey * 7.5::DOUBLE + s_suppkey % 60 END AS stop, s_acctbal / 100 AS level FROM supplier)"


@query(
    "r12_side_cells",
    f"""{V}, {SEGMENTS}, sz AS (SELECT max(r)::INT + 1 AS ny FROM cells), b AS (SELECT sg.*, CASE WHEN side IN ('north', 'south') THEN 50 ELSE ny END AS n FROM sg, sz),
    x AS (SELECT *, CASE WHEN stop IS NULL THEN 0 ELSE least(greatest(floor(start / 5), 0), n) END AS a, CASE WHEN stop IS NULL THEN n ELSE least(greatest(ceil(stop / 5), 0), n) END AS e FROM b),
    c AS (SELECT x.*, pos, row_number() OVER (PARTITION BY side, pos ORDER BY segment DESC) AS k FROM x, range(10000) AS t(pos) WHERE pos >= a AND pos < e),
    s AS (SELECT u.side, pos FROM sz, (VALUES ('west', true), ('east', true), ('north', false), ('south', false)) AS u(side, down), range(10000) AS t(pos) WHERE pos < CASE WHEN down THEN ny ELSE 50 END)
    SELECT s.side, s.pos::INT AS pos, coalesce(kind, 'wall') AS kind, segment, CASE WHEN kind = 'stage' THEN level END AS level, CASE WHEN kind = 'inflow' THEN 1 / ((e - a) * 5::DOUBLE) END AS inv_len FROM s LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (side, pos)""",
)
def r12b(spark, sf):
    """Stretches of the sides in metres, as the kinds of their cells; the last stretch holds."""
    kinds = F.create_map(*(F.lit(x) for pair in enumerate(("west", "east", "north", "south")) for x in pair)), F.create_map(*(F.lit(x) for pair in enumerate(sides.KINDS) for x in pair))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    segments = D.table(spark, sf, "supplier").select(
        key.alias("segment"), kinds[0][(nation % 4).cast("int")].alias("side"), kinds[1][(key % 4).cast("int")].alias("kind"), (nation * 7.5 - 10).alias("start"), F.when(key % 5 > 0, nation * 7.5 + key % 60).alias("end"), (F.col("s_acctbal") / 100).alias("level")
    )
    ny = int(D.cells(spark, sf).agg(F.max("r")).first()[0]) + 1
    return sides.side_cells(segments, D.NX, ny, 5.0, 5.0)


@query("s9_wet_tiles")
def s9(spark, sf):
    """Runs beside an inflow without rain: cell updates done, and how many of all cells' updates the dry tiles have saved."""
    done, domain = _runs(spark, sf, replace(STORM, duration=12.0, sync=12.0, rain=((0.0, 0.0),), sides=ENDS[1:2]))
    n = domain.nx * domain.ny
    return done.ledger.select("cand", "t", "steps", "cells", "skipped", (F.col("steps") * n - F.col("cells")).alias("without_rows"))


@query("s22_warm_runs")
def s22b(spark, sf):
    """Runs of each nation's change from the last state before water comes to it, against runs from the beginning: steps taken, and whether all peaks are the same."""
    p = replace(STORM, duration=12.0, sync=4.0, rain=((0.0, 0.0),), sides=ENDS[1:2])
    cells = _ground(spark, sf)
    problem = evaluation.without_changes(evaluation.Problem(cells, cells.select("cell", "r", "c"), D.assets(spark, sf), D.asset_cells(spark, sf), D.guard(spark, sf), p, D.NX, 5.0), warm=True)
    edits = _nations(spark, sf).join(shuffled(cells.select("cell")), "cell", "left_semi")
    cands, ground = edits.select("cand").distinct(), problem.ground(edits)
    start = tiles.warm_start(edits, problem.known, ground, problem.domain, p)
    cold, warm = tiles.run_tiles(cands, ground, problem.domain, p), tiles.run_tiles(cands, ground, problem.domain, p, start=start)
    at = lambda x, k: tiles.cells_of(x.state, problem.domain).filter("peak > 0").select("cand", "cell", F.col("peak").alias(k))
    same = at(cold, "a").join(at(warm, "b"), ["cand", "cell"], "full").groupBy("cand").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    work = lambda x, k: x.ledger.groupBy("cand").agg(F.max("cells").alias(k))
    begun = start.groupBy("cand").agg(F.max("number").alias("from"))
    return work(cold, "cells_cold").join(work(warm, "cells_warm"), "cand").join(same, "cand", "left").join(begun, "cand", "left").select("cand", F.coalesce("from", F.lit(0)).alias("from"), "cells_cold", "cells_warm", F.coalesce("same", F.lit(True)).alias("same"))


@query("e33_validation")
def e33(spark, sf):
    return validation.checks(spark)


@query("e32_bench_case", f"{V} SELECT step, count(*) AS cell_updates, round(count(*) / 0.5, 3) AS per_second, round(count(*) * 24 / 0.5 / 1e9, 12) AS gb_per_second FROM traj GROUP BY step")
def e32(spark, sf):
    n = F.count("*")
    return D.traj(spark, sf).groupBy("step").agg(n.alias("cell_updates"), F.round(n / 0.5, 3).alias("per_second"), F.round(n * 24 / 0.5 / 1e9, 12).alias("gb_per_second"))
