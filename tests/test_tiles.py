"""Runs as tables of tiles against runs in arrays; clocks, sides, dry tiles and statuses."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import flow, kernel, sides, tiles
from rillwork.operators.sides import Segment

CELLS = "cand bigint, cell bigint, r bigint, c bigint, z double, n double, wall boolean, h double, qx double, qy double"


def table(spark, grid, h, cand=0, z=None):
    ny, nx = grid.z.shape
    z = grid.z if z is None else z
    rows = [(cand, i * nx + j, i, j, float(z[i, j]), float(grid.n[i, j]), bool(grid.wall[i, j]), float(h[i, j]), 0.0, 0.0) for i in range(ny) for j in range(nx)]
    return spark.createDataFrame(rows, CELLS)


def field(done, name, shape):
    return np.array([r[0] for r in done.orderBy("cell").select(F.coalesce(name, F.lit(np.nan))).collect()]).reshape(shape)


def whole(grid, h, p, dx, dy):
    """The same schedule of held steps over the whole grid at once."""
    ny, nx = grid.z.shape
    at = (slice(None), slice(None))
    border = {s: sides.border(p.sides, s, 0, nx if s in ("north", "south") else ny, nx, ny, dx, dy) for s in sides.SIDES}
    b = kernel.Block(h, np.zeros_like(h), np.zeros_like(h), grid.z, np.array(grid.n), grid.wall, border)
    inertial = p.scheme == "inertial"
    step = kernel.inertial_step if inertial else kernel.hll_step
    t, hold, peak, steps, repeats, sums = 0.0, p.hold, h.copy(), 0, 0, {}
    for number in range(1, p.last() + 1):
        while t < p.sync_time(number):
            old, over, gains, before, top, count = b, False, [], 0.0, peak.copy(), 0
            for begin, dt, end in tiles.schedule(t, kernel.courant_rate(b, dx, dy, at, inertial), hold, p.sync_time(number), p):
                over |= not before * dt <= tiles.LIMIT[p.scheme]
                b, g = step(b, dt, tiles.rain_between(p.rain, begin, end), p.infiltration * dt, sides.totals(p.sides, begin + dt / 2), dx, dy, at)
                gains.append(g)
                top, before, count, last = np.maximum(top, b.h), kernel.courant_rate(b, dx, dy, at, inertial), count + 1, end
            if over and hold > 1 and count > 1:
                b, hold, repeats = old, hold // 2, repeats + 1
                continue
            peak, t, steps, hold = top, last, steps + count, min(2 * hold, p.hold)
            for g in gains:
                for s in sides.SIDES:
                    sums[f"in_{s}"] = sums.get(f"in_{s}", 0) + g.into[s]
                    sums[f"out_{s}"] = sums.get(f"out_{s}", 0) + g.out_of[s]
    return b.h, peak, steps, repeats, sums


@pytest.fixture(scope="module")
def basin():
    rng = np.random.default_rng(4)
    wall = np.zeros((11, 14), bool)
    wall[3:5, 6:9] = True
    return flow.Grid(rng.random((11, 14)) * 0.2, 0.03, wall, dx=2.0, dy=3.0), np.where(wall, 0.0, rng.random((11, 14)) * 0.1)


RAIN = ((0.0, 0.002), (1.5, 0.0))
ALL_SIDES = (
    Segment("west", "inflow", 3.0, 17.9, knots=((0, 0.0), (2, 4.0), (9, 1.0))), Segment("east", "open"), Segment("north", "stage", level=0.35), Segment("north", "wall", 0.0, 6.0), Segment("south", "open", 4.0, 15.0),
)


@pytest.mark.parametrize(("scheme", "hold", "ends"), [("hll", 1, ()), ("hll", 4, ()), ("hll", 3, ALL_SIDES), ("inertial", 1, ()), ("inertial", 3, (Segment("east", "open"), Segment("south", "open")))])
def test_tiles_have_the_bits_of_the_whole_grid(spark, basin, scheme, hold, ends):
    grid, h = basin
    p = tiles.Params(2.0, 1.0, rain=RAIN, infiltration=1e-4, scheme=scheme, dt_max=1.0, sides=ends, hold=hold)
    end, peak, steps, _, sums = whole(grid, h, p, 2.0, 3.0)
    done, outcome = flow.run_batch(table(spark, grid, h), p, 2.0, 3.0, tile=6)
    assert (field(done, "h", h.shape) == end).all() and (field(done, "peak", h.shape) == peak).all()
    rows = outcome.ledger.orderBy("number").collect()
    assert [r.t for r in rows] == [1.0, 2.0] and rows[-1].steps == steps and rows[-1]["cells"] == steps * h.size
    last = rows[-1].asDict()
    for k, v in sums.items():
        assert last[k] == pytest.approx(v, rel=1e-12, abs=1e-12)
    gained = last["rain"] - last["seeped"] + last["fix"] + sum(last[f"in_{s}"] - last[f"out_{s}"] for s in sides.SIDES) / 6.0
    assert last["volume"] == pytest.approx(last["v0"] + gained, rel=1e-12)


@pytest.mark.parametrize("ends", [{}, {"east": "open", "south": "open"}, {"north": ("stage", 0.3)}, {"west": ("inflow", lambda t: float(np.interp(t, [0, 2, 9], [0, 4, 1])), 1, 5)}])
def test_tiles_against_the_array_run(spark, basin, ends):
    grid, h = basin
    grid = replace(grid, sides=ends)
    named = tuple(Segment(s, k) if isinstance(k, str) else Segment(s, "stage", level=k[1]) if k[0] == "stage" else Segment(s, "inflow", 3.0, 18.0, knots=((0, 0.0), (2, 4.0), (9, 1.0))) for s, k in ends.items())
    p = tiles.Params(1.5, 1.5, rain=RAIN, dt_max=1.0, sides=named)
    run = flow.Run(grid, p, h)
    list(run.syncs())
    done, outcome = flow.run_batch(table(spark, grid, h), p, 2.0, 3.0, tile=5)
    assert np.allclose(field(done, "h", h.shape), run.h, atol=1e-12) and np.allclose(field(done, "peak", h.shape), run.peak, atol=1e-12)
    last = outcome.ledger.orderBy(F.desc("number")).first().asDict()
    assert sum(last[f"in_{s}"] for s in sides.SIDES) == pytest.approx(run.sums["inflow"], rel=1e-9, abs=1e-12)
    assert sum(last[f"out_{s}"] for s in sides.SIDES) == pytest.approx(run.sums["outflow"], rel=1e-9, abs=1e-12)


def test_a_candidate_does_not_depend_on_its_batch(spark, basin):
    grid, h = basin
    p = tiles.Params(2.0, 1.0, rain=RAIN, dt_max=1.0, hold=4)
    fast = table(spark, grid, h * 9, 1)
    alone, _ = flow.run_batch(table(spark, grid, h), p, 2.0, 3.0, tile=6)
    both, outcome = flow.run_batch(table(spark, grid, h).union(fast), p, 2.0, 3.0, tile=6)
    for name in ("h", "qx", "qy", "peak", "t_peak"):
        assert np.array_equal(field(alone, name, h.shape), field(both.filter("cand = 0"), name, h.shape), equal_nan=True)
    steps = {r.cand: r.steps for r in outcome.ledger.filter("number = 2").collect()}
    assert steps[1] > steps[0]


def test_an_unhealthy_candidate_leaves_and_the_others_go_on(spark, basin):
    grid, h = basin
    bad = h.copy()
    bad[0, 0] = np.nan
    p = tiles.Params(2.0, 1.0, dt_max=1.0)
    done, outcome = flow.run_batch(table(spark, grid, h).union(table(spark, grid, bad, 1)), p, 2.0, 3.0, tile=6)
    assert {r.cand for r in done.select("cand").distinct().collect()} == {0} and [tuple(r) for r in outcome.gone.collect()] == [(1, 0.0)]


def test_held_steps_go_back_where_a_wave_gets_too_fast(spark):
    """Water on a steep bed: the first rate is of still water, and it soon runs faster than the step allows."""
    z = np.linspace(0, -15, 30) * np.ones((3, 1))
    h = np.where(np.arange(30) < 6, 0.5, 0.0) * np.ones((3, 1))
    grid = flow.Grid(z, 0.01)
    p = tiles.Params(1.0, 1.0, cfl=0.45, hold=8)
    end, peak, steps, repeats, _ = whole(grid, h, p, 1.0, 1.0)
    assert repeats > 0
    done, outcome = flow.run_batch(table(spark, grid, h), p, 1.0, 1.0, tile=10)
    assert (field(done, "h", h.shape) == end).all() and outcome.ledger.first().steps == steps


def test_dry_tiles_have_no_rows_until_water_comes_near(spark):
    z = np.linspace(1, 0, 40)[None, :] * np.ones((8, 1))
    grid, h = flow.Grid(z, 0.02), np.zeros((8, 40))
    p = tiles.Params(6.0, 3.0, dt_max=0.5, hold=2, sides=(Segment("west", "inflow", 2.0, 6.0, knots=((0, 0.4), (9, 0.4))),))
    end, peak, steps, _, sums = whole(grid, h, p, 1.0, 1.0)
    assert (end[:, :20] > 0).any() and not (end[:, 32:] > 0).any()
    done, outcome = flow.run_batch(table(spark, grid, h), p, 1.0, 1.0, tile=8)
    assert (field(done, "h", h.shape) == end).all() and (field(done, "peak", h.shape) == peak).all()
    assert outcome.state.count() < 5
    first_wet = field(done, "first_wet", h.shape)
    assert (np.isnan(first_wet) == (peak <= 1e-6)).all()


def test_rain_later_brings_all_tiles_in(spark):
    grid, h = flow.Grid(np.fromfunction(lambda i, j: 0.01 * j, (6, 20)), 0.03), np.zeros((6, 20))
    p = tiles.Params(4.0, 1.0, dt_max=0.5, rain=((0, 0), (2, 0), (2.5, 0.001), (4, 0)))
    end, peak, steps, _, _ = whole(grid, h, p, 1.0, 1.0)
    done, outcome = flow.run_batch(table(spark, grid, h), p, 1.0, 1.0, tile=5)
    assert (field(done, "h", h.shape) == end).all() and (end > 0).all()


def test_warm_start_gives_the_whole_run(spark):
    """A change where water comes late: the run begins at the last sync point before that, with fewer steps and the same end."""
    z = np.linspace(1, 0, 24)[None, :] * np.ones((6, 1))
    grid, h = flow.Grid(z, 0.02), np.zeros((6, 24))
    p = tiles.Params(3.0, 1.0, dt_max=0.5, hold=6, sides=(Segment("west", "inflow", knots=((0, 0.5), (20, 0.5))),))
    domain = tiles.Domain(24, 6, 1.0, 1.0, 8)
    base = tiles.tiled(table(spark, grid, h), domain).cache()
    edits = spark.createDataFrame([(7, 3 * 24 + 14, 0.05), (7, 2 * 24 + 14, 0.05), (8, 3 * 24 + 1, 0.05)], "cand bigint, cell bigint, dz double")
    ground = lambda keys: tiles.edited(keys, base, edits, domain)
    cands = spark.createDataFrame([(7,), (8,)], "cand bigint")
    cold = tiles.run_tiles(cands, ground, domain, p)
    one = spark.createDataFrame([(0,)], "cand bigint")
    known = tiles.run_tiles(one, ground, domain, p, keep=True)
    start = tiles.warm_start(edits, known, ground, domain, p)
    assert {r.cand: r.number for r in start.select("cand", "number").distinct().collect()}.keys() == {7}
    warm = tiles.run_tiles(cands, ground, domain, p, start=start)
    a, b = (tiles.cells_of(x.state, domain).orderBy("cand", "cell").select("cand", "cell", "h", "qx", "qy", "peak", "t_peak", "first_wet").collect() for x in (cold, warm))
    assert a == b and any(r.peak > 0 for r in a)
    work = lambda x: {r[0]: r[1] for r in x.ledger.groupBy("cand").agg(F.max("cells")).collect()}
    assert work(warm)[7] < work(cold)[7] and work(warm)[8] == work(cold)[8]


def test_side_cells_table_is_what_blocks_have(spark):
    segments = (Segment("west", "inflow", 3.0, 17.9), Segment("west", "open", 10.0, 11.0), Segment("north", "stage", level=0.35), Segment("north", "wall", 0.0, 6.0), Segment("south", "open", -4.0, 99.0), Segment("east", "open", 5.0, 5.0))
    rows = [(k, s.side, s.kind, s.start, s.end, s.level) for k, s in enumerate(segments)]
    got = sides.side_cells(spark.createDataFrame(rows, "segment int, side string, kind string, start double, end double, level double"), 14, 11, 2.0, 3.0).collect()
    assert len(got) == 2 * (14 + 11)
    for s in sides.SIDES:
        n = 14 if s in ("north", "south") else 11
        b = sides.border(segments, s, 0, n, 14, 11, 2.0, 3.0)
        mine = sorted((r.pos, sides.KINDS.index(r.kind), r.level or 0.0, r.inv_len or 0.0) for r in got if r.side == s)
        assert mine == [(i, int(b.kind[i]), float(b.level[i]) if b.kind[i] == 2 else 0.0, float(b.inverse[i])) for i in range(n)]
