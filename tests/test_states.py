"""What runs leave in the shared folder, and how many jobs they take."""

import glob

import numpy as np
import pyarrow as pa

from rillwork.operators import evaluation, flow, tiles
from rillwork.sources import stored
from tests.test_tiles import RAIN, basin, table, whole  # noqa: F401


def shared(spark, name):
    return len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{name}-*"))


def test_halved_steps_take_no_jobs_of_their_own(spark, basin):  # noqa: F811
    """Candidates that part leave the states behind that are still read, and go back within a job once they are careful."""
    grid, h = basin
    z = grid.z.copy()
    z[:, :7] += 3.0
    grid = flow.Grid(z, 0.03, grid.wall, dx=2.0, dy=3.0)
    p = tiles.Params(4.0, 2.0, rain=RAIN, dt_max=1.0, hold=6, scheme="inertial")
    runs = [whole(grid, h * k, p, 2.0, 3.0) for k in (1, 4)]
    cells = table(spark, grid, h).union(table(spark, grid, h * 4, 1))
    before = shared(spark, "tiles")
    done, outcome = flow.run_batch(cells, p, 2.0, 3.0, tile=8)
    for k, (end, peak, _, repeats, _) in enumerate(runs):
        got = done.filter(f"cand = {k}").orderBy("cell").select("h", "peak").collect()
        assert (np.array([r.h for r in got]).reshape(h.shape) == end).all() and (np.array([r.peak for r in got]).reshape(h.shape) == peak).all()
    assert max(r[3] for r in runs) > 2
    steps = {r.cand: r.steps for r in outcome.ledger.filter("number = 2").collect()}
    assert steps == {k: r[2] for k, r in enumerate(runs)}
    assert shared(spark, "tiles") - before <= 4
    assert outcome.jobs < max(jobs_of(grid, h * k, p) for k in (1, 4))


def jobs_of(grid, h, p):
    """Jobs of a run that repeats one for each halving."""
    count = 0
    real = tiles.schedule

    def counted(*args):
        nonlocal count
        count += 1
        return real(*args)

    tiles.schedule = counted
    try:
        whole(grid, h, p, 2.0, 3.0)
    finally:
        tiles.schedule = real
    return count


def test_candidates_run_beside_the_run_without_changes(spark):
    """Rows for the tiles that a change reaches, with the outcomes of whole runs to the last bit; what gets too fast has a run of its own."""
    z = np.fromfunction(lambda i, j: 0.02 * i + 0.3 * np.sin(i * 1.7 + j), (120, 8))
    cells = table(spark, flow.Grid(z, 0.03, np.zeros(z.shape, bool), 1.0, 1.0), np.zeros(z.shape)).drop("cand")
    assets = spark.createDataFrame([(k, 0.002 * k, 1.0 + 0.37 * k) for k in range(40)], "asset int, threshold double, weight double")
    at = spark.createDataFrame([(k, 24 * k + j) for k in range(40) for j in range(3)], "asset int, cell bigint")
    guard = spark.createDataFrame([(c,) for c in range(0, 960, 7)], "cell bigint")
    p = flow.Params(2.0, 1.0, rain=((0.0, 0.001),), hold=3)
    problem = evaluation.Problem(cells, cells.select("cell", "r", "c"), assets, at, guard, p, 8, 1.0, tile=6, tolerance=0.004, cost_weight=0.01, max_slope=9.0, pit_depth=9.0)
    rows = [(1, 0, "berm", 4.0, 30.0, 4.0, 2.0, 0.0, 0.3), (2, 0, "swale", 3.0, 70.0, 3.0, 2.0, 90.0, 0.2), (3, 0, "berm", 4.0, 100.0, 6.0, 3.0, 0.0, 0.9), (4, 0, "berm", 4.0, 50.0, 6.0, 3.0, 0.0, 0.0)]
    made = spark.createDataFrame(rows, "cand bigint, slot int, kind string, x double, y double, length double, width double, angle double, height double")
    known = evaluation.without_changes(problem)
    assert known.known.trail
    alone = evaluation.replace(known, known=evaluation.replace(known.known, trail=None))
    got = lambda of, **more: sorted(map(tuple, evaluation.evaluated(made, of, **more).select(*evaluation.OUTCOME.replace(",", "").split()[::2]).collect()))
    whole = got(alone)
    assert got(known) == whole and len(whole) == 4
    bound = sorted(r[3] for r in whole)[1]
    assert got(known, incumbent=bound) == got(alone, incumbent=bound)
    owned = tiles.tiles_near(spark.createDataFrame([(1, 30 * 8 + 4)], "cand bigint, cell bigint"), 5, known.domain)
    assert {r.tile for r in owned.collect()} == {i * 2 + j for i in (4, 5) for j in (0, 1)}


def test_a_worker_gets_few_tiles_at_once(spark):
    """A tile takes up to some hundred kB, so a worker's memory mustn't follow from the rows that a file has."""
    seen = lambda batches: (b.slice(0, 1).select(["id"]).set_column(0, "id", pa.array([b.num_rows], pa.int64())) for b in batches)
    before = spark.conf.get(stored.BATCH)
    df = spark.range(100, numPartitions=1).mapInArrow(seen, "id bigint")
    assert stored.stored(df, "seen").agg({"id": "max"}).first()[0] == 100
    assert stored.stored(df, "seen", stored.TILES).agg({"id": "max"}).first()[0] <= stored.TILES < 100
    assert spark.conf.get(stored.BATCH) == before


def test_steps_end_where_they_are_not_sound(monkeypatch):
    """A tile whose held step has become too long takes no further ones, carefully or not, and gives what it gave of the counts before."""
    domain, taken = tiles.Domain(6, 6, 5.0, 5.0, 6), []
    real = tiles.kernel.inertial_step
    monkeypatch.setattr(tiles.kernel, "inertial_step", lambda *a: taken.append(a[1]) or real(*a))
    cells = {"z": np.zeros((6, 6)), "n": np.full((6, 6), 0.03), "wall": np.zeros((6, 6), bool), "h": np.ones((6, 6)), "qx": np.zeros((6, 6)), "qy": np.zeros((6, 6)), "peak": np.ones((6, 6)), "t_peak": np.zeros((6, 6)), "first_wet": np.zeros((6, 6))}
    for most, level, over in ((8, 2, False), (4, 0, True)):
        p = tiles.Params(60.0, 60.0, dt_max=5.0, hold=most, scheme="inertial")
        row = {"cand": 0, "tile": 0, "a": 0, "b": 0} | {k: v.tobytes() for k, v in cells.items()} | {"totals": [0.0] * len(tiles.TOTALS)}
        row |= {"t": 0.0, "rate": 0.01, "hold": 4, "steps": 0, "dt_min": None, "dt_max": None, "rain_scale": 1.0, "inflow_scale": 1.0}
        taken.clear()
        got = tiles._advanced(domain, p, most + 2, 60.0)(pa.table({k: [v] for k, v in row.items()})).to_pylist()
        assert taken == [5.0]
        assert [(r["level"], r["first"], r["over"]) for r in got] == [(level, level, over)]
    assert got[0]["healthy"]
