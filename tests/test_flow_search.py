"""The two forms of a time step, the analytic cases, search pieces, exchange files and the stream."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import corridors, design, evaluation, flow, ranking, search, surrogate, validation
from rillwork.operators.sides import Segment
from rillwork.plans import search as plans
from rillwork.sources import exchange
from rillwork.sources.stored import stored
from rillwork.streaming import sync


@pytest.mark.parametrize("name", sorted(validation.CASES))
def test_analytic_case(name):
    _, value, threshold = validation.CASES[name]()
    assert value <= threshold


def test_one_step_query_is_the_kernel_step(spark):
    rng = np.random.default_rng(3)
    ny, nx, dt = 7, 9, 0.05
    z, h = rng.random((ny, nx)), rng.random((ny, nx)) * (rng.random((ny, nx)) > 0.2)
    qx, qy = (rng.normal(0, 0.2, (ny, nx)) * (h > 0) for _ in range(2))
    run = flow.Run(flow.Grid(z, 0.03), flow.Params(1.0), h)
    run.qx, run.qy = qx.copy(), qy.copy()
    run.step(dt)
    rows = [(i * nx + j, i, j, float(z[i, j]), 0.03, False, float(h[i, j]), float(qx[i, j]), float(qy[i, j])) for i in range(ny) for j in range(nx)]
    cells = spark.createDataFrame(rows, "cell int, r int, c int, z double, n double, wall boolean, h double, qx double, qy double")
    for r in flow.one_step(cells, dt, 1.0, 1.0).collect():
        i, j = divmod(r.cell, nx)
        assert (r.h, r.qx, r.qy) == pytest.approx((run.h[i, j], run.qx[i, j], run.qy[i, j]), abs=1e-11)


def test_pareto_against_definition(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (600, 2)))]
    want = {i for i, a, b in pts if not any((c <= a and d <= b) and (c < a or d < b) for _, c, d in pts)}
    got = ranking.pareto(spark.createDataFrame([*pts, (9999, None, 0.0)], "i int, a double, b double"), "a", "b")
    assert {r.i for r in got.collect()} == want


def test_cma_finds_the_minimum():
    opt = search.CmaEs(4, seed=1)
    best = 9.0
    for _ in range(120):
        x = opt.ask()
        j = ((x - 0.3) ** 2).sum(axis=1)
        opt.tell(x, [(True, float(v), 0.0) for v in j])
        best = min(best, float(j.min()))
    assert best < 1e-6
    assert search.primitive_polynomials(6) == [3, 7, 11, 13, 19, 25]


def test_batch_runs_each_key_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def evaluate(points):
        def count(batches):
            for b in batches:
                ran.add(b.num_rows)
                yield b

        counted = points.mapInArrow(count, points.schema)
        return counted.select("cand", F.lit(True).alias("feasible"), F.col("u")[0].alias("j"), F.lit(0.0).alias("violation"))

    got = search.evaluate_batch(spark, np.array([[0.1], [0.2], [0.1]]), 1, evaluate, None).collect()
    assert ran.value == 2 and sorted((r.slot, r.j) for r in got) == [(0, 0.1), (1, 0.2), (2, 0.1)]


def _results(x):
    return [(True, float(v), 0.0) for v in ((x - 0.3) ** 2 * 10.0 ** np.linspace(0, 2, x.shape[1])).sum(axis=1)]


def test_a_model_of_the_archive_saves_runs():
    """An ellipsoid of eight dimensions, with and without the model in the loop."""

    def runs_until(modelled, goal=1e-6):
        opt, ran, share = search.CmaEs(8, seed=2), 0, 1.0
        x_all, j_all = np.zeros((0, 8)), np.zeros(0)
        while ran < 6000:
            x = opt.propose(0)
            recent = slice(max(0, len(x_all) - 150), None)
            model = surrogate.chosen(surrogate.sums_of(np.arange(len(x_all[recent])) % surrogate.FOLDS, x_all[recent], j_all[recent]), 8) if modelled and len(x_all) > 9 else None
            guess = model(x) if model else None
            pick = np.sort(np.argsort(guess, kind="stable")[: max(2, int(np.ceil(share * len(x))))]) if model else np.arange(len(x))
            got = _results(x[pick])
            ran += len(pick)
            told = {int(i): r for i, r in zip(pick, got, strict=True)}
            if model:
                share = surrogate.steered(share, surrogate.tau_of(guess[pick], np.array([r[1] for r in got])))
            opt.tell(x, [told.get(i, (True, float(guess[i]) if model else 0.0, 0.0)) for i in range(len(x))])
            x_all, j_all = np.concatenate([x_all, x[pick]]), np.concatenate([j_all, [r[1] for r in got]])
            if j_all.min() < goal:
                return ran
        return ran

    plain, modelled = runs_until(False), runs_until(True)
    assert modelled < 0.7 * plain < 6000


def test_model_sums_in_spark_are_the_array_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 3))
    j = 1 + x @ [1.0, -2.0, 0.5] + 3 * x[:, 0] * x[:, 1]
    rows = spark.createDataFrame([(str(i), [float(v) for v in p], float(v)) for i, (p, v) in enumerate(zip(x, j, strict=True))], "key string, u array<double>, j double")
    sums = surrogate.normal_sums(rows, 3)
    fold = [r[0] for r in rows.select(F.pmod(F.xxhash64("key"), F.lit(surrogate.FOLDS)).cast("int")).collect()]
    assert np.allclose(sums, surrogate.sums_of(np.array(fold), x, j))
    model = surrogate.chosen(sums, 3)
    assert model.size == surrogate.feature_number(3) and np.allclose(model(x), j, atol=1e-6)
    assert surrogate.chosen(surrogate.sums_of(np.arange(4) % 5, x[:4], j[:4]), 3) is None


def test_a_killed_search_goes_on_with_the_same_trace(spark, tmp_path):
    """The second search stops in its third generation, and another one goes on in its folder; a free space has its share, rules reject without runs."""
    ran = spark.sparkContext.accumulator(0)

    def evaluate(dead_at=None):
        calls = []

        def at(level, incumbent):
            def run(points):
                calls.append(1)
                if dead_at is not None and len(calls) > dead_at:
                    raise KeyboardInterrupt

                def count(batches):
                    for b in batches:
                        ran.add(b.num_rows)
                        yield b

                square = F.aggregate("u", F.lit(0.0), lambda a, x: a + (x - 0.3) * (x - 0.3))
                return stored(points.mapInArrow(count, points.schema), "ran").select("cand", F.lit(True).alias("feasible"), (square + 0.01 * level).alias("j"), F.lit(0.0).alias("violation"), F.lit(10).cast("bigint").alias("cell_updates"))

            return run

        return at

    static = lambda level: lambda points: points.filter(F.col("u")[0] > 0.7)
    go = lambda folder, dead=None, **more: search.searched(spark, search.cma_levels(2, 5, 4), search.Space(2, evaluate(dead), static=static), [2, 1], [0.5, 0.5], 16, str(folder), **more)
    whole = sorted(map(tuple, go(tmp_path / "a").collect()))
    used = ran.value
    with pytest.raises(KeyboardInterrupt):
        go(tmp_path / "b", 2)
    again = go(tmp_path / "b")
    assert sorted(map(tuple, again.collect())) == whole and ran.value == 2 * used
    rows = again.orderBy("eval_index").collect()
    assert [r.eval_index for r in rows] == list(range(len(rows))) and {r.level for r in rows} == {1, 2} and all(r.u[0] <= 0.7 for r in rows)
    assert sum(not r.cached for r in rows) >= 16
    bounded = go(tmp_path / "c", most_updates=50).collect()
    assert sum(r.cell_updates for r in bounded if not r.cached) < 90
    mixed = go(tmp_path / "d", most_updates=100, free=(search.Space(3, evaluate()), 0.25)).collect()
    assert {len(r.u) for r in mixed if r.space == "free"} == {3} and sum(r.space == "free" for r in mixed) > 1


def test_a_search_over_real_runs(spark, tmp_path):
    """24 evaluations of a berm on 40 x 32 cells, coarse ones first; the best one's figures are those of a run of its own."""
    z = np.fromfunction(lambda i, j: 3 - 0.05 * j + 0.01 * np.abs(i - 16), (32, 40))
    cells = _table(spark, flow.Grid(z, 0.03), np.zeros((32, 40))).drop("cand")
    problem = evaluation.Problem(
        cells=cells, editable=cells.filter("c between 10 and 30").select("cell", "r", "c"), assets=spark.createDataFrame([(1, 0.0, 1.0)], "asset int, threshold double, weight double"),
        asset_cells=spark.createDataFrame([(1, 16 * 40 + 31), (1, 15 * 40 + 31)], "asset int, cell bigint"), guard=spark.createDataFrame([(0,)], "cell bigint"),
        params=flow.Params(30.0, 30.0, dt_max=2.0, hold=16, rain=((0.0, 1e-4), (30, 1e-4)), sides=(Segment("east", "open"),)), nx=40, d=1.0, tile=32, tolerance=1.0, max_volume=60.0,
    )
    specs = [("berm", ("x", 10.0, 30.0), ("y", 10.0, 22.0), ("length", 4.0, 16.0), ("width", 2.0, 5.0), ("angle", 0.0, 180.0), ("height", 0.1, 1.0))]
    trace = plans.search_problem(spark, None, problem, specs, str(tmp_path / "s"), budget=24, size=12).collect()
    assert sum(not r.cached and r.status != "static_infeasible" for r in trace) >= 24 and {r.level for r in trace} == {1, 2}
    best = min((r for r in trace if r.level == 1 and r.feasible), key=lambda r: r.j)
    bounds = spark.createDataFrame([(0, "berm", k, *x) for k, x in enumerate(specs[0][1:])], "slot int, kind string, k int, name string, lo double, hi double")
    alone = evaluation.evaluated(design.decode(spark.createDataFrame([(7, k, u) for k, u in enumerate(best.u)], "cand bigint, k int, u double"), bounds), evaluation.without_changes(problem)).first()
    assert alone.j == best.j and alone.status == "ok" and len({r.j for r in trace if r.level == 1}) > 3


def test_trace_survives_a_torn_line(spark, tmp_path):
    p = str(tmp_path / "trace")
    exchange.append_trace(spark.createDataFrame([(1, 0.5)], "eval_index int, j double"), p)
    (tmp_path / "trace" / "part-torn.json").write_text('{"eval_index": 2, "j": 0.25}\n{"eval_index": 3, "j"')
    assert sorted(r.eval_index for r in exchange.read_trace(spark, p, "eval_index int, j double").collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + datetime.timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i)) for i in range(200)], "ts timestamp, series string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    q = sync.run_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    done, every = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())), set(map(tuple, sync.sync_totals(rows, "1 hour").collect()))
    assert done and done <= every and len(every - done) <= 4


def _table(spark, grid, h, cand=0, **more):
    ny, nx = grid.z.shape
    n = np.broadcast_to(grid.n, grid.z.shape)
    rows = [(cand, i * nx + j, i, j, float(grid.z[i, j]), float(n[i, j]), bool(grid.wall[i, j]), float(h[i, j]), 0.0, 0.0) for i in range(ny) for j in range(nx)]
    return spark.createDataFrame(rows, "cand bigint, cell bigint, r int, c int, z double, n double, wall boolean, h double, qx double, qy double")


@pytest.mark.parametrize("scheme", ["hll", "inertial"])
def test_runs_as_tables_are_the_array_runs(spark, scheme):
    """Peaks, times and ledger of a storm over a small basin, in both forms."""
    rng = np.random.default_rng(4)
    grid = flow.Grid(rng.random((5, 6)) * 0.2, 0.03, dx=2.0, dy=3.0)
    p = flow.Params(4.0, 2.0, rain=((0.0, 0.002), (3.0, 0.0)), infiltration=1e-4 if scheme == "hll" else 0.0, scheme=scheme, dt_max=1.0)
    h = rng.random((5, 6)) * 0.1
    run = flow.Run(grid, p, h)
    for _ in run.syncs():
        pass
    done, outcome = flow.run_batch(_table(spark, grid, h), p, 2.0, 3.0)
    ledger = outcome.ledger.orderBy("number").collect()
    rows = sorted(done.collect(), key=lambda r: r.cell)
    assert np.allclose([r.h for r in rows], run.h.ravel(), atol=1e-9) and np.allclose([r.peak for r in rows], run.peak.ravel(), atol=1e-9)
    assert [x["t"] for x in ledger] == [x[0] for x in run.ledger] and ledger[-1]["steps"] == run.steps
    last = ledger[-1]
    assert last["volume"] == pytest.approx(h.sum() + last["rain"] - last["seeped"] + last["fix"], rel=1e-9)


def _problem(spark, hold=1, **more):
    z = np.fromfunction(lambda i, j: 0.1 * i + 0.02 * j, (8, 10))
    cells = _table(spark, flow.Grid(z, 0.03), np.zeros((8, 10))).drop("cand")
    assets = spark.createDataFrame([(1, 0.002, 2.0)], "asset int, threshold double, weight double")
    given = dict(
        cells=cells, editable=cells.select("cell", "r", "c"), assets=assets, asset_cells=spark.createDataFrame([(1, 4), (1, 5)], "asset int, cell bigint"), guard=spark.createDataFrame([(0,), (9,)], "cell bigint"),
        params=flow.Params(4.0, 2.0, rain=((0.0, 0.001),), hold=hold), nx=10, d=1.0, max_volume=30.0, cost_weight=0.01, tolerance=0.5,
    )
    return evaluation.Problem(**(given | more)), z


PRIMITIVES = "cand bigint, slot int, kind string, x double, y double, length double, width double, angle double, height double"


def test_evaluation_from_primitives_to_outcomes(spark):
    """A berm's outcome against a run in arrays; one too large is rejected without a run; a guard or an incumbent stops runs."""
    problem, z = _problem(spark)
    made = spark.createDataFrame([(1, 0, "berm", 5.0, 3.0, 4.0, 2.0, 0.0, 0.3), (2, 0, "berm", 5.0, 4.0, 9.0, 9.0, 0.0, 1.0)], PRIMITIVES)
    known = evaluation.without_changes(problem)
    got = {r.cand: r for r in evaluation.evaluated(made, known).collect()}
    assert got[2].status == "static_infeasible" and got[2].j == 1e300 and got[2].violation > 1e6 and not got[2].feasible
    dz = np.zeros(80)
    for r in design.materialize(made.filter("cand = 1"), problem.editable, 1.0, 1.0).collect():
        dz[r.cell] = r.dz
    run = flow.Run(flow.Grid(z, 0.03), problem.params, np.zeros((8, 10)), dz.reshape(8, 10))
    for _ in run.syncs():
        pass
    x = (max(run.peak.ravel()[[4, 5]]) - 0.002) / 0.05
    assert got[1].status == "ok" and got[1].feasible and got[1].j == pytest.approx(2 * 0.05 * np.log1p(np.exp(x)) + 0.01 * np.maximum(dz, 0).sum(), rel=1e-6)
    stopped = {r.cand: r for r in evaluation.evaluated(made, known, incumbent=0.0).collect()}
    assert stopped[1].status == "incumbent_abort" and 0 < stopped[1].j <= got[1].j
    # peaks so far are held against those of the whole run without changes, which a guarded cell reaches at the end
    strict = evaluation.evaluated(made, evaluation.replace(known, tolerance=-1e-6)).collect()
    assert {r.cand: (r.status, r.breach_sync) for r in strict} == {1: ("guard_abort", 2), 2: ("static_infeasible", None)}


def test_ensembles_run_only_what_is_feasible(spark):
    """A second storm makes one design break its guard; the third is run by the other alone. Robust figures follow from the members' own outcomes."""
    problem, _ = _problem(spark, hold=8)
    problem = evaluation.replace(problem, params=evaluation.replace(problem.params, sync=4.0))
    made = spark.createDataFrame([(1, 0, "berm", 5.0, 3.0, 4.0, 2.0, 0.0, 0.3), (2, 0, "berm", 5.0, 4.0, 9.0, 9.0, 0.0, 1.0), (3, 0, "swale", 3.0, 5.0, 3.0, 2.0, 0.0, -0.1)], PRIMITIVES)
    members = [evaluation.without_changes(problem), evaluation.without_changes(evaluation.scaled(problem, rain=0.5))]
    got = {r.cand: r for r in evaluation.ensemble_evaluated(made, members, 0.5, 0.5).collect()}
    other = {r.cand: r for r in evaluation.evaluated(made, members[1]).collect()}
    assert (got[2].members_run, got[2].status, got[2].feasible) == (1, "static_infeasible", False)
    for cand in (1, 3):
        assert got[cand].members_run == 2 and got[cand].feasible and got[cand].violation == 0 and other[cand].j < got[cand].j
    broken = [members[1], evaluation.replace(members[0], tolerance=-1.0), members[0]]
    stop = {r.cand: r for r in evaluation.ensemble_evaluated(made, broken, 0.5, 0.5).collect()}
    assert (stop[1].members_run, stop[1].status, stop[1].feasible) == (2, "guard_abort", False) and stop[1].violation > 0
    rows = spark.createDataFrame([(1, 0, 3.0), (1, 1, 1.0)], "cand int, member int, j double")
    assert design.robust(rows, 0.5, 0.5).first().j == 3.5  # the mean, and half of the mean of the worse half


def test_levels_and_finer_grids(spark):
    problem, z = _problem(spark, hold=8)
    coarse = evaluation.coarsened(problem, 2)
    rows = {r.cell: r for r in coarse.cells.collect()}
    assert len(rows) == 20 and coarse.nx == 5 and coarse.d == 2 and all(rows[i * 5 + j].z == pytest.approx(z[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean()) for i in range(4) for j in range(5))
    assert {r.cell for r in coarse.asset_cells.collect()} == {2} and {r.cell for r in coarse.guard.collect()} == {0, 4} and coarse.editable.count() == 20
    fine = evaluation.finer(problem)
    assert fine.cells.count() == 320 and fine.d == 0.5 and {r.cell for r in fine.guard.collect()} == {0, 1, 20, 21, 18, 19, 38, 39}
    got = evaluation.prepared(fine)
    assert (got.ny, got.nx) == (16, 20)
    rows = evaluation.revalidated(spark.createDataFrame([(1, 0, "berm", 5.0, 3.0, 4.0, 2.0, 0.0, 0.3)], PRIMITIVES), {"finer": fine}).collect()
    assert {r.case for r in rows} == {"finer"} and all(r.j_before > 0 and r.status == "ok" for r in rows)


def test_ways_upstream_against_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    nx, ny, targets = 9, 8, {"a": {40, 41}, "b": {13}}
    q = rng.normal(0, 1, (ny * nx, 2))
    rows = [(k, k // nx, k % nx, float(q[k, 0]), float(q[k, 1])) for k in range(nx * ny)]
    field = spark.createDataFrame(rows, "cell bigint, r bigint, c bigint, qx double, qy double")
    wanted = spark.createDataFrame([(n, k) for n, m in targets.items() for k in m], "target string, cell bigint")
    near = lambda k: [(k // nx + i) * nx + k % nx + j for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= k // nx + i < ny and 0 <= k % nx + j < nx]

    def sends(a, b):
        i, j = b // nx - a // nx, b % nx - a % nx
        return (q[a, 0] * j + q[a, 1] * i) / np.hypot(i, j)

    inside = set().union(*targets.values())
    first = {(n, k): max(sends(k, t) for t in near(k) if t in m) for n, m in targets.items() for k in range(nx * ny) if k not in m and any(t in m for t in near(k))}
    first = {k: v for k, v in first.items() if v > 0}
    found = corridors.starts(field, wanted, nx, ny)
    assert {(r.target, r.start): pytest.approx(r.inflow) for r in found.collect()} == first
    ways = {}
    for _, k in first:
        way, least = [k], 0.05 * max(v for (_, s), v in first.items() if s == k)
        while True:
            open_ = [(-sends(n, way[-1]), n) for n in near(way[-1]) if n not in way and n not in inside and sends(n, way[-1]) > least]
            if not open_:
                break
            way.append(min(open_)[1])
        ways[k] = way
    traced = corridors.traces(found, field, wanted, nx, ny)
    got = {}
    for r in sorted(traced.collect(), key=lambda r: r.i):
        got.setdefault(r.start, []).append(r.cell)
    assert got == ways
    editable, used, want = {k for k in range(nx * ny) if k % 7}, set(), []
    for (name, k), _ in sorted(first.items(), key=lambda x: (-x[1], x[0][1])):
        if k in used or len(want) == 2:
            continue
        used |= {n for c in ways[k] for n in [c, *near(c)]}
        best, run = [], []
        for c in ways[k]:
            run = [*run, c] if c in editable else []
            best = run if len(run) > len(best) else best
        if len(best) >= 3:
            want.append((name, best[::-1]))
    rows = sorted(corridors.chosen(found, traced, field.filter("cell % 7 != 0"), nx, ny, 2).collect(), key=lambda r: (r["rank"], r.i))
    assert [(n, [r.cell for r in rows if r["rank"] == k]) for k, (n, _) in enumerate(want)] == want and {r["rank"] for r in rows} == set(range(len(want)))


def test_means_along_corridors():
    specs = [{"kind": "mound"}, {"kind": "berm"}, {"kind": "berm"}]
    assert corridors.heuristic_mean(specs, 0.5) == [0.5, 0.5, 0.0, 0.5, 0.5, 0.6, 0.8, 0.5, 0.5, 0.6, 0.0]
    assert [m[0] for m in corridors.restart_means(specs)] == [0.25, 0.75, 0.4, 0.6]


def test_compass_finds_the_minimum():
    c = search.Compass(3, seed=1)
    for _ in range(60):
        x = c.ask()
        c.tell(x, [(bool(p[0] >= 0.2), float(((p - 0.3) ** 2).sum()), float(max(0.2 - p[0], 0))) for p in x])
    assert c.best[1] < 1e-4 and np.allclose(c.at, 0.3, atol=0.02)
