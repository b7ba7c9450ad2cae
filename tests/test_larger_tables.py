"""What only larger tables had shown, on small ones."""

import random
import re

from pyspark.sql import functions as F

from rillwork.operators import corridors as C
from rillwork.operators import design as G
from rillwork.operators import raster as R
from rillwork.operators import sides
from rillwork.operators import tiles as T
from rillwork.plans import registry
from rillwork.sources import domain as D


def parts(spark, folder, sizes, price=1000.0):
    """A table of parts, a cell each, of given sizes."""
    rows = [(k, s, price) for k, s in enumerate(sizes)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_roughness_is_the_nearest_double(spark, tmp_path):
    """As SQL's decimals give it; 0.001 times a size is beside it for some sizes."""
    folder = parts(spark, tmp_path, range(1, 51))
    assert [r.n for r in D.cells(spark, folder).orderBy("cell").collect()] == [k / 1000 for k in range(1, 51)]
    assert any(k * 0.001 != k / 1000 for k in range(1, 51))


def cancelling(spark, folder):
    """A discharge (cell, r, c, qx, qy) of each size whose parts cancel north-eastwards."""
    n = D.cells(spark, parts(spark, folder, range(1, 51))).select("cell", "c", ((F.col("n") - 0.025) * 4000).alias("qy"))
    exact = F.udf(lambda c: ((c + 1) / 1000 - 0.025) * 4000, "double")
    return n.select((F.col("c") + 50).alias("cell"), F.lit(1).cast("bigint").alias("r"), "c", exact("c").alias("qx"), "qy")


def test_discharges_that_cancel_start_no_corridor(spark, tmp_path):
    flow = cancelling(spark, tmp_path)
    north_east = C.inflows(flow, 50, 3).filter("cell = source - 49")
    assert north_east.count() == 49 and north_east.filter("inflow != 0").isEmpty()


def test_an_amount_between_two_figures_goes_up(spark):
    """226.9761875 m3 of a berm, by sums that come out on either side of it."""
    sums = spark.createDataFrame([(226.97618749999998,), (226.9761875,), (226.97618750000004,)], "total double")
    assert {r[0] for r in sums.select(G.half_up(F.col("total") - 150, 6)).collect()} == {76.976188}
    assert {r[0] for r in sums.select(F.round(F.col("total") - 150, 6)).collect()} != {76.976188}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rings_meet_cells_by_row_and_column(spark):
    """Rows are few where all polygons lie side by side, so a row isn't a key."""
    cells = spark.range(50).selectExpr("id AS cell", "id div 10 AS r", "id % 10 AS c")
    ring = "array(struct({0}D AS x, -{1}D AS y), struct({2}D AS x, -{1}D AS y), struct({2}D AS x, -{3}D AS y), struct({0}D AS x, -{3}D AS y)) AS points"
    rings = spark.range(1).selectExpr("id AS poly", "0 AS ring", ring.format(-3.0, 0.25, 6.25, 4.25)).union(spark.range(1).selectExpr("id AS poly", "1 AS ring", ring.format(2.25, 1.25, 4.25, 3.25)))
    found = R.rasterize(cells, R.edges_of(rings), 0.0, 0.0, 1.0)
    assert {r.cell for r in found.collect()} == {r * 10 + c for r in range(4) for c in range(6) if not (1 <= r <= 2 and 2 <= c <= 3)}
    assert re.search(r"Join Inner, \(\(.*\br#.* AND .*\bc#", plan(found))


def test_lower_bound_picks_its_cells_before_it_aggregates(spark):
    text = plan(registry.queries()["c11_lower_bound"](spark, "/root/testdata/sf0.001"))
    assert text.rindex("max(l_quantity") < text.rindex("Join LeftSemi")


def test_ways_are_the_same_whatever_the_blocks_are(spark):
    """Along a row and back along the next one, over the borders of blocks of any size."""
    rows = [(r * 12 + c, r, c, *((-1.0, 0.0) if r == 0 and c else (0.0, -1.0) if r == 0 else (1.0, 0.1))) for r in range(6) for c in range(12)]
    flow = spark.createDataFrame(rows, "cell bigint, r bigint, c bigint, qx double, qy double")
    targets = spark.createDataFrame([("a", 0), ("a", 35)], "target string, cell bigint")
    found = C.starts(flow, targets, 12, 6)
    ways = {side: sorted(map(tuple, C.traces(found, flow, targets, 12, 6, side=side).collect())) for side in (2, 5, 64)}
    assert ways[2] == ways[5] == ways[64] and max(w[1] for w in ways[2]) >= 5


def test_static_checks_send_no_change_to_all_its_neighbours(spark):
    """Slopes and pits of scattered changes are those of whole grids, and only cells that lie below both neighbours of their row meet the other six."""
    dice, nx, ny = random.Random(3), 7, 9
    z = {k: dice.choice((0.0, 0.01, 0.1, 0.4)) for k in range(nx * ny) if k != 31}
    made = {(cand, k): dice.choice((-1.0, -0.5, -0.3, 0.2)) for cand, n in enumerate((1, 2, 5, 20, 30, 45)) for k in dice.sample(range(nx * ny), n)}
    cells = spark.createDataFrame([(k, k // nx, k % nx, v) for k, v in z.items()], "cell bigint, r bigint, c bigint, z double")
    edits = spark.createDataFrame([(*k, v) for k, v in made.items()], "cand bigint, cell bigint, dz double")
    slopes, pits = {}, set()
    for cand in range(6):
        rows, cols = zip(*(divmod(k, nx) for c, k in made if c == cand), strict=True)
        dz = lambda r, c, cand=cand: made.get((cand, r * nx + c), 0.0)
        inside = [(r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1)]
        steep = [abs(dz(r, c) - dz(r + i, c + j)) / (3.0 if i else 2.0) for r, c in inside for i, j in ((0, 1), (1, 0)) if (r + i, c + j) in inside]
        slopes |= {cand: max(steep)} if steep else {}
        for r, c in inside:
            around = [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
            if dz(r, c) < 0 and r * nx + c in z and all(0 <= j < nx and i * nx + j in z for i, j in around):
                own = z[r * nx + c]
                if all(own + dz(r, c) < z[i * nx + j] + dz(i, j) - 0.01 for i, j in around) and not all(own < z[i * nx + j] - 0.01 for i, j in around):
                    pits.add((cand, r * nx + c))
    steepest, new = G.steepest(edits, nx, 2.0, 3.0), G.new_pits(cells, edits, nx)
    assert dict(steepest.collect()) == slopes and pits and {(r.cand, r.cell) for r in new.collect()} == pits
    assert "Generate" not in plan(steepest)
    text = plan(new)
    assert "Window" in text[text.index("Generate"):]


def test_what_is_known_of_cells_comes_with_their_peaks(spark):
    """Assets of a cell meet it in its tile, so peaks of cells aren't dealt out."""
    domain = T.Domain(4, 4, 1.0, 1.0, 2)
    cells = spark.range(16).selectExpr("0L AS cand", "id div 4 AS r", "id % 4 AS c", "0D AS z", "0.03D AS n", "false AS wall", "id * 0.5D AS h", "0D AS qx", "0D AS qy")
    state = T.tiled(cells, domain).withColumn("peak", F.col("h"))
    of = spark.createDataFrame([(5, 0.25, [7, 8]), (6, 0.5, None), (15, 0.75, [9])], "cell bigint, base double, assets array<bigint>")
    assert sorted(map(tuple, T.monitored(state, of, domain).collect())) == [(0, 5, 2.5, 0.25, [7, 8]), (0, 6, 3.0, 0.5, None), (0, 15, 7.5, 0.75, [9])]


def test_side_cells_take_the_last_segment_of_blocks(spark):
    """Many stretches of a long side: of a block's segments only the last one goes on to its cells, and what holds is what the stretches give one after another."""
    dice, nx, ny = random.Random(5), 7, 203
    made = [(k, dice.choice(sides.SIDES), dice.choice(sides.KINDS), *((None, None) if k % 5 == 0 else (a := dice.uniform(-20, 600), a + dice.uniform(0, 400))), k * 0.5) for k in range(60)]
    for given in (made, made[31:32], []):
        of = sides.side_cells(spark.createDataFrame(given, "segment int, side string, kind string, start double, end double, level double"), nx, ny, 2.0, 3.0)
        want = {}
        for s in sides.SIDES:
            n, d = (nx, 2.0) if s in ("north", "south") else (ny, 3.0)
            want |= {(s, i): ("wall", None, None, None) for i in range(n)}
            for segment, side, kind, start, end, level in given:
                if side == s:
                    a, e = sides.Segment(side, kind, start, end).cells(nx, ny, d)
                    want |= {(s, i): (kind, segment, level if kind == "stage" else None, 1 / ((e - a) * d) if kind == "inflow" else None) for i in range(a, e)}
        assert {(r.side, r.pos): tuple(r)[2:] for r in of.collect()} == want
    text = plan(of)
    assert "Window" not in text and re.search(r"explode\(sequence\(cast\(shiftleft.*?Aggregate.*?explode\(filter", text, re.S)
