"""Flow corridors: where water enters targets, the ways it comes from, and designs placed along these ways.

Discharges (cell, r, c, qx, qy) point east and south. A walker goes to the neighbour that sends most water towards it, so all walkers
of a table go on together, each as far as its block of cells in a job, until none is left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.functions.shapes import quantized, sign_of
from rillwork.operators.design import STEPS
from rillwork.operators.raster import AROUND8
from rillwork.sources.stored import dropped, stored

# The share of a start's inflow that a way must keep, the steps it may have for each row and column of the grid, and the
# cells that a corridor has at least.
KEEP, STEPS_A_SIDE, LEAST_CELLS = 0.05, 4, 3


def inflows(flow: DataFrame, nx: int, ny: int) -> DataFrame:
    """(cell, source, inflow): what each of a cell's eight neighbours sends towards it, in the direction between their centres."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND8))
    length = F.sqrt(F.col("s.i") * F.col("s.i") + F.col("s.j") * F.col("s.j"))
    r, c = F.col("r") + F.col("s.i"), F.col("c") + F.col("s.j")
    into = flow.withColumn("s", F.explode(steps)).filter((r >= 0) & (r < ny) & (c >= 0) & (c < nx))
    return into.select((r * nx + c).alias("cell"), F.col("cell").alias("source"), ((F.col("qx") * F.col("s.j") + F.col("qy") * F.col("s.i")) / length).alias("inflow"))


def starts(flow: DataFrame, targets: DataFrame, nx: int, ny: int) -> DataFrame:
    """(target, start, inflow): cells outside of a target (target, cell) that send water into it, by what they send to one of its cells at most."""
    into = inflows(flow, nx, ny).filter("inflow > 0").join(targets, "cell").groupBy("target", F.col("source").alias("start")).agg(F.max("inflow").alias("inflow"))
    return into.join(targets.select("target", F.col("cell").alias("start")), ["target", "start"], "left_anti")


def traces(found: DataFrame, flow: DataFrame, targets: DataFrame, nx: int, ny: int, side: int = 64) -> DataFrame:
    """(start, i, cell) of each start's way upstream: to the neighbour outside of all targets and of the way so far that sends most (of
    equals the lower cell), while that is more than KEEP of the start's inflow. A job takes each walker as far as it stays in a block of side x side cells."""
    edges = inflows(flow, nx, ny).filter("inflow > 0").join(targets.select(F.col("cell").alias("source")).distinct(), "source", "left_anti")
    across, most = -(-nx // side), STEPS_A_SIDE * (nx + ny)
    block = lambda cell: (F.floor(cell / nx / side) * across + F.floor(cell % nx / side)).cast("bigint").alias("block")
    edges = stored(edges.select(block(F.col("cell")), F.col("cell").cast("bigint").alias("cell"), F.col("source").cast("bigint").alias("source"), "inflow"), "inflows")
    walk = found.groupBy("start").agg(F.max("inflow").alias("least")).select(block(F.col("start")), F.col("start").cast("bigint").alias("start"), (KEEP * F.col("least")).alias("least"), F.array(F.col("start").cast("bigint")).alias("way"), F.lit(True).alias("live"))
    walk, done = stored(walk, "walk"), None

    def walked(walkers: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by([("inflow", "descending"), ("source", "ascending")])
        sources: dict[int, list] = {}
        for cell, source, inflow in zip(near["cell"].to_pylist(), near["source"].to_pylist(), near["inflow"].to_pylist(), strict=True):
            sources.setdefault(cell, []).append((inflow, source))
        ways, live, blocks = walkers["way"].to_pylist(), [], []
        for own, least, way in zip(walkers["block"].to_pylist(), walkers["least"].to_pylist(), ways, strict=True):
            seen, on, at = set(way), True, own
            while on and at == own:
                best = next((s for q, s in sources.get(way[-1], ()) if q > least and s not in seen), None) if len(way) <= most else None
                if on := best is not None:
                    way.append(best)
                    seen.add(best)
                    at = best // nx // side * across + best % nx // side
            live.append(on)
            blocks.append(at)
        return pa.table({"block": pa.array(blocks, pa.int64()), "start": walkers["start"], "least": walkers["least"], "way": pa.array(ways, pa.list_(pa.int64())), "live": pa.array(live, pa.bool_())})

    while not walk.isEmpty():
        met = edges.join(F.broadcast(walk.select("block").distinct()), "block", "left_semi")
        now = stored(walk.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(walked, "block bigint, start bigint, least double, way array<bigint>, live boolean"), "walk")
        ended, walk = now.filter("NOT live").select("start", "way"), now.filter("live")
        done = ended if done is None else done.union(ended)
    done = walk.select("start", "way") if done is None else done
    return done.select("start", F.posexplode("way").alias("i", "cell"))


def chosen(found: DataFrame, ways: DataFrame, editable: DataFrame, nx: int, ny: int, most: int) -> DataFrame:
    """(rank, target, start, i, cell): at most `most` corridors, by falling inflow (of equals the lower start). A start that lies on or beside an
    earlier way is passed over; of each way the longest run of editable cells stays (of equals the first), if it has LEAST_CELLS, from upstream on."""
    from rillwork.operators.ranking import longest_run

    left = stored(found.select("target", "start", "inflow"), "starts")
    marked = ways.join(editable.select("cell", F.lit(True).alias("_e")), "cell", "left").select("start", "i", "cell", F.coalesce("_e", F.lit(False)).alias("good"))
    clipped = longest_run(marked.withColumnRenamed("start", "way"), "way", "i", "good", LEAST_CELLS)
    near = ways.select("start", "cell", (F.expr(f"cell div {nx}")).alias("r"), (F.col("cell") % nx).alias("c"))
    out, rank = None, 0
    while rank < most:
        first = left.orderBy(F.desc("inflow"), "start").limit(1).collect()
        if not first:
            break
        way = near.filter(F.col("start") == first[0].start)
        beside = way.select(F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in [*AROUND8, (0, 0)]))).alias("p")).filter(f"p.r BETWEEN 0 AND {ny - 1} AND p.c BETWEEN 0 AND {nx - 1}")
        used = beside.select((F.col("p.r") * nx + F.col("p.c")).alias("start")).distinct()
        before, left = left, stored(left.join(F.broadcast(used), "start", "left_anti"), "starts")
        dropped(before)
        own = clipped.filter(F.col("way") == first[0].start)
        kept = stored(ways.filter(F.col("start") == first[0].start).crossJoin(F.broadcast(own.select(F.col("start").alias("a"), F.col("stop").alias("z")))).filter("i BETWEEN a AND z").select(
            F.lit(rank).alias("rank"), F.lit(first[0].target).alias("target"), "start", (F.col("z") - F.col("i")).alias("i"), "cell"
        ), "corridor")
        if not kept.isEmpty():
            out, rank = kept if out is None else out.union(kept), rank + 1
    return out if out is not None else ways.sparkSession.createDataFrame([], "rank int, target string, start bigint, i int, cell bigint")


def segments(points: DataFrame) -> DataFrame:
    """(corridor, i, x, y, dx, dy, s0, s1, length): the pieces of polylines (corridor, i, x, y), with the arc length at their ends."""
    w = Window.partitionBy("corridor").orderBy("i")
    piece = points.select("*", (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy")).filter("dx IS NOT NULL")
    long = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    whole = piece.select("*", long.alias("_d")).select("*", F.sum("_d").over(w).alias("s1"), F.sum("_d").over(Window.partitionBy("corridor")).alias("length"))
    return whole.withColumn("s0", F.col("s1") - F.col("_d")).drop("_d")


def placed_at(wanted: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds px, py, tx, ty to wanted (corridor, s, ...): the point at a fraction s of the corridor's length, and the unit tangent there. A point
    between two pieces belongs to the later one, the end to the last. Corridors are few, so their pieces are broadcast."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))) * F.col("length")
    last = pieces.groupBy("corridor").agg(F.max("i").alias("_last"))
    met = wanted.join(F.broadcast(pieces.join(last, "corridor")), "corridor").filter(((at >= F.col("s0")) | (F.col("s0") == 0)) & ((at < F.col("s1")) | (F.col("i") == F.col("_last"))))
    part = F.when(F.col("s1") > F.col("s0"), (at - F.col("s0")) / (F.col("s1") - F.col("s0"))).otherwise(0.0)
    one = F.greatest(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(1e-12))
    return met.select(*wanted.columns, (F.col("x") + part * F.col("dx")).alias("px"), (F.col("y") + part * F.col("dy")).alias("py"), (F.col("dx") / one).alias("tx"), (F.col("dy") / one).alias("ty"))


def coordinates(specs: list[dict]) -> list[tuple[int, str]]:
    """Slot and name of each coordinate of a design along corridors: place, offset and height, and a length for all but mounds."""
    return [(k, n) for k, s in enumerate(specs) for n in (("s", "offset", "height") if s["kind"] == "mound" else ("s", "offset", "length", "height"))]


def decode(theta: DataFrame, specs: list[dict], pieces: DataFrame) -> DataFrame:
    """One row per candidate and primitive: (cand, slot, kind, x, y, length, width, angle, height). theta: (cand, k, u); a spec has kind and
    bounds (two values each) of length, width, height. Primitive k lies on corridor k modulo their number; across the flow if a berm."""
    n = max(pieces.select("corridor").distinct().count(), 1)
    spark = theta.sparkSession
    names = spark.createDataFrame([(i, slot, name) for i, (slot, name) in enumerate(coordinates(specs))], "k int, slot int, name string")
    rows = [(i, s["kind"], *map(float, (*s.get("length", (0, 0)), *s["width"], *s["height"]))) for i, s in enumerate(specs)]
    table = spark.createDataFrame(rows, "slot int, kind string, l0 double, l1 double, w0 double, w1 double, h0 double, h1 double")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u")))
    one = theta.join(F.broadcast(names), "k").groupBy("cand", "slot").agg(*(F.max(F.when(F.col("name") == x, u)).alias(x) for x in ("s", "offset", "length", "height"))).withColumnRenamed("length", "_l").withColumnRenamed("height", "_h")
    at = placed_at(one.join(F.broadcast(table), "slot").withColumn("corridor", (F.col("slot") % n).cast("bigint")), pieces)
    between = lambda a, b, x: F.col(a) + (F.col(b) - F.col(a)) * F.col(x)
    off = (F.col("offset") * 2 - 1) * 1.5 * F.col("w1")
    linear = F.col("kind") != "mound"
    along = F.degrees(F.atan2("ty", "tx")) + F.when(F.col("kind") == "berm", 90.0).otherwise(0.0)
    return at.select(
        "cand", "slot", "kind", quantized(F.col("px") - F.col("ty") * off, STEPS["x"]).alias("x"), quantized(F.col("py") + F.col("tx") * off, STEPS["y"]).alias("y"),
        F.when(linear, quantized(between("l0", "l1", "_l"), STEPS["length"])).otherwise(0.0).alias("length"), F.greatest(quantized((F.col("w0") + F.col("w1")) / 2, STEPS["width"]), F.lit(1e-6)).alias("width"),
        F.when(linear, quantized(F.pmod(along, F.lit(180.0)), STEPS["angle"])).otherwise(0.0).alias("angle"), (sign_of(F.col("kind")) * quantized(between("h0", "h1", "_h"), STEPS["height"])).alias("height"),
    )


# Places along the first corridor for the means of restarts.
RESTARTS = (0.25, 0.75, 0.4, 0.6)


def heuristic_mean(specs: list[dict], place: float) -> list[float]:
    """A mean for a search: the first berm at a place along its corridor at 0.8 of its height, everything else flat."""
    first = next((k for k, s in enumerate(specs) if s["kind"] == "berm"), None)
    value = {"s": place, "offset": 0.5, "length": 0.6}
    return [value.get(name, 0.8 if slot == first else 0.0) for slot, name in coordinates(specs)]


def restart_means(specs: list[dict]) -> list[list[float]]:
    return [heuristic_mean(specs, place) for place in RESTARTS]
