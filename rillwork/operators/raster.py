"""Rasters as tables (cell, r, c, z, ...): polygons to masks, neighbours, blocks, faces, edits, differences.

Cells are numbered row by row from the north-west corner, cell = r * nx + c. Joins go by cell, or by tile where a range decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.sources.stored import shuffled

AROUND4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
AROUND8 = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def centre(r: Column, c: Column, x0: float, y0: float, d: float) -> tuple[Column, Column]:
    """World coordinates of a cell's centre; (x0, y0) is the north-west corner."""
    return x0 + (c + 0.5) * d, y0 - (r + 0.5) * d


def edges_of(polygons: DataFrame) -> DataFrame:
    """From (poly, ring, points: array of structs x, y): one row per edge (poly, ring, x0, y0, x1, y1); rings close themselves."""
    n = F.size("points")
    return polygons.filter(n >= 3).select("poly", "ring", F.posexplode("points").alias("i", "a"), "points").select(
        "poly", "ring", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.expr("points[(i + 1) % size(points)].x").alias("x1"), F.expr("points[(i + 1) % size(points)].y").alias("y1")
    )


def rasterize(cells: DataFrame, edges: DataFrame, x0: float, y0: float, d: float) -> DataFrame:
    """(poly, cell) of all cells whose centre lies in a polygon: inside its ring 0 and in no other ring, by the even-odd rule.

    A ring's crossings of a raster row come together first: a cell counts those east of it. So cells are met by row and column, not by rows that all
    polygons share.
    """
    row_of = lambda y: F.floor((y0 - y) / d - 0.5)
    column_of = lambda x: F.floor((x - x0) / d - 0.5)
    spans = edges.withColumn("r", F.explode(F.sequence(row_of(F.greatest("y0", "y1")).cast("int"), row_of(F.least("y0", "y1")).cast("int") + 1)))
    x, y = centre(F.col("r"), F.col("c"), x0, y0, d)
    crosses = (F.col("y0") > y) != (F.col("y1") > y)
    at = (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / F.when(F.col("y1") != F.col("y0"), F.col("y1") - F.col("y0")).otherwise(1.0) + F.col("x0")
    rings = spans.filter(crosses).groupBy("poly", "ring", "r").agg(F.collect_list(at).alias("at"))
    rings = rings.withColumns({"low": F.greatest(column_of(F.array_min("at")), F.lit(0)), "high": column_of(F.array_max("at")) + 1}).filter("low <= high")
    odd = F.size(F.filter("at", lambda a: x < a)) % 2 == 1
    inside = rings.withColumn("c", F.explode(F.sequence("low", "high"))).filter(odd).select("poly", "ring", "r", "c")
    inside = inside.join(cells.select("cell", F.col("r").cast("int").alias("r"), F.col("c").cast("bigint").alias("c")), ["r", "c"])
    return inside.groupBy("poly", "cell").agg(F.min("ring").alias("low"), F.count("*").alias("n")).filter("low = 0 AND n = 1").select("poly", "cell")


def neighbours(cells: DataFrame, nx: int, ny: Column | int, around: list[tuple[int, int]] = AROUND4) -> DataFrame:
    """(cell, at) of each cell (with r, c) and its neighbours on the grid."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around))
    r, c = F.col("r") + F.col("s.i"), F.col("c") + F.col("s.j")
    return cells.withColumn("s", F.explode(steps)).filter((r >= 0) & (r < ny) & (c >= 0) & (c < nx)).select("cell", (r * nx + c).alias("at"))


def outer_ring(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells outside a mask (cell, r, c) with a side in common with it."""
    return neighbours(mask, nx, ny).select(F.col("at").alias("cell")).distinct().join(mask, "cell", "left_anti")


def coarse_cell(r: Column, c: Column, nx: int, level: int) -> Column:
    return F.floor(r / level) * (-(-nx // level)) + F.floor(c / level)


def rebased(cells: DataFrame) -> DataFrame:
    """Heights over the floor of the lowest flow cell; walls and cells without a height stand 100 above the highest."""
    z = F.when(~F.col("wall"), F.col("z"))
    found = cells.agg(F.floor(F.min(z)).cast("double").alias("z_ref"), F.max(z).alias("z_max"))
    both = cells.crossJoin(F.broadcast(found))
    wall = F.col("wall") | F.col("z").isNull()
    return both.select("cell", "r", "c", F.when(wall, F.col("z_max") - F.col("z_ref") + 100).otherwise(F.col("z") - F.col("z_ref")).alias("z"), wall.alias("wall"), "n")


def block_mean(cells: DataFrame, level: int) -> DataFrame:
    """Means over level x level blocks of flow cells; a block of walls alone is a wall with the mean of all its n."""
    flow = ~F.col("wall")
    return cells.groupBy(F.floor(F.col("r") / level).alias("r"), F.floor(F.col("c") / level).alias("c")).agg(
        F.avg(F.when(flow, F.col("z"))).alias("z"), F.coalesce(F.avg(F.when(flow, F.col("n"))), F.avg("n")).alias("n"), F.bool_and("wall").alias("wall"), F.count("*").alias("n_cells")
    )


def face_rises(cells: DataFrame) -> DataFrame:
    """Bed rise from each cell to its east and south neighbour; 0 at the border."""
    east, south = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    return cells.select("cell", F.coalesce(F.lead("z").over(east) - F.col("z"), F.lit(0.0)).alias("east"), F.coalesce(F.lead("z").over(south) - F.col("z"), F.lit(0.0)).alias("south"))


def crests(cells: DataFrame, level: int, across: str = "r", along: str = "c") -> DataFrame:
    """(r, c, crest) per coarse face between a block and the next one along an axis: the highest flow cell along the shared edge, on
    either side, but no lower than both blocks; an edge of walls alone, and a block of them, stands 100 above the highest flow cell."""
    high = cells.agg((F.max(F.when(~F.col("wall"), F.col("z"))) + 100).alias("_high"))
    own, place = F.floor(F.col(across) / level), F.floor(F.col(along) / level)
    flow = F.max(F.when(~F.col("wall"), F.col("z")))
    touch = cells.withColumn("c_", F.when(F.col(along) % level == level - 1, place).when((F.col(along) % level == 0) & (F.col(along) > 0), place - 1))
    edge = touch.filter("c_ IS NOT NULL").groupBy(own.alias("r"), F.col("c_").alias("c")).agg(flow.alias("top"))
    block = cells.groupBy(own.alias("r"), place.alias("c")).agg(F.avg(F.when(~F.col("wall"), F.col("z"))).alias("z"))
    both = edge.join(block, ["r", "c"]).join(block.select("r", (F.col("c") - 1).alias("c"), F.col("z").alias("z2")), ["r", "c"]).crossJoin(F.broadcast(high))
    return both.select("r", "c", F.greatest(*(F.coalesce(x, "_high") for x in ("top", "z", "z2"))).alias("crest"))


def window_of(cells: DataFrame, some: DataFrame, margin: int) -> DataFrame:
    """One row (r0, r1, c0, c1): the box of some cells grown by a margin inside the grid; the whole grid if there are none."""
    size = cells.agg(F.max("r").alias("rows"), F.max("c").alias("columns"))
    box = cells.join(some.select("cell"), "cell", "left_semi").agg(*(f(k).alias(f"{k}_{f.__name__}") for k in "rc" for f in (F.min, F.max)))
    low = lambda k: F.greatest(F.coalesce(f"{k}_min", F.lit(0)) - margin, F.lit(0))
    high = lambda k, most: F.least(F.coalesce(F.col(f"{k}_max"), F.col(most)) + margin, F.col(most))
    return box.crossJoin(F.broadcast(size)).select(low("r").alias("r0"), high("r", "rows").alias("r1"), low("c").alias("c0"), high("c", "columns").alias("c1"))


def region_of_interest(cells: DataFrame, wanted: DataFrame, travel: float, d: float) -> DataFrame:
    """The box of wanted cells, grown by how far water travels and 16 cells at least; accepted if it is at most half of the grid."""
    margin = max(16, -int(-travel // d))
    size = cells.agg(((F.max("r") + 1) * (F.max("c") + 1)).alias("all"))
    return window_of(cells, wanted, margin).crossJoin(F.broadcast(size)).select("r0", "r1", "c0", "c1", (2 * (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) <= F.col("all")).alias("accepted"))


def overlaid(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Heights with sparse edits (cell, dz) added."""
    return cells.join(edits, "cell", "left").withColumn("z", F.col("z") + F.coalesce("dz", F.lit(0.0))).drop("dz")


def refined(cells: DataFrame, factor: int, nx: int, ny: int) -> DataFrame:
    """A finer grid with heights bilinear between cell centres, clamped at the border; where a corner has none, the nearest cell's."""
    k = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    fine = cells.select("r", "c", k.alias("i")).select("r", "c", "i", k.alias("j"))
    fr, fc = F.col("r") * factor + F.col("i"), F.col("c") * factor + F.col("j")
    y, x = (fr + 0.5) / factor - 0.5, (fc + 0.5) / factor - 0.5
    y, x = F.greatest(F.lit(0.0), F.least(y, F.lit(ny - 1.0))), F.greatest(F.lit(0.0), F.least(x, F.lit(nx - 1.0)))
    fine = fine.select(fr.alias("fr"), fc.alias("fc"), F.col("r").alias("pr"), F.col("c").alias("pc"), F.floor(y).alias("r0"), F.floor(x).alias("c0"), (y - F.floor(y)).alias("wy"), (x - F.floor(x)).alias("wx"))
    fine = fine.withColumn("r1", F.least(F.col("r0") + 1, F.lit(ny - 1))).withColumn("c1", F.least(F.col("c0") + 1, F.lit(nx - 1)))
    for name, r, c in (("a", "r0", "c0"), ("b", "r0", "c1"), ("e", "r1", "c0"), ("f", "r1", "c1"), ("own", "pr", "pc")):
        fine = fine.join(shuffled(cells.select(F.col("r").alias(r), F.col("c").alias(c), F.col("z").alias(name))), [r, c], "left")
    north, south = F.expr("a + (b - a) * wx"), F.expr("e + (f - e) * wx")
    return fine.select("fr", "fc", F.coalesce(north + (south - north) * F.col("wy"), "own").alias("z"))


def difference(a: DataFrame, b: DataFrame, value: str = "h") -> DataFrame:
    """(cell, before, after, delta) of cells that both runs have."""
    return a.select("cell", F.col(value).alias("before")).join(b.select("cell", F.col(value).alias("after")), "cell").withColumn("delta", F.col("after") - F.col("before"))


def summary(delta: DataFrame, cell_area: float = 1.0, threshold: float = 0.01) -> DataFrame:
    worse, better = F.count_if(F.col("delta") > threshold), F.count_if(F.col("delta") < -threshold)
    return delta.agg(
        F.greatest(F.max("delta"), F.lit(0.0)).alias("max_increase_m"), F.greatest(-F.min("delta"), F.lit(0.0)).alias("max_decrease_m"),
        worse.alias("cells_worsened"), better.alias("cells_improved"), (worse * cell_area).alias("area_worsened_m2"), (better * cell_area).alias("area_improved_m2"),
    )


def outline(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Border sides of a mask's cells: (cell, di, dj) where the next cell isn't in the mask."""
    steps = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in AROUND4))
    sides = mask.withColumn("s", F.explode(steps)).select("cell", "s.di", "s.dj", (F.col("r") + F.col("s.di")).alias("r"), (F.col("c") + F.col("s.dj")).alias("c"))
    return sides.join(mask.select("r", "c"), ["r", "c"], "left_anti").select("cell", "di", "dj")
