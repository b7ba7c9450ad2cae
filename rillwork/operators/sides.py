"""What lies beyond the sides of a grid: segments of walls, open stretches, given levels and inflows, as a table and for blocks of cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sides and the kinds of their cells, by number.
SIDES = ("west", "east", "north", "south")
WALL, OPEN, STAGE, INFLOW = range(4)
KINDS = ("wall", "open", "stage", "inflow")


@dataclass(frozen=True)
class Segment:
    """A stretch of a side, from and to in metres along it (None: the whole side); later segments lie over earlier ones.

    level is the water level of a stage (m); knots the hydrograph of an inflow (s, m3/s over the whole segment)."""

    side: str
    kind: str
    start: float | None = None
    end: float | None = None
    level: float = 0.0
    knots: tuple = ((0.0, 0.0),)

    def cells(self, nx: int, ny: int, d: float) -> tuple[int, int]:
        """The first cell and the one after the last: any cell that the stretch touches."""
        n = nx if self.side in ("north", "south") else ny
        if self.start is None or self.end is None:
            return 0, n
        clip = lambda x: int(min(max(x, 0), n))
        return clip(np.floor(self.start / d)), clip(np.ceil(self.end / d))


def side_cells(segments: DataFrame, nx: int, ny: int, dx: float, dy: float) -> DataFrame:
    """(side, pos, kind, segment, level, inv_len) of each cell of the four sides; segments: (segment, side, kind, start, end, level).

    The last segment that touches a cell holds; cells without one are walls. inv_len is 1 over the length of an inflow's cells (m).
    A stretch is cut into blocks of 2^k cells, two of a size at most. Of a block's segments only the last one goes on to its cells, so rows grow with segments and cells, not with their product."""
    across = F.col("side").isin("north", "south")
    n, d = F.when(across, nx).otherwise(ny), F.when(across, dx).otherwise(dy)
    whole = F.col("start").isNull() | F.col("end").isNull()
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), n)
    first = F.when(whole, 0).otherwise(clip(F.floor(F.col("start") / d)))
    last = F.when(whole, n).otherwise(clip(F.ceil(F.col("end") / d)))
    bounded = segments.withColumns({"_a": first.cast("int"), "_e": last.cast("int"), "_d": d.cast("double")}).filter("_a < _e")
    inv_len = F.when(F.col("kind") == "inflow", 1 / ((F.col("_e") - F.col("_a")) * F.col("_d")))
    level = F.when(F.col("kind") == "stage", F.col("level"))
    made = bounded.select("side", F.struct("segment", "kind", level.alias("level"), inv_len.alias("inv_len")).alias("top"), F.col("_a").cast("bigint").alias("a"), F.col("_e").cast("bigint").alias("e"))
    # the whole blocks of 2^k cells in a stretch are those from a to e - 1; the odd one that they begin with and the even one that they end with lie in no larger one inside
    sizes = made.withColumn("k", F.explode(F.expr("sequence(0, cast(floor(log2(e - a)) AS int))"))).selectExpr("side", "top", "k", "shiftright(a + shiftleft(1L, k) - 1, k) AS a", "shiftright(e, k) AS e").filter("a < e")
    ends = F.expr("filter(array(IF(a % 2 = 1, a, NULL), IF(e % 2 = 1, e - 1, NULL)), x -> x IS NOT NULL)")
    blocks = sizes.select("side", "top", "k", F.explode(ends).alias("block")).groupBy("side", "k", "block").agg(F.max("top").alias("top"))
    cells = blocks.select("side", "top", F.explode(F.expr("sequence(cast(shiftleft(block, k) AS int), cast(shiftleft(block + 1, k) - 1 AS int))")).alias("pos"))
    top = cells.groupBy("side", "pos").agg(F.max("top").alias("top")).select("side", "pos", "top.*")
    spark = segments.sparkSession
    sides = spark.createDataFrame([(s, nx if s in ("north", "south") else ny) for s in SIDES], "side string, n int")
    every = sides.select("side", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return every.join(top, ["side", "pos"], "left").select("side", "pos", F.coalesce("kind", F.lit("wall")).alias("kind"), "segment", "level", "inv_len")


@dataclass
class Border:
    """The cells of a block's side: kind, level of a stage, and number of the segment and inverse length of an inflow."""

    kind: np.ndarray
    level: np.ndarray
    segment: np.ndarray
    inverse: np.ndarray

    def unit(self, totals: np.ndarray) -> np.ndarray:
        """Inflow through each metre of the side, from the segments' totals."""
        return np.where(self.kind == INFLOW, totals[self.segment] * self.inverse, 0.0)


def border(segments: tuple[Segment, ...], side: str, lo: int, hi: int, nx: int, ny: int, dx: float, dy: float) -> Border:
    """The cells lo to hi - 1 of a side."""
    d = dx if side in ("north", "south") else dy
    n = hi - lo
    out = Border(np.zeros(n, np.int8), np.zeros(n), np.zeros(n, np.int64), np.zeros(n))
    for k, s in enumerate(segments):
        if s.side == side:
            a, e = s.cells(nx, ny, d)
            at = slice(max(a - lo, 0), max(min(e, hi) - lo, 0))
            out.kind[at], out.level[at], out.segment[at] = KINDS.index(s.kind), s.level, k
            out.inverse[at] = 1 / ((e - a) * d) if s.kind == "inflow" and e > a else 0.0
    return out


def totals(segments: tuple[Segment, ...], t: float, scale: float = 1.0) -> np.ndarray:
    """What flows in through each segment at a time (m3/s)."""
    return np.array([scale * np.interp(t, *np.array(s.knots, float).T) if s.kind == "inflow" else 0.0 for s in segments] or [0.0])
