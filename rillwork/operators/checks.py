"""Checks of a problem before anything runs: rules over its tables and settings, each with the number of rows that break it; and a hash of what it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators.evaluation import Problem


@dataclass
class Settings:
    """What a problem says about itself besides its tables."""

    crs: int | None = None
    ground_crs: int | None = None
    cell_size: float | None = None
    levels: tuple[int, ...] = (1,)
    shares: tuple[float, ...] | None = None
    method: str = "cma_es"
    alpha: float = 0.0
    beta: float = 0.0
    scales: tuple[float, ...] = (1.0,)


# The search methods there are.
METHODS = ("cma_es", "lq_cma_es", "random", "sobol", "coordinate")


def table_checks(problem: Problem, storm: DataFrame) -> DataFrame:
    """(rule, failures) of the rules over tables; storm: (series, t, rate). One aggregation a table."""
    cells, rows = problem.cells, []

    def counted(table: DataFrame, **rules) -> None:
        one = table.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(k) for k, bad in rules.items()))
        rows.append(one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("failures")) for k in rules))).alias("x")).select("x.*"))

    grid = cells.select("cell")
    counted(cells, roughness=~F.col("n").between(0, 0.5) | (F.col("n") == 0.5), height=~F.col("wall") & (F.col("z").isNull() | F.isnan("z")), cell_number=F.col("cell") != F.col("r") * problem.nx + F.col("c"), column=~F.col("c").between(0, problem.nx - 1))
    counted(cells.groupBy("cell").count(), cell_twice=F.col("count") > 1)
    size = cells.agg((F.count("*") < (F.max("r") + 1) * problem.nx).alias("gap"), (F.count_if(~F.col("wall")) == 0).alias("dry"))
    counted(size, cells_missing=F.col("gap"), no_flow_cell=F.col("dry"))
    counted(problem.assets, asset_threshold=F.col("threshold") < 0, asset_weight=F.col("weight") < 0)
    on_grid = problem.asset_cells.join(grid, "cell", "left_semi").select("asset").distinct().withColumn("on", F.lit(True))
    counted(problem.assets.join(on_grid, "asset", "left"), asset_without_cell=F.col("on").isNull())
    for name, mask in (("editable", problem.editable), ("guard", problem.guard)):
        counted(mask.select("cell").join(grid.withColumn("on", F.lit(True)), "cell", "left"), **{f"{name}_off_grid": F.col("on").isNull()})
    counted(problem.editable.agg(F.count("*").alias("n")), nothing_editable=F.col("n") == 0)
    before = F.lag("t").over(Window.partitionBy("series").orderBy("k"))
    counted(storm.withColumn("before", before), storm_order=F.coalesce(F.col("t") < F.col("before"), F.lit(False)), storm_rate=F.col("rate") < 0)
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def setting_checks(problem: Problem, s: Settings) -> list[tuple[str, bool]]:
    """(rule, whether it is broken) of the rules over settings."""
    p = problem.params
    return [
        ("duration", not p.duration > 0), ("sync_interval", not p.sync > 0), ("cfl", not 0 < p.cfl <= 0.5), ("dt_max", not p.dt_max > 0), ("infiltration", not p.infiltration >= 0), ("scheme", p.scheme not in ("hll", "inertial")),
        ("crs", s.crs is not None and s.ground_crs is not None and s.crs != s.ground_crs), ("cell_size", s.cell_size is not None and abs(problem.d - s.cell_size) > 1e-6 * s.cell_size), ("levels_end", not s.levels or s.levels[-1] != 1),
        ("level_shares", s.shares is not None and len(s.shares) != len(s.levels)), ("method", s.method not in METHODS), ("robustness", not (0 <= s.alpha < 1 and s.beta >= 0 and s.scales and min(s.scales) >= 0)),
        ("sides", any(x.kind not in ("wall", "open", "stage", "inflow") or x.side not in ("west", "east", "north", "south") for x in p.sides)),
    ]


def problem_checks(problem: Problem, storm: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(rule, failures) of every rule; a sound problem has none. storm: (series, k, t, rate), k being the order in which the knots are given."""
    found = setting_checks(problem, settings or Settings())
    own = storm.sparkSession.createDataFrame([(k, int(bad)) for k, bad in found], "rule string, failures bigint")
    return table_checks(problem, storm).unionByName(own)


def tree_hash(cells: DataFrame, nx: int, fixed: str, tile: int = 16, fan: int = 16, depth: int = 2) -> DataFrame:
    """One row (problem_hash): a hash of the hashes of tiles of cells (r, c, z, n, wall), gathered `fan` at a time over `depth` levels or as many as needed, and
    of the settings. Heights count in hundredths, roughness in millionths. No group has more than a tile's cells or a level's fan of hashes, but for the last."""
    across = -(-nx // tile)
    value = F.concat_ws(":", F.round(F.col("z") * 100).cast("bigint"), F.round(F.col("n") * 1_000_000).cast("bigint"), F.col("wall").cast("int"))
    at = (F.floor(F.col("r") / tile) * across + F.floor(F.col("c") / tile)).cast("bigint")
    ordered = lambda key, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, v))), lambda x: x["v"]), ","), 256).alias("h")
    rows = cells.select(at.alias("node"), (F.col("r") * nx + F.col("c")).alias("k"), value.alias("v")).groupBy("node").agg(ordered(F.col("k"), F.col("v")))
    for _ in range(depth - 1):
        rows = rows.select(F.floor(F.col("node") / fan).alias("up"), F.col("node").alias("k"), F.col("h").alias("v")).groupBy("up").agg(ordered(F.col("k"), F.col("v"))).withColumnRenamed("up", "node")
    top = rows.select(F.col("node").alias("k"), F.col("h").alias("v")).agg(ordered(F.col("k"), F.col("v")))
    return top.select(F.sha2(F.concat_ws("|", F.lit(fixed), "h"), 256).alias("problem_hash"))


def levels_for(cells: int, tile: int = 16, fan: int = 16) -> int:
    """The depth at which the last group has at most `fan` hashes."""
    nodes, depth = max(1, -(-cells // (tile * tile))), 1
    while nodes > fan:
        nodes, depth = -(-nodes // fan), depth + 1
    return depth
