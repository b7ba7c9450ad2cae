"""What grows with the grid goes by shuffle: no task gets it whole, and it doesn't pass through the driver."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillwork.operators import design, evaluation, flow, raster, tiles


@pytest.fixture(scope="module")
def ground(spark):
    """Cells of a dry grid, and changes of two candidates."""
    cells = spark.range(240).select(F.col("id").alias("cell"), F.expr("id div 8").alias("r"), (F.col("id") % 8).alias("c"), (F.col("id") * 0.01).alias("z"), F.lit(0.03).alias("n"), (F.col("id") % 7 == 0).alias("wall"), *(F.lit(0.0).alias(k) for k in ("h", "qx", "qy")))
    return cells, spark.createDataFrame([(1, 9, 0.5), (2, 9, -0.5), (2, 10, -0.25)], "cand bigint, cell bigint, dz double")


def sent(df):
    """The joins of a plan that send a side to all tasks."""
    df.collect()
    return re.findall(r"Broadcast\w*Join.*", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])


def test_designs_meet_the_grid_by_shuffle(spark, ground):
    cells, edits = ground
    made = spark.createDataFrame([(1, "berm", 10.0, 10.0, 20.0, 8.0, 0.0, 0.5)], "cand bigint, kind string, x double, y double, length double, width double, angle double, height double")
    assert not sent(design.materialize(made, cells.filter("NOT wall"), 5.0, 1.0))
    assert not sent(design.new_pits(cells, edits, 8))
    assert not sent(raster.refined(cells, 2, 8, 30))


def test_tiles_go_by_shuffle(spark, ground):
    """A dry tile is next to nothing in a compressed file, and 300 kB in memory."""
    cells, edits = ground
    domain = tiles.Domain(8, 30, 5.0, 5.0, 4)
    base = evaluation.stored(tiles.tiled(cells.select(F.lit(0).cast("bigint").alias("cand"), *flow.STATE), domain), "ground")
    keys = spark.range(16).select((F.col("id") % 2 + 1).alias("cand"), F.col("id").alias("tile"))
    found = tiles.edited(keys, base, edits, domain)
    assert not sent(found) and found.count() == 16
    assert not sent(tiles.monitored(found.withColumn("peak", F.col("h")), cells.select("cell"), domain))


def test_a_search_for_the_cheapest_design_runs_once(spark, tmp_path, monkeypatch):
    """c19_revalidation stores the design before its runs, so that these don't make all designs again."""
    from rillwork.plans import design as P

    seen = []
    monkeypatch.setattr(P.E, "revalidated", lambda best, cases: seen.append(best) or best)
    P.c19b(spark, "/root/testdata/sf0.001")
    assert not re.search("embeddings", seen[0]._jdf.queryExecution().optimizedPlan().toString()) and seen[0].inputFiles() and not any("embeddings" in f for f in seen[0].inputFiles())


def test_every_design_is_revalidated(spark, monkeypatch):
    """c19_revalidation runs all design points, not the cheapest one alone."""
    from rillwork.plans import design as P

    seen = []
    monkeypatch.setattr(P.E, "revalidated", lambda designs, cases: seen.append((designs, cases)) or designs)
    P.c19b(spark, "/root/testdata/sf0.001")
    designs, cases = seen[0]
    assert len(cases) == 3 and {r.cand for r in designs.collect()} == {r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()}


def test_tiles_that_many_candidates_want_are_dealt_out(spark):
    """All designs may lie in one tile; none of its rows meets more than some hundred of them, and a reader has few rows of a table of tiles at once."""
    keys = spark.range(700).select(F.col("id").alias("cand"), F.expr("id div 600").alias("tile"))
    many, few = tiles.spread(keys, spark.range(3).select(F.col("id").alias("tile"), (F.col("id") * 2).alias("x")))
    assert sorted(tuple(r) for r in few.collect()) == [(0, 0, k) for k in range(5)] + [(1, 2, 0)]
    met = many.join(few, ["tile", "part"])
    assert sorted((r.cand, r.tile, r.x) for r in met.collect()) == [(k, k // 600, k // 600 * 2) for k in range(700)]
    assert max(r["count"] for r in met.groupBy("tile", "part").count().collect()) <= 2 * tiles.A_TASK
    table = evaluation.stored(keys.coalesce(1), "tiles", 32)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in (x.replace("///", "/") for x in table.inputFiles())]
    assert sum(g.num_rows for g in groups) == 700 and max(g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)) <= 128


def test_static_checks_have_tasks_by_designs(spark, monkeypatch):
    """Compressed changes of many designs are few bytes, by which Spark would deal them out to no more tasks than there are cores."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    table = evaluation.stored(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "many", tasks=24)
    assert len(table.inputFiles()) > 4 * spark.sparkContext.defaultParallelism and table.count() == 100
    assert before == {k: spark.conf.get(k) for k in before}
    seen = {}
    real = evaluation.stored
    monkeypatch.setattr(evaluation, "stored", lambda df, name, batch=None, tasks=None: seen.setdefault(name, tasks) and False or real(df, name, batch, tasks))
    monkeypatch.setattr(evaluation, "DESIGNS", 50)
    from rillwork.plans import design as P

    rows = evaluation.evaluated(P._primitives(spark, "/root/testdata/sf0.001"), evaluation.without_changes(P._problem(spark, "/root/testdata/sf0.001")))
    n = P._primitives(spark, "/root/testdata/sf0.001").select("cand").distinct().count()
    assert rows.count() == n and seen["edits"] == seen["rejected"] == -(-n // 50) > 4
