"""Problem checks, the tree hash and the evaluator stream."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rillwork.operators import checks, evaluation, search, tiles
from rillwork.operators.sides import Segment
from rillwork.streaming import evaluator

CELLS = "cell bigint, r bigint, c bigint, z double, n double, wall boolean, h double, qx double, qy double"


def rows_of(**change):
    return [dict({"cell": k, "r": k // 4, "c": k % 4, "z": 0.1 * k, "n": 0.03, "wall": k == 5, "h": 0.0, "qx": 0.0, "qy": 0.0} | change.get(f"c{k}", {})) for k in range(12) if change.get(f"c{k}", {}) is not None]


def cells_of(spark, **change):
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in CELLS.split(", ")) for r in rows_of(**change)], CELLS)


@pytest.fixture(scope="module")
def sound(spark):
    cells = cells_of(spark)
    problem = evaluation.Problem(
        cells, cells.select("cell", "r", "c"), spark.createDataFrame([(1, 0.1, 1.0)], "asset int, threshold double, weight double"), spark.createDataFrame([(1, 3), (1, 99)], "asset int, cell bigint"),
        spark.createDataFrame([(2,)], "cell bigint"), tiles.Params(60.0), 4, 1.0,
    )
    return problem, spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 5.0, 0.0), ("b", 0, 3.0, 1.0)], "series string, k int, t double, rate double")


def broken(problem, storm, settings=None):
    return {r.rule: r.failures for r in checks.problem_checks(problem, storm, settings).collect() if r.failures}


def test_each_broken_input_is_named(spark, sound):
    problem, storm = sound
    assert broken(problem, storm) == {}
    assert broken(replace(problem, cells=cells_of(spark, c3={"n": 0.5}, c4={"z": None}, c5={"z": None}, c6={"n": None}, c7=None)), storm) == {"roughness": 2, "height": 1, "cells_missing": 1, "editable_off_grid": 1}
    assert broken(replace(problem, cells=cells_of(spark, c3={"cell": 4})), storm) == {"cell_number": 1, "cell_twice": 1, "asset_without_cell": 1, "editable_off_grid": 1}
    bad = spark.createDataFrame([(1, -0.1, 1.0), (2, 0.1, None)], "asset int, threshold double, weight double")
    assert broken(replace(problem, assets=bad, guard=spark.createDataFrame([(77,)], "cell bigint"), editable=problem.editable.filter("false")), storm) == {"asset_threshold": 1, "asset_weight": 1, "asset_without_cell": 1, "guard_off_grid": 1, "nothing_editable": 1}
    assert broken(problem, storm.union(spark.createDataFrame([("b", 1, 2.0, -1.0)], storm.schema))) == {"storm_order": 1, "storm_rate": 1}
    p = replace(problem.params, duration=0.0, cfl=0.6, scheme="other", sides=(Segment("up", "open"),))
    s = checks.Settings(1, 2, 0.5, (1, 2), (1.0,), "guess", 1.0)
    assert set(broken(replace(problem, params=p), storm, s)) == {"duration", "cfl", "scheme", "sides", "crs", "cell_size", "levels_end", "level_shares", "method", "robustness"}


def test_tree_hash_sees_one_value(spark):
    big = spark.range(40 * 50).selectExpr("id AS cell", "id div 50 AS r", "id % 50 AS c", "id * 0.5D AS z", "0.03D AS n", "id % 7 = 0 AS wall")
    hashed = lambda t, fixed="a", **k: checks.tree_hash(t, 50, fixed, **k).first()[0]
    whole = hashed(big)
    assert whole == hashed(big.repartition(5).orderBy(F.desc("cell"))) and len(whole) == 64
    assert len({whole, hashed(big, "b"), hashed(big.withColumn("z", F.when(F.col("cell") == 1234, 0.25).otherwise(F.col("z")))), hashed(big.withColumn("wall", F.col("wall") | (F.col("cell") == 1))), hashed(big, tile=8, depth=checks.levels_for(2000, 8))}) == 5
    assert checks.levels_for(10**9) == 6


def test_a_restarted_evaluator_gives_no_row_twice(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def evaluate(level, incumbent):
        def run(points):
            def count(batches):
                for b in batches:
                    ran.add(b.num_rows)
                    yield b

            return points.mapInArrow(count, points.schema).select("cand", F.lit(True).alias("feasible"), (F.col("u")[0] + level).alias("j"), F.lit(0.0).alias("violation"))

        return run

    space = search.Space(2, evaluate)
    into, folder = tmp_path / "in", str(tmp_path / "out")
    into.mkdir()
    go = lambda: evaluator.serve(spark.readStream.schema(evaluator.REQUEST).json(str(into)), space, (1, 2), folder, str(tmp_path / "cp")).awaitTermination(120)
    (into / "1.json").write_text('{"id": "a", "level": 1, "x": [[0.25, 0.5], [0.5, 7.0], [0.25, 0.5]]}\n{"id": "b", "level": 3, "x": [[0.1, 0.1]]}\n{"id": "c", "level": 1, "x": [[0.1]]}\n')
    go()
    assert ran.value == 2
    (into / "2.json").write_text('{"id": "d", "level": 1, "x": [[0.25, 0.5]]}\n{"id": "e", "level": 2, "x": [[0.25, 0.5]]}\n{"id": "e", "level": 2, "x": [[0.25, 0.5]]}\n')
    go()
    go()
    answers = spark.read.parquet(f"{folder}/answers").collect()
    got = sorted((r.id, r.place, r.j, r.cached) for r in answers if r.error is None)
    assert got == [("a", 0, 1.25, got[0][3]), ("a", 1, 1.5, False), ("a", 2, 1.25, not got[0][3]), ("d", 0, 1.25, True), ("e", 0, 2.25, False)]
    assert {r.id: r.error for r in answers if r.error} == {"b": "level 3 is not there", "c": "every point must have 2 coordinates"} and ran.value == 3
    # a batch that is tried again writes its answers over
    evaluator.answered(spark.createDataFrame([("d", 1, [[0.25, 0.5]]), ("e", 2, [[0.25, 0.5]])], evaluator.REQUEST), 1, space, (1, 2), folder)
    assert len(spark.read.parquet(f"{folder}/answers").collect()) == len(answers) and ran.value == 4
