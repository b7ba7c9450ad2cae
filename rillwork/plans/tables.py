"""Queries of sources, sinks and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.plans.design import EDITS, _edits
from rillwork.plans.registry import query
from rillwork.sources import domain as D
from rillwork.sources import exchange as X

V = f"WITH {D.SQL}"


@query("io3_geojson_scan", "SELECT s_suppkey::VARCHAR AS name, x::DOUBLE AS x, y::DOUBLE AS y, i::INT AS i FROM supplier, LATERAL (VALUES (0, s_suppkey * 1.5, s_nationkey * 2.0), (1, s_suppkey * 1.5 + 6, s_nationkey * 2.0), (2, s_suppkey * 1.5 + 6, s_nationkey * 2.0 + 4), (3, s_suppkey * 1.5, s_nationkey * 2.0 + 4)) AS t(i, x, y)")
def io3(spark, sf):
    text = "format_string('{\"type\": \"Feature\", \"properties\": {\"name\": \"%d\"}, \"geometry\": {\"type\": \"MultiPolygon\", \"coordinates\": [[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]]}}', s_suppkey, x, y, x + 6, y, x + 6, y + 4, x, y + 4) AS value"
    made = D.table(spark, sf, "supplier").selectExpr("s_suppkey", "s_suppkey * 1.5D AS x", "s_nationkey * 2.0D AS y").selectExpr(text)
    rings = X.geojson_rings(made)
    return rings.select(F.get_json_object("props", "$.name").alias("name"), F.posexplode("points").alias("i", "p")).select("name", "p.x", "p.y", "i")


@query("io4_geojson_sink", "SELECT s_suppkey AS poly, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[' || s_suppkey || '.0,0.0],[' || (s_suppkey + 2) || '.0,0.0],[' || s_suppkey || '.0,2.0]]]}}' AS value FROM supplier")
def io4(spark, sf):
    p = "array(struct(cast(s_suppkey AS double) AS x, 0D AS y), struct(s_suppkey + 2D AS x, 0D AS y), struct(cast(s_suppkey AS double) AS x, 2D AS y)) AS points"
    return X.geojson_features(D.table(spark, sf, "supplier").selectExpr("s_suppkey AS poly", "0 AS ring", p))


@query("io7_content_hash", "SELECT p_partkey AS id, sha256(p_name || '|' || p_brand || '|' || p_type) AS hash FROM part")
def io7(spark, sf):
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("hash"))


@query("io9_json_lines", "SELECT event_id, event_type AS status, value AS j FROM events WHERE event_id % 5 <> 0")
def io9(spark, sf):
    """Lines of a log, every fifth one torn; torn lines give no row."""
    line = "IF(event_id % 5 = 0, substr(to_json(struct(event_id, event_type AS status, value AS j)), 1, 20), to_json(struct(event_id, event_type AS status, value AS j))) AS value"
    parsed = D.table(spark, sf, "events").selectExpr(line).select(F.from_json("value", "event_id bigint, status string, j double, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter("r._corrupt IS NULL").select("r.event_id", "r.status", "r.j")


@query("io10_ledger_csv", "SELECT o_orderkey AS id, printf('%.9e', o_totalprice) AS total FROM orders")
def io10(spark, sf):
    return D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("%.9e", "o_totalprice").alias("total"))


@query("io11_trace_csv", f"{V} SELECT eval_index, level, generation, key, CASE WHEN feasible THEN 'ok' ELSE 'guard_abort' END AS status, feasible, j, violation FROM trace")
def io11(spark, sf):
    return D.trace(spark, sf).select("eval_index", "level", "generation", "key", F.when(F.col("feasible"), "ok").otherwise("guard_abort").alias("status"), "feasible", "j", "violation")


@query("io12_depth_frames", f"{V} SELECT step, cell, least(greatest(round(h * 200000), 0), 65535)::INT AS mm, h * 200000 > 65535 AS saturated FROM traj")
def io12(spark, sf):
    return D.traj(spark, sf).select("step", "cell", X.depth_mm(F.col("h") * 200).alias("mm"), (F.col("h") * 200000 > 65535).alias("saturated"))


@query("io13_frame_stride", f"{V} SELECT r // 4 AS fr, c // 4 AS fc, z FROM cells WHERE r % 4 = 2 AND c % 4 = 2")
def io13(spark, sf):
    return D.cells(spark, sf).filter("(r - 2) % 4 = 0 AND (c - 2) % 4 = 0 AND r >= 2 AND c >= 2").selectExpr("r div 4 AS fr", "c div 4 AS fc", "z")


@query("io14_tin", f"{V}, w AS (SELECT cell, r, c FROM cells WHERE r BETWEEN 3 AND 12 AND c BETWEEN 5 AND 30), q AS (SELECT a.cell AS p00, b.cell AS p01, d.cell AS p10, e.cell AS p11 FROM w a JOIN w b ON b.r = a.r AND b.c = a.c + 1 JOIN w d ON d.r = a.r + 1 AND d.c = a.c JOIN w e ON e.r = a.r + 1 AND e.c = a.c + 1) SELECT p00 AS a, p10 AS b, p01 AS c FROM q UNION ALL SELECT p01, p10, p11 FROM q")
def io14(spark, sf):
    return X.triangles(D.cells(spark, sf).filter("r BETWEEN 3 AND 12 AND c BETWEEN 5 AND 30"))


@query("io15_cad_points", f"{V}, {EDITS} SELECT cand, count(*) FILTER (dz > 0.005) AS fill_points, count(*) FILTER (dz < -0.005) AS cut_points FROM edits WHERE abs(dz) > 0.005 GROUP BY cand")
def io15(spark, sf):
    return _edits(spark, sf).filter("abs(dz) > 0.005").groupBy("cand").agg(F.count_if(F.col("dz") > 0.005).alias("fill_points"), F.count_if(F.col("dz") < -0.005).alias("cut_points"))


@query("io17_metrics_json", f"{V} SELECT '{{\"level\":' || level || ',\"evaluations\":' || count(*) || ',\"feasible\":' || count(*) FILTER (feasible) || '}}' AS document FROM trace GROUP BY level")
def io17(spark, sf):
    m = D.trace(spark, sf).groupBy("level").agg(F.count("*").alias("evaluations"), F.count_if("feasible").alias("feasible"))
    return m.select(F.to_json(F.struct("level", "evaluations", "feasible")).alias("document"))


@query("io18_bowl", "SELECT i AS cell, 20 + 0.0002::DOUBLE * (((i % 64) * 5 - 160) * ((i % 64) * 5 - 160) + ((i // 64) * 5 - 160) * ((i // 64) * 5 - 160)) AS z FROM range(4096) AS t(i)")
def io18(spark, sf):
    """The closed bowl, from its formula."""
    return spark.range(4096).selectExpr("id AS cell", "20 + 0.0002D * (((id % 64) * 5 - 160) * ((id % 64) * 5 - 160) + ((id div 64) * 5 - 160) * ((id div 64) * 5 - 160)) AS z")


@query("io19_gullies", "SELECT i AS cell, round(min(sqrt(((i % 120) - x) ** 2 + ((i // 120) - y) ** 2)), 9) AS d FROM range(11520) AS t(i), (VALUES (10, 90), (40, 50), (80, 60), (110, 5)) AS g(x, y) GROUP BY i")
def io19(spark, sf):
    """Distance of each cell to the nearest gully point."""
    d = [F.sqrt((F.col("c") - x) * (F.col("c") - x) + (F.col("r") - y) * (F.col("r") - y)) for x, y in ((10, 90), (40, 50), (80, 60), (110, 5))]
    return spark.range(11520).selectExpr("id AS cell", "id % 120 AS c", "id div 120 AS r").select("cell", F.round(F.least(*d), 9).alias("d"))


@query("io20_inspect", f"{V} SELECT max(c) + 1 AS nx, max(r) + 1 AS ny, count(*) AS n_cells, count(*) FILTER (wall) AS n_walls, min(z) AS z_min, max(z) AS z_max FROM cells")
def io20(spark, sf):
    return D.cells(spark, sf).agg((F.max("c") + 1).alias("nx"), (F.max("r") + 1).alias("ny"), F.count("*").alias("n_cells"), F.count_if("wall").alias("n_walls"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
