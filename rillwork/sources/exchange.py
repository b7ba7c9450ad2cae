"""Exchange formats as tables: GeoJSON, JSON lines, CSV, depth frames, surface triangles, metrics documents, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "array<double>"
GEOMETRY = f"type string, coordinates array<array<array<{POINT}>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(poly, ring, points, props) of the polygons in files of features, one ring a row; poly numbers a file's polygons, ring 0 is the outer one."""
    return geojson_rings(spark.read.text(path, wholetext=True))


def geojson_rings(texts: DataFrame) -> DataFrame:
    """The same from a column `value` of GeoJSON texts: collections, single features or bare geometries, polygons and multipolygons."""
    feature = "struct<geometry: struct<type: string, coordinates: string>, properties: string>"
    one = F.from_json("value", f"type string, features array<{feature}>, geometry struct<type: string, coordinates: string>, properties string, coordinates string")
    t = texts.select(one.alias("j"))
    bare = F.array(F.struct(F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates")).alias("geometry"), F.lit(None).cast("string").alias("properties")))
    single = F.array(F.struct(F.col("j.geometry").alias("geometry"), F.col("j.properties").alias("properties")))
    f = t.select(F.posexplode(F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).when(F.col("j.type") == "Feature", single).otherwise(bare)).alias("feature", "f"))
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")))
    polys = f.select("feature", F.col("f.properties").alias("props"), F.posexplode(many).alias("part", "rings"))
    rings = polys.select(F.concat_ws(".", "feature", "part").alias("poly"), "props", F.posexplode("rings").alias("ring", "xy"))
    return rings.select("poly", "ring", F.transform("xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"), "props")


def geojson_features(rings: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, from (poly, ring, points)."""
    xy = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    polys = rings.groupBy("poly").agg(F.array_sort(F.collect_list(F.struct("ring", xy.alias("xy")))).alias("r"))
    return polys.select("poly", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.col("r.xy").alias("coordinates")).alias("geometry"))).alias("value"))


def append_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("append").json(path)


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A trace of JSON lines; torn lines are left out, so a search can go on after a crash."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """CSV with nine decimals in scientific form."""
    ledger.select(*(F.format_string("%.9e", F.col(c).cast("double")).alias(c) for c in ledger.columns)).write.option("header", True).csv(path)


def depth_mm(h: Column) -> Column:
    """Depths as whole millimetres in 16 bits."""
    return F.least(F.greatest(F.round(h * 1000), F.lit(0.0)), F.lit(65535.0)).cast("int")


def triangles(cells: DataFrame) -> DataFrame:
    """(a, b, c): two triangles for each square of four cell centres (cell, r, c)."""
    at = lambda name, i, j: cells.select((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.col("cell").alias(name))
    quads = at("p00", 0, 0).join(at("p01", 0, 1), ["r", "c"]).join(at("p10", 1, 0), ["r", "c"]).join(at("p11", 1, 1), ["r", "c"])
    both = F.array(F.struct(F.col("p00").alias("a"), F.col("p10").alias("b"), F.col("p01").alias("c")), F.struct(F.col("p01").alias("a"), F.col("p10").alias("b"), F.col("p11").alias("c")))
    return quads.select(F.explode(both).alias("t")).select("t.a", "t.b", "t.c")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of files, read where they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("hash"))
