"""Raster files as tables: single-band GeoTIFF files are cut into their strips or tiles, which tasks decode on their own, and written a strip a group.

A file's bytes come through Spark's own reader, so they may lie anywhere it reads; strips outside of a window are dropped before they are decoded. Values of
no data are null. Classic TIFF of both byte orders, uncompressed, LZW or Deflate, with a horizontal predictor or none.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of the format, the sizes of its field types, and sample types by (format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SCALE, TIE, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, RASTER_TYPE, PROJECTED = 1024, 1025, 3072
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
NO_VALUE = -9999.0

INFO = "file string, nx int, ny int, x0 double, y0 double, dx double, dy double, epsg int, model int, point boolean, nodata double, compression int"
PART = "file string, r0 int, c0 int, rows int, cols int, width int, kind string, compression int, predictor int, nodata double, nx int, ny int, bytes binary"


class BadRaster(ValueError):
    """A file that isn't a raster of the kinds that are read; the message says why."""


def header(file: str, data: bytes) -> dict:
    """The tags of the file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise BadRaster(f"{file}: not a readable TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {0: order}
    for k in range(n):
        tag, kind, count, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind not in TYPES:
            continue
        size = struct.calcsize(order + TYPES[kind]) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[place : place + size]
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(order + TYPES[kind] * count, raw)
    one = lambda t, default: tags.get(t, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise BadRaster(f"{file}: expected a single band, found {one(SAMPLES, 1)}")
    if (one(FORMAT, 1), one(BITS, 1)) not in KINDS:
        raise BadRaster(f"{file}: unsupported samples of {one(BITS, 1)} bits")
    if one(COMPRESSION, 1) not in (1, 5, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise BadRaster(f"{file}: compression {one(COMPRESSION, 1)} with predictor {one(PREDICTOR, 1)}; none, LZW and Deflate are read")
    if SCALE not in tags and TRANSFORM in tags:
        raise BadRaster(f"{file}: a rotated or sheared grid; resample it to north-up")
    if len(tags.get(SCALE, ())) < 2 or len(tags.get(TIE, ())) < 6:
        raise BadRaster(f"{file}: no georeferencing")
    return tags


def info_of(file: str, tags: dict) -> tuple:
    """INFO: cell (0, 0) begins at (x0, y0); where values stand for points, these are cells' centres."""
    scale, tie = tags[SCALE], tags[TIE]
    keys = {}
    flat = tags.get(GEO_KEYS, ())
    for k in range(flat[3] if len(flat) >= 4 else 0):
        key, where, _, value = flat[4 + 4 * k : 8 + 4 * k]
        if where == 0:
            keys[key] = value
    point = keys.get(RASTER_TYPE) == 2
    half = 0.5 if point else 0.0
    x0, y0 = tie[3] - tie[0] * scale[0] - half * scale[0], tie[4] + tie[1] * scale[1] + half * scale[1]
    return file, tags[WIDTH][0], tags[HEIGHT][0], x0, y0, scale[0], scale[1], keys.get(PROJECTED), keys.get(MODEL_TYPE), point, nodata_of(tags), tags.get(COMPRESSION, (1,))[0]


def nodata_of(tags: dict) -> float | None:
    try:
        return float(tags[NODATA].strip())
    except (KeyError, ValueError):
        return None


def _table(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """INFO of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from _table([info_of(file, header(file, data.as_buffer().to_pybytes()))], INFO)

    return _files(spark, path).mapInArrow(run, INFO)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parts(window: tuple[int, int, int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer()
                tags = header(file, data.to_pybytes())
                nx, ny = tags[WIDTH][0], tags[HEIGHT][0]
                tiled = TILE_OFFSETS in tags
                w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (nx, min(tags.get(ROWS, (ny,))[0], ny))
                kind = tags[0] + KINDS[tags.get(FORMAT, (1,))[0], tags[BITS][0]]
                across = -(-nx // w)
                for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
                    r0, c0 = k // across * h, k % across * w
                    if window and (r0 >= window[1] or r0 + h <= window[0] or c0 >= window[3] or c0 + w <= window[2]):
                        continue
                    rows = h if tiled else min(h, ny - r0)
                    yield from _table([(file, r0, c0, rows, min(w, nx - c0), w, kind, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], nodata_of(tags), nx, ny, data[at : at + size].to_pybytes())], PART)

    return run


def lzw(data: bytes) -> bytes:
    """What LZW codes of growing width stand for, as TIFF has them: most significant bits first, 256 clears the table and 257 ends."""
    out, bits, held, width, table, before = bytearray(), 0, 0, 9, [], None
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if before is not None:
            table.append(before + word[:1])
        out += word
        before = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decoded(data: bytes, kind: str, rows: int, width: int, compression: int, predictor: int, nodata: float | None) -> np.ndarray:
    """The values of a strip or tile, NaN where there are none."""
    data = data if compression == 1 else lzw(data) if compression == 5 else zlib.decompress(data)
    a = np.frombuffer(data, kind)[: rows * width].reshape(-1, width)
    if predictor == 2:
        if kind[1] == "f":
            raise BadRaster("a horizontal predictor of fractions isn't read")
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    a = a.astype(float)
    if nodata is not None:
        a[(a == nodata) | ((abs(nodata) > 1e30) & (np.abs(a - nodata) <= abs(nodata) * 1e-6))] = np.nan
    return a


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(file, r, c, value) of the cells of files; window: first row, row after the last, first column, column after the last of those that are wanted."""
    parts = _files(spark, path).mapInArrow(_parts(window), PART)
    parts = parts.repartition("file", "r0", "c0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                a = decoded(p["bytes"], p["kind"], p["rows"], p["width"], p["compression"], p["predictor"], p["nodata"])[: p["ny"] - p["r0"], : p["cols"]]
                r, c = np.mgrid[p["r0"] : p["r0"] + a.shape[0], p["c0"] : p["c0"] + a.shape[1]]
                keep = np.ones(a.shape, bool) if window is None else (r >= window[0]) & (r < window[1]) & (c >= window[2]) & (c < window[3])
                v = a[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["file"]] * len(v), pa.string()), pa.array(r[keep].astype(np.int32)), pa.array(c[keep].astype(np.int32)), pa.array(v, mask=~np.isfinite(v))], names=["file", "r", "c", "value"]
                )

    return parts.mapInArrow(run, "file string, r int, c int, value double")


@dataclass(frozen=True)
class Geo:
    """Size and place of a grid: cell (0, 0) begins at (x0, y0)."""

    nx: int
    ny: int
    x0: float
    y0: float
    dx: float
    dy: float
    epsg: int | None = None


def _head(g: Geo, rows: int, sizes: list[int]) -> bytes:
    """Header, tags and their values; the strips follow in order."""
    place = []
    shorts = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 1, RASTER_TYPE, 0, 1, 1, PROJECTED, 0, 1, g.epsg or 32767]
    tags = [
        (WIDTH, "I", [g.nx]), (HEIGHT, "I", [g.ny]), (BITS, "H", [32]), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (OFFSETS, "I", sizes), (SAMPLES, "H", [1]), (ROWS, "I", [rows]), (COUNTS, "I", sizes), (FORMAT, "H", [3]),
        (SCALE, "d", [g.dx, g.dy, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, g.x0, g.y0, 0.0]), (GEO_KEYS, "H", shorts), (NODATA, "c", [bytes([b]) for b in b"-9999\0"]),
    ]
    values = lambda kind, v: struct.pack(f"<{len(v)}{kind}", *v)
    codes = {v: k for k, v in TYPES.items()}
    end = 8 + 2 + 12 * len(tags) + 4
    for _, kind, v in tags:
        size = len(values(kind, v))
        place.append(end if size > 4 else None)
        end += size + size % 2 if size > 4 else 0
    first = end
    starts = [first + x for x in np.cumsum([0, *sizes])[:-1].tolist()]
    if first + sum(sizes) >= 1 << 32:
        raise BadRaster("the file would be larger than 4 GB; write it in parts")
    head, more = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for (tag, kind, v), at in zip(tags, place, strict=True):
        raw = values(kind, starts if tag == OFFSETS else v)
        head += struct.pack("<HHI", tag, codes[kind], len(v)) + (raw.ljust(4, b"\0") if at is None else struct.pack("<I", at))
        more += b"" if at is None else raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + more


def write_raster(cells: DataFrame, grids: DataFrame, folder: str, rows: int = 64) -> DataFrame:
    """Writes 32-bit Deflate files from cells (file, r, c, value) and grids (file and Geo's columns); gives (file, path, bytes). Missing and null cells have no value.

    Strips are groups of their own; only the compressed strips of a file meet, in the task that writes it. A file appears by renaming once it is whole, so
    a task that runs again does no harm."""

    def strip(t: pa.Table) -> pa.Table:
        nx, ny, k = t["nx"][0].as_py(), t["ny"][0].as_py(), t["strip"][0].as_py()
        a = np.full((min(rows, ny - k * rows), nx), NO_VALUE, "<f4")
        r, c, v = t["r"].to_numpy(), t["c"].to_numpy(), t["value"].to_numpy(zero_copy_only=False).astype(float)
        good = np.isfinite(v)
        a[r[good] - k * rows, c[good]] = v[good]
        return pa.table({"file": t["file"][:1], "strip": t["strip"][:1], "data": pa.array([zlib.compress(a.tobytes())], pa.binary())})

    def whole(t: pa.Table) -> pa.Table:
        g = Geo(**{k: t[k][0].as_py() for k in ("nx", "ny", "x0", "y0", "dx", "dy", "epsg")})
        order = np.argsort(t["strip"].to_numpy())
        data = [t["data"][int(k)].as_py() for k in order]
        file = t["file"][0].as_py()
        fs, at = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}" if not folder.startswith("file:") else "file://" + folder.removeprefix("file:"))
        fs.create_dir(at, recursive=True)
        path, temporary = f"{at}/{file}", f"{at}/.{file}.{os.getpid()}.{os.urandom(4).hex()}"
        head = _head(g, rows, [len(d) for d in data])
        with fs.open_output_stream(temporary) as f:
            for d in (head, *data):
                f.write(d)
        fs.move(temporary, path)
        return pa.table({"file": t["file"][:1], "path": pa.array([path]), "bytes": pa.array([len(head) + sum(map(len, data))], pa.int64())})

    every = grids.withColumn("strip", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("ny") / rows) - 1).cast("int"))))
    given = cells.select("file", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("value").cast("double").alias("value"), F.floor(F.col("r") / rows).cast("int").alias("strip"))
    # a strip without cells has a row without a value, so that it is written too
    none = every.select("file", (F.col("strip") * rows).alias("r"), F.lit(0).alias("c"), F.lit(None).cast("double").alias("value"), "strip")
    both = given.unionByName(none).join(grids.select("file", "nx", "ny"), "file").filter("r < ny AND c < nx AND r >= 0 AND c >= 0")
    strips = both.groupBy("file", "strip").applyInArrow(strip, "file string, strip int, data binary")
    return strips.join(grids, "file").groupBy("file").applyInArrow(whole, "file string, path string, bytes bigint")


def mask_of(values: DataFrame, info: DataFrame, ground: Geo) -> DataFrame:
    """(file, r, c) of the cells of mask files that have a value other than 0. A mask that isn't on the ground's grid is refused."""
    off = info.filter(
        (F.col("nx") != ground.nx) | (F.col("ny") != ground.ny) | (F.abs(F.col("x0") - ground.x0) > 1e-6 * ground.dx) | (F.abs(F.col("y0") - ground.y0) > 1e-6 * ground.dy) | (F.abs(F.col("dx") - ground.dx) > 1e-9 * ground.dx) | (F.abs(F.col("dy") - ground.dy) > 1e-9 * ground.dy)
    )
    if bad := off.select("file").first():
        raise BadRaster(f"{bad[0]}: the mask isn't on the ground's grid")
    return values.filter("value IS NOT NULL AND value != 0").select("file", "r", "c")
