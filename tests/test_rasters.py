"""Raster files: round trips, windows, encodings that others write, refusals."""

import struct
import zlib

import numpy as np
import pytest

from rillwork.sources import rasters


def lzw_coded(data):
    table, out, held, word, n = {bytes([k]): k for k in range(256)}, 0, 0, b"", 258
    codes = [(256, 9)]
    width = lambda: 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        codes.append((table[word], width()))
        table[more], n = n, n + 1
        if n >= 4094:
            codes.append((256, width()))
            table, n = {bytes([k]): k for k in range(256)}, 258
        word = data[k : k + 1]
    codes += [(table[word], width())]
    n += 1
    codes += [(257, width())]
    for c, w in codes:
        out, held = out << w | c, held + w
    pad = -held % 8
    return (out << pad).to_bytes((held + pad) // 8, "big")


def tiff(order, tags, blocks):
    """A file of (tag, type letter, values); "blocks" stands for the places of the blocks."""
    codes = {v: k for k, v in rasters.TYPES.items()}
    end, more, head, starts = 10 + 12 * len(tags) + 4, b"", b"", []
    body = end + 4096
    for b in blocks:
        starts.append(body)
        body += len(b)
    for tag, kind, v in tags:
        v = starts if v == "blocks" else v
        raw = struct.pack(f"{order}{len(v)}{kind}", *v)
        if len(raw) > 4:
            at, more = end + len(more), more + raw
            raw = struct.pack(order + "I", at)
        head += struct.pack(order + "HHI", tag, codes[kind], len(v)) + raw.ljust(4, b"\0")
    start = struct.pack(order + "2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(tags)) + head + struct.pack(order + "I", 0) + more
    return start.ljust(10 + 12 * len(tags) + 4 + 4096, b"\0") + b"".join(blocks)


PLACE = [(rasters.SCALE, "d", [2.0, 2.0, 0.0]), (rasters.TIE, "d", [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]


def cells(spark, path, window=None):
    return {(r.r, r.c): r.value for r in rasters.read_raster(spark, path, window).collect()}


def test_round_trip_and_windows(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = {"a.tif": rng.random((150, 37)).astype(np.float32), "b.tif": rng.random((3, 5)).astype(np.float32)}
    rows = [(f, i, j, float(v[i, j])) for f, v in values.items() for i in range(v.shape[0]) for j in range(v.shape[1]) if (i, j) != (1, 2) and i != 140]
    grids = spark.createDataFrame([(f, v.shape[1], v.shape[0], 10.0, 90.0, 2.0, 3.0, 32632) for f, v in values.items()], "file string, nx int, ny int, x0 double, y0 double, dx double, dy double, epsg int")
    table = spark.createDataFrame([*rows, ("a.tif", 1, 2, None), ("a.tif", 999, 0, 1.0)], "file string, r int, c int, value double")
    written = rasters.write_raster(table, grids, str(tmp_path / "out"), rows=16).collect()
    assert sorted(r.file for r in written) == ["a.tif", "b.tif"]
    got = cells(spark, str(tmp_path / "out" / "a.tif"))
    assert len(got) == 150 * 37 and got[1, 2] is None and got[140, 5] is None
    assert all(got[i, j] == v for f, i, j, v in rows if f == "a.tif")
    part = cells(spark, str(tmp_path / "out" / "a.tif"), (14, 35, 3, 9))
    assert part == {k: v for k, v in got.items() if 14 <= k[0] < 35 and 3 <= k[1] < 9}
    info = {r.file.rsplit("/", 1)[1]: r for r in rasters.raster_info(spark, str(tmp_path / "out")).collect()}
    assert tuple(info["b.tif"])[1:] == (5, 3, 10.0, 90.0, 2.0, 3.0, 32632, 1, False, -9999.0, 8)
    geo = rasters.Geo(37, 150, 10.0, 90.0, 2.0, 3.0)
    one = str(tmp_path / "out" / "a.tif")
    mask = rasters.mask_of(rasters.read_raster(spark, one), rasters.raster_info(spark, one), geo)
    assert mask.count() == sum(1 for f, *_, v in rows if f == "a.tif" and v != 0)
    with pytest.raises(rasters.BadRaster, match="grid"):
        rasters.mask_of(rasters.read_raster(spark, one), rasters.raster_info(spark, one), rasters.Geo(37, 150, 10.5, 90.0, 2.0, 3.0))


def test_files_of_other_writers(spark, tmp_path):
    a = (np.arange(40 * 30).reshape(40, 30) * 7 % 250).astype(">u2")
    strips = [lzw_coded(a[i : i + 16].tobytes()) for i in range(0, 40, 16)]
    common = [(rasters.WIDTH, "H", [30]), (rasters.HEIGHT, "H", [40]), (rasters.BITS, "H", [16])]
    keys = [1, 1, 0, 2, rasters.RASTER_TYPE, 0, 1, 2, rasters.MODEL_TYPE, 0, 1, 2]
    (tmp_path / "lzw.tif").write_bytes(tiff(">", [*common, (rasters.COMPRESSION, "H", [5]), (rasters.OFFSETS, "I", "blocks"), (rasters.ROWS, "H", [16]), (rasters.COUNTS, "I", [len(s) for s in strips]), *PLACE, (rasters.GEO_KEYS, "H", keys), (rasters.NODATA, "c", [b"7", b"\0"])], strips))
    got = cells(spark, str(tmp_path / "lzw.tif"))
    assert all(got[i, j] == (None if a[i, j] == 7 else a[i, j]) for i in range(40) for j in range(30))
    info = rasters.raster_info(spark, str(tmp_path / "lzw.tif")).first()
    assert (info.x0, info.y0, info.model, info.point) == (99.0, 201.0, 2, True)
    b = (a.astype("<i4") - 100).astype("<i4")
    blocks = []
    for i in range(0, 40, 16):
        for j in range(0, 30, 16):
            t = np.zeros((16, 16), "<i4")
            t[: min(16, 40 - i), : min(16, 30 - j)] = b[i : i + 16, j : j + 16]
            t[:, 1:] = t[:, 1:] - t[:, :-1]
            blocks.append(zlib.compress(t.tobytes()))
    tiled = [(rasters.BITS, "H", [32]), (rasters.COMPRESSION, "H", [8]), (rasters.PREDICTOR, "H", [2]), (rasters.TILE_WIDTH, "H", [16]), (rasters.TILE_HEIGHT, "H", [16]), (rasters.TILE_OFFSETS, "I", "blocks"), (rasters.TILE_COUNTS, "I", [len(s) for s in blocks]), (rasters.FORMAT, "H", [2])]
    (tmp_path / "tiled.tif").write_bytes(tiff("<", [*common[:2], *tiled, *PLACE], blocks))
    got = cells(spark, str(tmp_path / "tiled.tif"))
    assert len(got) == 1200 and all(got[i, j] == b[i, j] for i in range(40) for j in range(30))
    assert set(cells(spark, str(tmp_path / "tiled.tif"), (15, 17, 15, 17))) == {(15, 15), (15, 16), (16, 15), (16, 16)}


@pytest.mark.parametrize(("change", "says"), [({rasters.SAMPLES: 3}, "single band"), ({rasters.COMPRESSION: 7}, "compression 7"), ({rasters.BITS: 64}, "64 bits"), ({rasters.SCALE: None}, "georeferencing"), ({rasters.SCALE: None, rasters.TRANSFORM: 1}, "rotated")])
def test_what_is_not_read_is_named(change, says):
    tags = {rasters.WIDTH: ("H", [1]), rasters.HEIGHT: ("H", [1]), rasters.BITS: ("H", [8]), rasters.OFFSETS: ("I", "blocks"), rasters.COUNTS: ("I", [1])} | {t: (k, v) for t, k, v in PLACE}
    for t, v in change.items():
        if v is None:
            del tags[t]
        else:
            tags[t] = ("d", [0.0] * 16) if t == rasters.TRANSFORM else ("H", [v])
    with pytest.raises(rasters.BadRaster, match=says):
        rasters.header("x", tiff("<", [(t, k, v) for t, (k, v) in tags.items()], [b"\0"]))
    with pytest.raises(rasters.BadRaster, match="TIFF"):
        rasters.header("x", b"no")
