from terrachron.sources.scenes import check_bbox, search, tile_shape
from terrachron.sources.sinks import outlines, write_sidecar, write_tiles


def test_tiles_and_sidecar(spark, tmp_path):
    cells = spark.createDataFrame([(y, x, float(y * x)) for y in range(10) for x in range(10)], "y int, x int, v double")
    write_tiles(cells, str(tmp_path / "t"), 4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 100 and back.select("tile_y", "tile_x").distinct().count() == 9
    obs = spark.sql("select 1 pixel, date'2020-02-29' t, 1.0D v union all select 2, date'2020-02-29', 2.0D")
    write_sidecar(obs, str(tmp_path / "d"))
    r = spark.read.option("header", True).csv(str(tmp_path / "d")).collect()
    assert len(r) == 1 and r[0]["date"] == "2020-02-29" and r[0]["ordinal_day"] == "737484"


def test_outlines(spark):
    lab = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, -1)], "y int, x int, segment int")
    assert outlines(lab, 0.0, 0.0, 1.0, 1.0).collect()[0]["wkt"] == "MULTIPOLYGON (((0.0 0.0, 2.0 0.0, 2.0 1.0, 0.0 1.0, 0.0 0.0)), ((0.0 1.0, 1.0 1.0, 1.0 2.0, 0.0 2.0, 0.0 1.0)))"


def test_search_needs_an_area(spark):
    import pytest

    m = spark.sql("select date'2020-01-05' t, 10.0D cloud_cover, '31TCJ' tile, 0.0D west, 0.0D south, 1.0D east, 1.0D north union all select date'2020-01-06', 80.0D, '31TCJ', 0.0D, 0.0D, 1.0D, 1.0D")
    with pytest.raises(ValueError):
        search(m, start="2020-01-01", end="2020-12-31")
    assert search(m, start="2020-01-01", end="2020-12-31", bbox=(0.5, 0.5, 2, 2)).count() == 1
    assert search(m, start="2020-01-01", end="2020-12-31", tiles=["x"]).count() == 0
    with pytest.raises(ValueError):
        check_bbox((1, 0, 0, 1))


def test_tiles_fit_their_budget():
    for h, w, b, size, budget in ((5000, 3000, 6, 4, 32 << 20), (100, 100, 3, 2, 1 << 30), (10, 10, 500, 8, 1000)):
        r, c, n = tile_shape(h, w, b, size, budget)
        assert 1 <= r <= h and 1 <= c <= w and 1 <= n <= b and r * c * n * size <= budget


# ---- GeoTIFF


def test_geotiff_round_trip_and_other_layouts():
    import struct
    import zlib

    import numpy as np
    import pytest

    from terrachron.sources import geotiff

    rng = np.random.default_rng(0)
    for kind in (np.float64, np.float32, np.uint16, np.int16, np.uint8):
        a = (rng.random((3, 7, 11)) * 200).astype(kind)
        got, meta = geotiff.decode(geotiff.encode(a, x0=500.0, y0=9000.0, dx=30.0, dy=30.0, epsg=32718, nodata=-1.0))
        assert got.dtype == a.dtype and (got == a).all() and meta == {"x0": 500.0, "y0": 9000.0, "dx": 30.0, "dy": 30.0, "epsg": 32718, "nodata": -1.0}
    # big endian, tiled, planes together, horizontal differences, uncompressed or deflated; made by hand
    a = rng.integers(0, 1000, (2, 20, 36)).astype(np.uint16)
    for packed in (1, 8):
        blocks = []
        for y in (0, 16):
            for x in (0, 16, 32):
                b = np.zeros((16, 16, 2), np.uint16)
                part = a[:, y : y + 16, x : x + 16].transpose(1, 2, 0)
                b[: part.shape[0], : part.shape[1]] = part
                d = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(">u2").tobytes()
                blocks.append(d if packed == 1 else zlib.compress(d))
        tags = [(256, 3, 36), (257, 3, 20), (258, 3, 16 << 16 | 16), (259, 3, packed), (277, 3, 2), (284, 3, 1), (317, 3, 2), (322, 3, 16), (323, 3, 16), (324, 4, None), (325, 4, None)]
        head = 8 + 2 + 12 * len(tags) + 4
        offsets = [head + 48 + sum(map(len, blocks[:k])) for k in range(6)]
        out = struct.pack(">2sHIH", b"MM", 42, 8, len(tags))
        for k, t, v in tags:
            if v is None:
                out += struct.pack(">HHII", k, t, 6, head + (0 if k == 324 else 24))
            elif k == 258:
                out += struct.pack(">HHII", k, t, 2, v)
            else:
                out += struct.pack(">HHIHH", k, t, 1, v, 0)
        out += b"\0\0\0\0" + struct.pack(">6I", *offsets) + struct.pack(">6I", *map(len, blocks)) + b"".join(blocks)
        assert (geotiff.decode(out)[0] == a).all()
    for bad in (b"", b"II*\0", b"nonsense", geotiff.encode(a.astype(float))[:200]):
        with pytest.raises(ValueError):
            geotiff.decode(bad)


def test_geotiff_tiles_and_damaged_files(spark, tmp_path):
    import pytest

    from terrachron.sources import geotiff

    rows = [(y, x, float(y * 100 + x), None if (y + x) % 5 == 0 else -1.0 * x) for y in range(20) for x in range(30)]
    cells = spark.createDataFrame(rows, "y int, x int, a double, b double")
    folder = str(tmp_path / "out")
    geotiff.write_tiles(geotiff.tiles(cells, ["a", "b"], size=16, x0=500.0, y0=900.0, dx=10.0, dy=10.0, epsg=4326), folder)
    got = geotiff.read_cells(spark, folder)
    at = got.selectExpr("regexp_extract(file, '([0-9]+)_[0-9]+.tif', 1) * 16 + y as y", "regexp_extract(file, '_([0-9]+).tif', 1) * 16 + x as x", "layer", "v").where("v is not null")
    back = {(int(r["y"]), int(r["x"]), r["layer"]): r["v"] for r in at.collect()}
    assert back == {(y, x, k): v for y, x, *vs in rows for k, v in enumerate(vs) if v is not None}
    meta = geotiff.decode(open(f"{folder}/1_1.tif", "rb").read())[1]
    assert meta["x0"] == 660.0 and meta["y0"] == 740.0 and meta["epsg"] == 4326
    with open(f"{folder}/9_9.tif", "wb") as f:
        f.write(b"II*\0 broken")
    assert {r["file"][-7:]: r["ok"] for r in geotiff.readable(spark, folder).collect()}["9_9.tif"] is False
    assert geotiff.read_cells(spark, folder, damaged="skip").where("v is not null").count() == len(back)
    with pytest.raises(Exception, match="TIFF"):
        geotiff.read_cells(spark, folder).count()
