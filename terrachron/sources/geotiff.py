"""GeoTIFF files as tables: decoding and encoding in numpy, reading by Spark's binary source, writing a file a tile.

Classic TIFF (32-bit offsets), little or big endian, strips or tiles, planes together or apart, uncompressed or deflated,
with or without horizontal differencing; integers and floats. The georeference is the pixel scale with its tie point and
the code of the reference system.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF field types by number (struct code), and the tags used here.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113
_FORMATS = {1: "u", 2: "i", 3: "f"}


def encode(bands: np.ndarray, *, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, epsg: int | None = None, nodata: float | None = None) -> bytes:
    """A file of bands (band, row, column): little endian, each band one deflated strip. x0, y0: the upper left corner."""
    bands = np.ascontiguousarray(bands)
    n, h, w = bands.shape
    kind = bands.dtype
    data = [zlib.compress(b.astype(kind.newbyteorder("<")).tobytes()) for b in bands]
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (w,)), HEIGHT: (4, (h,)), BITS: (3, (kind.itemsize * 8,) * n), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)),
        STRIP_OFFSETS: (4, (0,) * n), SAMPLES: (3, (n,)), ROWS: (4, (h,)), STRIP_SIZES: (4, tuple(map(len, data))), PLANAR: (3, (2,)), FORMAT: (3, (code,) * n),
        SCALE: (12, (dx, dy, 0.0)), TIE: (12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
    }
    if epsg:
        place = 2048 if 4000 <= epsg < 5000 else 3072  # geographic or projected
        tags[KEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 2 if place == 2048 else 1, 1025, 0, 1, 1, place, 0, 1, epsg))
    if nodata is not None:
        tags[NODATA] = (2, (f"{nodata}\0".encode(),))
    first = 8 + 2 + 12 * len(tags) + 4

    def body(t: int, v: tuple) -> bytes:
        return v[0] if t == 2 else struct.pack(f"<{len(v)}{_TYPES[t]}", *v)

    sizes = {k: len(body(*tags[k])) for k in tags}
    extra = sum(s + s % 2 for s in sizes.values() if s > 4)
    at, offsets = first + extra, []
    for d in data:
        offsets.append(at)
        at += len(d)
    tags[STRIP_OFFSETS] = (4, tuple(offsets))
    entries, more, place = [], [], first
    for k in sorted(tags):
        t, v = tags[k]
        b = body(t, v)
        count = len(b) if t == 2 else len(v)
        if len(b) <= 4:
            entries.append(struct.pack("<HHI", k, t, count) + b.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", k, t, count, place))
            more.append(b + b"\0" * (len(b) % 2))
            place += len(more[-1])
    return b"".join([b"II*\0", struct.pack("<I", 8), struct.pack("<H", len(tags)), *entries, b"\0\0\0\0", *more, *data])


def _fields(raw: bytes) -> tuple[str, dict[int, tuple]]:
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    (at,) = struct.unpack_from(end + "I", raw, 4)
    out = {}
    for k in range(struct.unpack_from(end + "H", raw, at)[0]):
        tag, t, n = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
        if t not in _TYPES:
            continue
        code = f"{n}s" if t == 2 else f"{n * len(_TYPES[t])}{_TYPES[t][0]}"
        size = struct.calcsize(end + code)
        place = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(end + "I", raw, at + 2 + 12 * k + 8)[0]
        out[tag] = struct.unpack_from(end + code, raw, place)
    return end, out


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """(bands (band, row, column), what is known of x0, y0, dx, dy, epsg, nodata). Raises ValueError for other files."""
    try:
        end, f = _fields(raw)
        h, w, n = f[HEIGHT][0], f[WIDTH][0], f.get(SAMPLES, (1,))[0]
        bits, form = f.get(BITS, (1,)), f.get(FORMAT, (1,))
        if len(set(bits)) != 1 or bits[0] % 8 or form[0] not in _FORMATS:
            raise ValueError("samples of this kind are not read")
        kind = np.dtype(f"{end}{_FORMATS[form[0]]}{bits[0] // 8}")
        packed, apart = f.get(COMPRESSION, (1,))[0], f.get(PLANAR, (1,))[0] == 2 and n > 1
        if packed not in (1, 8, 32946):
            raise ValueError(f"compression {packed} is not read")
        tiled = TILE_OFFSETS in f
        bh, bw = (f[TILE_HEIGHT][0], f[TILE_WIDTH][0]) if tiled else (min(f.get(ROWS, (h,))[0], h), w)
        across, down, depth = -(-w // bw), -(-h // bh), 1 if apart else n
        out = np.zeros((n, h, w), kind.newbyteorder("="))
        blocks = zip(f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_SIZES if tiled else STRIP_SIZES])
        for k, (at, size) in enumerate(blocks):
            b = raw[at : at + size]
            band, i = divmod(k, across * down) if apart else (0, k)
            y, x = i // across * bh, i % across * bw
            rows = bh if tiled else min(bh, h - y)
            a = np.frombuffer(zlib.decompress(b) if packed != 1 else b, kind, rows * bw * depth).reshape(rows, bw, depth)
            if f.get(PREDICTOR, (1,))[0] == 2:
                a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
            part = a[: h - y, : w - x].transpose(2, 0, 1)
            out[band : band + depth, y : y + part.shape[1], x : x + part.shape[2]] = part
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"damaged TIFF: {e}") from e
    meta: dict = {}
    if SCALE in f and TIE in f:
        dx, dy = f[SCALE][:2]
        meta |= {"dx": dx, "dy": dy, "x0": f[TIE][3] - f[TIE][0] * dx, "y0": f[TIE][4] + f[TIE][1] * dy}
    keys = f.get(KEYS, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:
            meta["epsg"] = keys[k + 3]
    if NODATA in f:
        meta["nodata"] = float(f[NODATA][0].split(b"\0")[0])
    return out, meta


def read_cells(spark: SparkSession, path: str, *, damaged: str = "raise", glob: str = "*.tif") -> DataFrame:
    """(file, layer, y, x, v) of the files under a folder, layers from 0; nodata and NaN are null.

    A file is decoded by one task, so it must fit in it. damaged: `raise`, or `skip` files that can't be read.
    """
    if damaged not in ("raise", "skip"):
        raise ValueError("damaged is raise or skip")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    bands, meta = decode(raw.as_py())
                except ValueError:
                    if damaged == "raise":
                        raise
                    continue
                h, w = bands.shape[1:]
                for k, b in enumerate(bands):
                    for y in range(0, h, max(1, 500_000 // w)):
                        part = b[y : y + max(1, 500_000 // w)].astype(float)
                        yy, xx = np.indices(part.shape).reshape(2, -1)
                        v = part.ravel()
                        none = np.isnan(v) | (v == meta["nodata"] if "nodata" in meta else False)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * v.size), pa.array(np.full(v.size, k, np.int32)), pa.array((yy + y).astype(np.int32)), pa.array(xx.astype(np.int32)), pa.array(v, mask=none)],
                            names=["file", "layer", "y", "x", "v"],
                        )

    return files.mapInArrow(cells, "file string, layer int, y int, x int, v double")


def readable(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """(file, ok): which files can be decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            good = []
            for raw in batch.column(1):
                try:
                    decode(raw.as_py())
                    good.append(True)
                except ValueError:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_())], names=["file", "ok"])

    return files.mapInArrow(probe, "file string, ok boolean")


def tiles(cells: DataFrame, layers: list[str], *, size: int = 512, nodata: float = -9999.0, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, epsg: int | None = None) -> DataFrame:
    """(tile_y, tile_x, content): a GeoTIFF for each tile of cells (y, x, layers..), a band a layer; what is missing is
    nodata. x0, y0: the raster's upper left corner."""

    def one(key, pdf):
        import pandas as pd

        ty, tx = (int(k) for k in key)
        a = np.full((len(layers), size, size), nodata)
        yy, xx = pdf["y"].to_numpy(int) - ty * size, pdf["x"].to_numpy(int) - tx * size
        for k, c in enumerate(layers):
            v = pdf[c].to_numpy(float)
            a[k, yy, xx] = np.where(np.isnan(v), nodata, v)
        raw = encode(a, x0=x0 + tx * size * dx, y0=y0 - ty * size * dy, dx=dx, dy=dy, epsg=epsg, nodata=nodata)
        return pd.DataFrame({"tile_y": [ty], "tile_x": [tx], "content": [raw]})

    own = cells.select(F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx"), "y", "x", *[F.col(c).cast("double").alias(c) for c in layers])
    return own.groupBy("ty", "tx").applyInPandas(one, "tile_y int, tile_x int, content binary")


def write_tiles(files: DataFrame, folder: str) -> None:
    """Write (tile_y, tile_x, content) as files `y_x.tif` of a folder that all workers see; a file appears whole or not
    at all, and a task that runs again writes the same."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, f"{r['tile_y']}_{r['tile_x']}.tif")
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(r["content"])
            os.replace(f.name, path)

    files.foreachPartition(save)
