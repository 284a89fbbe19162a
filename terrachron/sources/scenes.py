"""Scene catalogues, file names, tile ids, pixel grids and date sidecars."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cubes import r4, raster, sql4, table

#: Public STAC catalogues by name.
CATALOGUES = {
    "planetary_computer": "https://planetarycomputer.microsoft.com/api/stac/v1",
    "earth_search": "https://earth-search.aws.element84.com/v1",
    "brazil_data_cube": "https://data.inpe.br/bdc/stac/v1",
}


def search(scenes: DataFrame, *, start: str, end: str, cloud_cover_max: float = 30, bbox: tuple[float, float, float, float] | None = None, tiles: list[str] | None = None) -> DataFrame:
    """Scenes of a manifest (t, cloud_cover, tile, west, south, east, north): all conditions are pushed to its scan."""
    if bbox is None and not tiles:
        raise ValueError("an area of interest is needed: bbox or tiles")
    out = scenes.where(F.col("t").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud_cover") <= cloud_cover_max))
    if tiles:
        out = out.where(F.col("tile").isin(tiles))
    if bbox:
        w, s, e, n = check_bbox(bbox)
        out = out.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    return out


def path_row(path: Column, row: Column) -> Column:
    """The six digits of a Landsat path and row."""
    return F.concat(F.lpad(path.cast("string"), 3, "0"), F.lpad(row.cast("string"), 3, "0"))


def with_token(href: Column, token: str) -> Column:
    return F.concat(href, F.when(href.contains("?"), "&").otherwise("?"), F.lit(f"access_token={token}"))


def parse_name(name: Column, pattern: str = r"(?P<band>[A-Za-z0-9]+)?_?(?P<date>\d{8})", date_format: str = "yyyyMMdd") -> tuple[Column, Column]:
    """(date, band) from a file name by a pattern with the groups date and, if wanted, band (default 'value')."""
    groups = re.compile(pattern).groupindex
    java = re.sub(r"\(\?P<", "(?<", pattern)
    date = F.to_date(F.try_to_timestamp(F.regexp_extract(name, java, groups["date"]), F.lit(date_format)))
    band = F.regexp_extract(name, java, groups["band"]) if "band" in groups else F.lit("")
    return date, F.when(band != "", band).otherwise("value")


def local_archive(spark: SparkSession, path: str, pattern: str, date_format: str = "yyyyMMdd") -> DataFrame:
    """obs of a folder of parquet rasters (y, x, v), one file a date and band, named as in parse_name."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    t, band = parse_name(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, date_format)
    return df.select(t.alias("t"), band.alias("band"), "y", "x", "v")


def wrs2(tile: Column) -> tuple[Column, Column]:
    """Path and row of a WRS-2 id (path 1-233, row 1-248), null if it is none."""
    p = F.regexp_extract(tile, r"^\s*(\d{1,3})[/_\-]?(\d{3})\s*$", 1)
    r = F.regexp_extract(tile, r"^\s*(\d{1,3})[/_\-]?(\d{3})\s*$", 2)
    p, r = F.when(p != "", p.cast("int")), F.when(r != "", r.cast("int"))
    ok = p.between(1, 233) & r.between(1, 248)
    return F.when(ok, p), F.when(ok, r)


#: Letters of the MGRS grid: latitude bands, columns (by zone modulo 3) and rows.
_BANDS, _ROWS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUV"
_COLUMNS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")
_MGRS = r"^\s*(?i:T)?(\d{1,2})([C-HJ-NP-X])([A-HJ-NP-Z])([A-HJ-NP-V])\s*$"


def mgrs(tile: Column) -> tuple[Column, Column, Column]:
    """Zone (1-60), band and 100 km square of an MGRS tile id such as T18LWK, null if it is none."""
    up = F.upper(tile)
    part = lambda k: F.regexp_extract(up, _MGRS.replace("(?i:T)", "T"), k)
    zone = F.when(part(1) != "", part(1).cast("int"))
    ok = zone.between(1, 60)
    return F.when(ok, zone), F.when(ok, part(2)), F.when(ok, F.concat(part(3), part(4)))


def tile_utm_bounds(tile: str, extent: float = 109_800.0) -> tuple[int, float, float, float, float]:
    """EPSG code and west, south, east, north in metres of a tile: its square's north-west corner and the extent (a scene
    of 10,980 pixels of 10 m overlaps its neighbours)."""
    m = re.match(_MGRS, tile.upper().replace("(?i:T)", "T"), re.I)
    if not m or not 1 <= int(m[1]) <= 60:
        raise ValueError(f"{tile!r} is no MGRS tile")
    zone, band, col, row = int(m[1]), m[2].upper(), m[3].upper(), m[4].upper()
    letters = _COLUMNS[zone % 3]
    if col not in letters:
        raise ValueError(f"{tile!r}: zone {zone} has no column {col}")
    west = (letters.index(col) + 1) * 100_000.0
    # rows repeat every 2,000 km and are shifted by five letters in even zones; the band's middle tells which cycle
    north_half = band >= "N"
    lat = -80 + 8 * _BANDS.index(band) + (6 if band == "X" else 4)
    near = utm_from_lonlat(6 * zone - 183, lat)[1] + (0 if north_half else 10_000_000.0)
    low = (_ROWS.index(row) - (5 if zone % 2 == 0 else 0)) % 20 * 100_000.0
    south = low + round((near - low - 50_000) / 2_000_000) * 2_000_000.0
    north = south + 100_000.0
    return (32_600 if north_half else 32_700) + zone, west, north - extent, west + extent, north


_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of Krueger's series in the third flattening, forward and back."""
    n = _F / (2 - _F)
    r = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    b = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return r, a, b


def utm_from_lonlat(lon: float, lat: float, zone: int | None = None) -> tuple[float, float]:
    """Easting and northing (south: negative) on the WGS 84 ellipsoid."""
    zone = zone or int((lon + 180) // 6) + 1
    r, a, _ = _series()
    e = math.sqrt(_F * (2 - _F))
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(c * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, c in enumerate(a, 1))
    y = xi + sum(c * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, c in enumerate(a, 1))
    return 500_000 + _K0 * r * x, _K0 * r * y


def lonlat_from_utm(east: float, north: float, zone: int) -> tuple[float, float]:
    """The way back; north is negative in the south."""
    r, _, b = _series()
    e2 = _F * (2 - _F)
    xi, eta = north / (_K0 * r), (east - 500_000) / (_K0 * r)
    x = xi - sum(c * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, c in enumerate(b, 1))
    y = eta - sum(c * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, c in enumerate(b, 1))
    chi = math.asin(math.sin(x) / math.cosh(y))
    phi = chi
    for _ in range(8):  # conformal to geodetic latitude
        phi = math.asin(math.tanh(math.atanh(math.sin(chi)) + math.sqrt(e2) * math.atanh(math.sqrt(e2) * math.sin(phi))))
    return 6 * zone - 183 + math.degrees(math.atan2(math.sinh(y), math.cos(x))), math.degrees(phi)


def tile_bounds(tile: str) -> tuple[float, float, float, float]:
    """West, south, east, north in degrees of a tile's corners."""
    epsg, w, s, e, n = tile_utm_bounds(tile)
    zone, shift = epsg % 100, 0.0 if epsg < 32_700 else 10_000_000.0
    at = [lonlat_from_utm(x, y - shift, zone) for x in (w, e) for y in (s, n)]
    lon, lat = zip(*at)
    return min(lon), min(lat), max(lon), max(lat)


def area(of: str | tuple | list) -> tuple[float, float, float, float]:
    """West, south, east, north of an area of interest: a bbox, a WKT polygon or point list, or one or several MGRS tiles."""
    if isinstance(of, str) and re.match(r"\s*(MULTI)?POLYGON", of, re.I):
        numbers = [tuple(map(float, p)) for p in re.findall(r"(-?[\d.]+(?:[eE]-?\d+)?)\s+(-?[\d.]+(?:[eE]-?\d+)?)", of)]
        lon, lat = zip(*numbers)
        return check_bbox((min(lon), min(lat), max(lon), max(lat)))
    if isinstance(of, str):
        return tile_bounds(of)
    if len(of) == 4 and all(isinstance(x, (int, float)) for x in of):
        return check_bbox(tuple(of))
    if of and all(isinstance(x, str) for x in of):
        each = [tile_bounds(x) for x in of]
        return min(b[0] for b in each), min(b[1] for b in each), max(b[2] for b in each), max(b[3] for b in each)
    raise ValueError("an area is a bbox, a polygon in WKT, or MGRS tiles")


def pixel_grid(low: Column, high: Column, res: float, eps: float = 1e-6) -> tuple[Column, Column]:
    """Bounds snapped outward to whole multiples of the resolution; a millionth of a pixel is rounding."""
    return F.floor(low / res + eps) * res, F.ceil(high / res - eps) * res


def check_bbox(b: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    w, s, e, n = map(float, b)
    if not (w < e and s < n):
        raise ValueError("a bbox is west, south, east, north")
    return w, s, e, n


def tile_shape(height: int, width: int, bands: int, item_bytes: int, budget: int) -> tuple[int, int, int]:
    """Largest (rows, cols, bands) under a budget of bytes: space is cut first, then bands."""
    side = math.isqrt(max(1, budget // (item_bytes * bands)))
    if side >= 1 and item_bytes * bands <= budget:
        rows, cols = min(height, side), min(width, side)
        cols = min(width, max(cols, budget // (item_bytes * bands * rows)))
        rows = min(height, max(rows, budget // (item_bytes * bands * cols)))
        return rows, cols, bands
    return 1, 1, max(1, min(bands, budget // item_bytes))


def georef(cells: DataFrame) -> DataFrame:
    """(x0, y0, dx, dy) of coordinates x, y of a regular raster: its corner and steps."""
    a = cells.select("x").distinct()
    b = cells.select("y").distinct()

    def step(df: DataFrame, c: str) -> DataFrame:
        s = F.array_sort(F.collect_list(c))
        return df.agg(F.get(s, F.lit(0)).alias("lo"), F.element_at(s, -1).alias("hi"), F.count(F.lit(1)).alias("n"))

    x, y = step(a, "x"), step(b, "y")
    d = lambda p: (F.col(f"{p}.hi") - F.col(f"{p}.lo")) / F.greatest(F.col(f"{p}.n") - 1, F.lit(1))
    j = x.alias("a").join(y.alias("b"))  # one row each
    return j.select((F.col("a.lo") - d("a") / 2).alias("x0"), (F.col("b.hi") + d("b") / 2).alias("y0"), d("a").alias("dx"), (-d("b")).alias("dy"))


def date_sidecar(obs: DataFrame) -> DataFrame:
    """(date, fractional_year, ordinal_day) of the cube's times."""
    t = obs.select("t").distinct()
    days = F.when(F.dayofmonth(F.last_day(F.make_date(F.year("t"), F.lit(2), F.lit(1)))) == 29, 366.0).otherwise(365.0)
    return t.select(F.col("t").alias("date"), (F.year("t") + (F.dayofyear("t") - 1) / days).alias("fractional_year"), (F.datediff("t", F.lit("0001-01-01").cast("date")) + 1).alias("ordinal_day"))


def advise(obs: DataFrame) -> DataFrame:
    """(steps, low, high, warning): what a raster is fit for."""
    a = obs.agg(F.countDistinct("t").alias("steps"), F.min("v").alias("low"), F.max("v").alias("high"))
    return a.withColumn("warning", F.when(F.col("steps") < 3, "too few steps for trajectories").when(F.col("steps") < 12, "too few steps for harmonic models").when(F.abs("high") <= 1, "values look unscaled"))


# ---- queries


def q_path_row(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", path_row(F.col("s_suppkey") % 233 + 1, F.col("s_suppkey") % 7 + 60).alias("tile"))
    return s.where(F.col("tile").isin("005064", "010062", "100060", "003062"))


def q_names(spark, d):
    n = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_"))).otherwise(""), F.date_format("ts", "yyyyMMdd"), F.lit(".tif")).alias("n"))
    t, b = parse_name(F.col("n"), r"(?:(?P<band>[a-z]+)_)?(?P<date>\d{8})")
    return n.select("event_id", t.alias("t"), b.alias("band"))


def q_wrs2(spark, d):
    p, r = wrs2(F.concat((F.col("p_partkey") % 260).cast("string"), F.lit("_"), F.lpad((F.col("p_partkey") % 300).cast("string"), 3, "0")))
    return table(spark, d, "part").select("p_partkey", p.alias("path"), r.alias("row"))


def q_grid(spark, d):
    lo, hi = pixel_grid(F.col("s_acctbal"), F.col("s_acctbal") + 77.5, 30.0)
    return table(spark, d, "supplier").select("s_suppkey", lo.alias("low"), hi.alias("high"))


def q_georef(spark, d):
    return georef(raster(spark, d).select((F.col("x") * 30.0 + 500).alias("x"), (9000 - F.col("y") * 30.0).alias("y")))


def q_sidecar(spark, d):
    s = date_sidecar(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("t")))
    return s.select("date", r4(F.col("fractional_year")).alias("fractional_year"), "ordinal_day")


def q_advise(spark, d):
    from .cubes import annual

    return advise(annual(spark, d))


def q_token(spark, d):
    return table(spark, d, "pages").select("page_id", with_token(F.coalesce("url", F.lit("")), "k").alias("href"))


def q_search(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("t"), (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"), (F.col("o_custkey") % 360 - 180).cast("double").alias("west"), (F.col("o_orderkey") % 160 - 80).cast("double").alias("south"))
    s = s.withColumn("east", F.col("west") + 2).withColumn("north", F.col("south") + 2).withColumn("tile", path_row(F.col("o_custkey") % 233 + 1, F.lit(60)))
    return search(s, start="1996-01-01", end="1997-06-30", bbox=(-75.0, -60.0, 20.0, 30.0)).select("o_orderkey", "t", "cloud_cover")


def q_mgrs(spark, d):
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = lambda c, k: F.substring(letters, F.col("p_partkey") * k % 26 + 1, F.lit(1))
    tile = F.concat(F.when(F.col("p_partkey") % 2 == 0, "T").otherwise(""), (F.col("p_partkey") % 70).cast("string"), at(0, 3), at(0, 5), at(0, 7))
    zone, band, square = mgrs(tile)
    return table(spark, d, "part").select("p_partkey", zone.alias("zone"), band.alias("band"), square.alias("square"))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(p_partkey * {k} % 26 + 1 AS INTEGER), 1)"
_GOOD = "p_partkey % 70 BETWEEN 1 AND 60 AND b >= 'C' AND b <= 'X' AND b NOT IN ('I', 'O') AND c NOT IN ('I', 'O') AND r <= 'V' AND r NOT IN ('I', 'O')"
QUERIES = {
    "scene_search": (q_search, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t, CAST(o_custkey % 100 AS DOUBLE) AS cloud_cover FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND o_custkey % 100 <= 30 AND o_custkey % 360 - 180 BETWEEN -77 AND 20 AND o_orderkey % 160 - 80 BETWEEN -62 AND 30"),
    "tile_mgrs": (q_mgrs, f"WITH p AS (SELECT p_partkey, {_LETTER.format(k=3)} AS b, {_LETTER.format(k=5)} AS c, {_LETTER.format(k=7)} AS r FROM part) SELECT p_partkey, CASE WHEN {_GOOD} THEN CAST(p_partkey % 70 AS INTEGER) END AS zone, CASE WHEN {_GOOD} THEN b END AS band, CASE WHEN {_GOOD} THEN c || r END AS square FROM p"),
    "scene_path_row": (q_path_row, "SELECT s_suppkey, lpad(CAST(s_suppkey % 233 + 1 AS VARCHAR), 3, '0') || lpad(CAST(s_suppkey % 7 + 60 AS VARCHAR), 3, '0') AS tile FROM supplier WHERE tile IN ('005064', '010062', '100060', '003062')"),
    "scene_names": (q_names, "SELECT event_id, CAST(ts AS DATE) AS t, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'value' END AS band FROM events"),
    "scene_token": (q_token, "SELECT page_id, coalesce(url, '') || CASE WHEN contains(coalesce(url, ''), '?') THEN '&' ELSE '?' END || 'access_token=k' AS href FROM pages"),
    "tile_wrs2": (q_wrs2, "WITH p AS (SELECT p_partkey, CAST(p_partkey % 260 AS INTEGER) AS p, CAST(p_partkey % 300 AS INTEGER) AS r FROM part) SELECT p_partkey, CASE WHEN p BETWEEN 1 AND 233 AND r BETWEEN 1 AND 248 THEN p END AS path, CASE WHEN p BETWEEN 1 AND 233 AND r BETWEEN 1 AND 248 THEN r END AS row FROM p"),
    "pixel_grid": (q_grid, "SELECT s_suppkey, floor(s_acctbal / 30.0 + 1e-6) * 30.0 AS low, ceil((s_acctbal + 77.5) / 30.0 - 1e-6) * 30.0 AS high FROM supplier"),
    "georef": (q_georef, "WITH r AS (SELECT p_partkey % 50 * 30.0 + 500 AS x, 9000 - p_partkey // 50 * 30.0 AS y FROM part) SELECT CAST(min(x) - 15 AS DOUBLE) AS x0, CAST(max(y) + 15 AS DOUBLE) AS y0, CAST(30.0 AS DOUBLE) AS dx, CAST(-30.0 AS DOUBLE) AS dy FROM r"),
    "date_sidecar": (q_sidecar, f"WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders) SELECT t AS date, {sql4('year(t) + (dayofyear(t) - 1) / CASE WHEN day(last_day(make_date(year(t), 2, 1))) = 29 THEN 366.0 ELSE 365.0 END')} AS fractional_year, CAST(date_diff('day', DATE '0001-01-01', t) + 1 AS INTEGER) AS ordinal_day FROM t"),
    "raster_check": (q_advise, "WITH a AS (SELECT l_suppkey AS pixel, year(l_shipdate) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT count(DISTINCT t) AS steps, min(v) AS low, max(v) AS high, CASE WHEN count(DISTINCT t) < 3 THEN 'too few steps for trajectories' WHEN count(DISTINCT t) < 12 THEN 'too few steps for harmonic models' WHEN abs(max(v)) <= 1 THEN 'values look unscaled' END AS warning FROM a"),
}
