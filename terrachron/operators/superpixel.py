"""Superpixels by simple non-iterative clustering (Achanta and Suesstrunk 2017), tile by tile, and seed grids.

Tiles are independent by definition, so each is a group of its own: rasters of any size spread over the cluster, and a
tile of some hundred thousand cells is what one task holds.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cubes import raster, r4


def seed_grid(spark: SparkSession, shape: tuple[int, int], spacing: float, padding: float | None = None, kind: str = "rectangular", seed: int | None = None) -> DataFrame:
    """(row, col) of seeds: rectangular, diamond, hexagonal (both with a second grid shifted by half a step) or random.

    Positions are laid out by Spark, rounded half to even, from the number of steps that fit between the paddings.
    """
    h, w = shape
    pad = spacing / 2 if padding is None else padding
    if spacing <= 1 or pad < 0 or pad >= h / 2 or pad >= w / 2:
        raise ValueError("spacing must exceed 1 and the padding must leave room")
    stretch = {"rectangular": (1.0, 1.0), "diamond": (math.sqrt(2), math.sqrt(2)), "hexagonal": (1.0, math.sqrt(3)), "random": (1.0, 1.0)}
    if kind not in stretch:
        raise ValueError(f"unknown kind {kind!r}")
    step = [spacing * s for s in stretch[kind]]
    n = [math.floor((s - 2 * pad - 1) / d) + 1 for s, d in zip(shape, step)]
    if min(n) < 1:
        raise ValueError("no seed fits")
    if kind == "random":
        inner = (round(h - 2 * pad), round(w - 2 * pad))
        idx = np.random.default_rng(seed).choice(inner[0] * inner[1], min(n[0] * n[1], inner[0] * inner[1]), replace=False)
        rows = [(int(np.rint(i % inner[0] + pad)), int(np.rint(i // inner[0] + pad))) for i in idx]
        return spark.createDataFrame([(min(r, h - 1), min(c, w - 1)) for r, c in rows], "row int, col int")

    def axis(size: int, count: int):
        a, b = pad + 1, size - pad
        i = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(i, lambda k: F.lit((a + b) / 2) if count == 1 else F.lit(a) + k * F.lit((b - a) / (count - 1)))

    base = spark.range(1).select(F.explode(axis(w, n[1])).alias("c"), F.lit(1).alias("one")).select(F.explode(axis(h, n[0])).alias("r"), "c")
    grids = base
    if kind != "rectangular":
        shifted = base.select((F.col("r") + step[0] / 2).alias("r"), (F.col("c") + step[1] / 2).alias("c"))
        grids = base.unionByName(shifted.where((F.col("r") <= h - pad) & (F.col("c") <= w - pad)))
    at = lambda x, n: F.greatest(F.least(F.bround(x).cast("int") - 1, F.lit(n - 1)), F.lit(0))
    return grids.select(at(F.col("r"), h).alias("row"), at(F.col("c"), w).alias("col"))


def grow(values: np.ndarray, seeds: np.ndarray, compactness: float) -> np.ndarray:
    """Labels (-1: no data) of cells (h, w, features): regions grow from the seeds, the nearest cell to a region's running
    mean first; ties go to what was queued first."""
    h, w, _ = values.shape
    masked = np.isnan(values).any(axis=2)
    label = np.where(masked, -1, -2)
    heap: list[tuple[float, int, int, int]] = []
    live = [k for k, (r, c) in enumerate(seeds) if not masked[r, c]]
    if not live:
        return np.full((h, w), -1)
    weight = compactness**2 * len(live) / (~masked).sum()
    order = 0
    for k in live:
        heap.append((0.0, order, int(seeds[k][0]) * w + int(seeds[k][1]), k))
        order += 1
    heapq.heapify(heap)
    flat, lab = values.reshape(h * w, -1), label.ravel()
    total = np.zeros((len(seeds), values.shape[2]))
    place = np.zeros((len(seeds), 2))
    count = np.zeros(len(seeds))
    while heap:
        _, _, i, k = heapq.heappop(heap)
        if lab[i] != -2:
            continue
        lab[i] = k
        y, x = divmod(i, w)
        total[k] += flat[i]
        place[k] += (y, x)
        count[k] += 1
        mean, cy, cx = total[k] / count[k], place[k, 0] / count[k], place[k, 1] / count[k]
        for yy, xx in ((y, x - 1), (y - 1, x), (y, x + 1), (y + 1, x)):
            j = yy * w + xx
            if 0 <= yy < h and 0 <= xx < w and lab[j] == -2:
                d = mean - flat[j]
                heapq.heappush(heap, (float(d @ d) + ((cy - yy) ** 2 + (cx - xx) ** 2) * weight, order, j, k))
                order += 1
    lab[lab == -2] = -1
    return lab.reshape(h, w)


def snic(cells: DataFrame, seeds: DataFrame, *, compactness: float = 10.0, tile: int = 512) -> DataFrame:
    """(y, x, segment) of cells (y, x, f array<double>); seeds: row, col. A segment is named by its seed's cell
    (row << 32 | col) and stays in the seed's tile; cells without a seed in reach, or with a null, get -1."""
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    a = cells.select(t("y").alias("ty"), t("x").alias("tx"), "y", "x", "f")
    s = seeds.select(F.col("row").alias("y"), F.col("col").alias("x"), F.lit(True).alias("seed")).distinct()
    a = a.join(s, ["y", "x"], "left").select("ty", "tx", "y", "x", "f", F.coalesce("seed", F.lit(False)).alias("seed"))

    def one(pdf):
        import pandas as pd

        y0, x0 = pdf["y"].min(), pdf["x"].min()
        h, w = int(pdf["y"].max() - y0 + 1), int(pdf["x"].max() - x0 + 1)
        n = max((len(f) for f in pdf["f"] if f is not None), default=1)
        grid = np.full((h, w, n), np.nan)
        yy, xx = (pdf["y"] - y0).to_numpy(int), (pdf["x"] - x0).to_numpy(int)
        for i, j, f in zip(yy, xx, pdf["f"]):
            if f is not None:
                grid[i, j] = [np.nan if v is None else v for v in f]
        own = pdf["seed"].to_numpy(bool)
        at = np.array(sorted(zip(yy[own], xx[own])), int).reshape(-1, 2)
        lab = grow(grid, at, compactness)[yy, xx]
        name = np.array([(int(r + y0) << 32) | int(c + x0) for r, c in at] + [-1], np.int64)
        return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "segment": name[lab]})

    return a.groupBy("ty", "tx").applyInPandas(one, "y int, x int, segment bigint")


def segment_statistics(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """(segment, n_pixels, row, col, mean array): sizes, centroids and means, pre-aggregated before the shuffle."""
    j = labels.where("segment >= 0").join(cells, ["y", "x"])
    c = j.groupBy("segment").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("y").alias("row"), F.avg("x").alias("col"))
    m = j.select("segment", F.posexplode("f").alias("d", "v")).groupBy("segment", "d").agg(F.avg("v").alias("m"))
    m = m.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    return c.join(m, "segment")


def _grid(kind):
    def q(spark, d):
        return seed_grid(spark, (50, 73), 10.0, None, kind)

    return q


def q_snic(spark, d):
    r = raster(spark, d)
    cells = r.select("y", "x", F.array("v", F.col("x").cast("double")).alias("f"))
    size = r.agg(F.max("y"), F.max("x")).first()
    return snic(cells, seed_grid(spark, (size[0] + 1, size[1] + 1), 8.0, 0.0), compactness=5.0)


def q_means(spark, d):
    r = raster(spark, d)
    labels = r.select("y", "x", (F.floor(F.col("y") / 5) * 100 + F.floor(F.col("x") / 5)).alias("segment"))
    s = segment_statistics(labels, r.select("y", "x", F.array("v").alias("f")))
    return s.select("segment", "n_pixels", r4(F.col("row")).alias("row"), r4(F.col("col")).alias("col"), r4(F.get("mean", F.lit(0))).alias("mean"))


def _sql(sr: float, sc: float, shift: bool) -> str:
    n = [math.floor((s - 10.0 - 1) / (10.0 * k)) + 1 for s, k in ((50, sr), (73, sc))]
    b = f"b AS (SELECT 6.0 + r.i * CAST({(45.0 - 6) / (n[0] - 1)!r} AS DOUBLE) AS r, 6.0 + c.i * CAST({(68.0 - 6) / (n[1] - 1)!r} AS DOUBLE) AS c FROM range({n[0]}) r(i), range({n[1]}) c(i))"
    g = f"SELECT * FROM b UNION ALL SELECT r + {5 * sr!r}, c + {5 * sc!r} FROM b WHERE r + {5 * sr!r} <= 45 AND c + {5 * sc!r} <= 68" if shift else "SELECT * FROM b"
    return f"WITH {b}, g AS ({g}) SELECT CAST(greatest(least(round_even(r, 0) - 1, 49), 0) AS INTEGER) AS row, CAST(greatest(least(round_even(c, 0) - 1, 72), 0) AS INTEGER) AS col FROM g"


QUERIES = {
    "snic_grid_rect": (_grid("rectangular"), _sql(1.0, 1.0, False)),
    "snic_grid_diamond": (_grid("diamond"), _sql(math.sqrt(2), math.sqrt(2), True)),
    "snic_grid_hex": (_grid("hexagonal"), _sql(1.0, math.sqrt(3), True)),
    "snic": (q_snic, None),
    "segment_means": (
        q_means,
        "WITH ras AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS y, CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_size AS DOUBLE) AS v FROM part) SELECT CAST(y // 5 * 100 + x // 5 AS BIGINT) AS segment, count(*) AS n_pixels, floor(avg(y) * 10000.0 + 0.5) / 10000.0 AS row, floor(avg(x) * 10000.0 + 0.5) / 10000.0 AS col, floor(avg(v) * 10000.0 + 0.5) / 10000.0 AS mean FROM ras GROUP BY 1",
    ),
}
