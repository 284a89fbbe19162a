"""Neighbourhood filters, patches, chips and accuracy on rasters.

A neighbourhood is made by sending each cell to the cells that need it (with the border reflected), so a filter is one
shuffle on the target cell with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cubes import RASTER, r4, raster, sql4, table


def _size(cells: DataFrame) -> tuple[int, int]:
    r = cells.agg(F.max("y"), F.max("x")).first()
    return (r[0] or 0) + 1, (r[1] or 0) + 1


def _targets(c: Column, n: int, half: int) -> Column:
    """The coordinates whose reflected window holds c, each as often as it does."""
    offsets = F.sequence(F.lit(-half), F.lit(half))

    def reflected(p: Column) -> Column:
        return F.when(p < 0, -p - 1).when(p >= n, 2 * n - 1 - p).otherwise(p)

    near = F.sequence(F.greatest(c - half, F.lit(0)), F.least(c + half, F.lit(n - 1)))
    hits = F.transform(near, lambda t: F.filter(F.transform(offsets, lambda o: F.when(reflected(t + o) == c, t)), lambda x: x.isNotNull()))
    return F.flatten(hits)


def neighbours(cells: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """(y, x, other columns): each cell's columns at every cell whose window (size by size, edges reflected) holds it."""
    half = size // 2
    rest = [c for c in cells.columns if c not in ("y", "x")]
    down = cells.select(F.explode(_targets(F.col("y"), shape[0], half)).alias("y"), "x", *rest)
    return down.select("y", F.explode(_targets(F.col("x"), shape[1], half)).alias("x"), *rest)


def majority(cells: DataFrame, size: int = 3) -> DataFrame:
    """The most frequent value of each window; the smallest wins ties."""
    n = neighbours(cells.select("y", "x", "v"), size, _size(cells)).groupBy("y", "x", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("y", "x").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("v"))


def bayesian(probs: DataFrame, size: int = 3) -> DataFrame:
    """(y, x, c): of probs (y, x, c, p) the class with the largest p times the window's mean of p; first wins ties."""
    means = neighbours(probs.select("y", "x", "c", "p"), size, _size(probs)).groupBy("y", "x", "c").agg(F.avg("p").alias("m"))
    s = probs.join(means, ["y", "x", "c"]).select("y", "x", "c", (F.col("p") * F.col("m")).alias("s"))
    return s.groupBy("y", "x").agg(F.min_by("c", F.struct((-F.col("s")).alias("s"), "c")).alias("c"))


def patches_of(cells: DataFrame, nodata: float = 0.0, max_rounds: int = 200) -> DataFrame:
    """(y, x, patch): four-connected patches of cells other than nodata, named by their least cell.

    Runs within rows are found by windows; touching runs of neighbouring rows are joined by star contraction, each
    round a checkpointed table, so any shape of patch takes logarithmically many rounds.
    """
    from pyspark.sql import Window

    from ..functions.graphs import connected

    live = cells.where((F.col("v") != nodata) & F.col("v").isNotNull()).select("y", "x")
    w = Window.partitionBy("y").orderBy("x")
    run = live.withColumn("g", F.col("x") - F.row_number().over(w))
    runs = run.groupBy("y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # rows and columns are 32-bit integers, so each run has a name of its own
    runs = runs.withColumn("id", F.shiftleft(F.col("y").cast("long"), 32) + F.col("a"))
    cell = run.join(runs, ["y", "g"]).select("y", "x", "id")
    below = cell.select((F.col("y") + 1).alias("y"), "x", F.col("id").alias("up"))
    edges = cell.join(below, ["y", "x"]).select(F.col("id").alias("a"), F.col("up").alias("b")).distinct()
    root = connected(edges, max_rounds)
    return cell.join(root, cell.id == root.node, "left").select("y", "x", F.coalesce("root", "id").alias("patch"))


def minimum_mapping_unit(cells: DataFrame, pixels: int = 11, nodata: float = 0.0) -> DataFrame:
    """Patches of fewer cells become nodata."""
    p = patches_of(cells, nodata)
    small = p.groupBy("patch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < pixels)
    gone = p.join(small, "patch", "left_semi").select("y", "x", F.lit(True).alias("gone"))
    out = cells.join(gone, ["y", "x"], "left")
    return out.select("y", "x", F.when(F.col("gone"), F.lit(nodata)).otherwise(F.col("v")).alias("v"))


def patches(cells: DataFrame, size: int, stride: int) -> DataFrame:
    """(patch_y, patch_x, y, x, v): whole patches only, null as 0; y and x within the patch."""
    h, w = _size(cells)

    def starts(c: Column, n: int) -> Column:
        first = F.greatest(F.ceil((c - size + 1) / stride), F.lit(0)).cast("int")
        last = F.least(F.floor(c / stride), F.lit((n - size) // stride)).cast("int")
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    d = cells.select(F.explode(starts(F.col("y"), h)).alias("py"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    d = d.select("py", F.explode(starts(F.col("x"), w)).alias("px"), "y", "x", "v")
    return d.select((F.col("py") * stride).alias("patch_y"), (F.col("px") * stride).alias("patch_x"), (F.col("y") - F.col("py") * stride).alias("y"), (F.col("x") - F.col("px") * stride).alias("x"), "v")


def chips(cells: DataFrame, points: DataFrame, half: int) -> DataFrame:
    """(id, dy, dx, v): windows around points (id, py, px); beyond the border the edge's value."""
    h, w = _size(cells)
    o = F.sequence(F.lit(-half), F.lit(half))
    p = points.select("id", "py", "px", F.explode(o).alias("dy")).select("id", "py", "px", "dy", F.explode(o).alias("dx"))
    p = p.withColumn("y", F.greatest(F.least(F.col("py") + F.col("dy"), F.lit(h - 1)), F.lit(0))).withColumn("x", F.greatest(F.least(F.col("px") + F.col("dx"), F.lit(w - 1)), F.lit(0)))
    return p.join(cells, ["y", "x"], "left").select("id", "dy", "dx", "v")


def stretch(cells: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values stretched linearly between two percentiles, 0 to 1."""
    a, b = cells.agg(F.percentile("v", F.array(F.lit(low), F.lit(high)))).first()[0] or (0.0, 1.0)
    return cells.withColumn("v", F.least(F.greatest((F.col("v") - a) / max(b - a, 1e-12), F.lit(0.0)), F.lit(1.0)))


def nearest(axis: DataFrame, points: DataFrame) -> DataFrame:
    """(id, i): for points (id, p) the index of the nearest value of an axis (i, c); the first wins ties. The axis is
    one array (a raster's side), so each point is a row of its own work."""
    a = axis.agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("a"))
    best = F.array_min(F.transform("a", lambda s: F.struct(F.abs(s["c"] - F.col("p")).alias("d"), s["i"].alias("i"))))
    return points.join(F.broadcast(a)).select("id", best["i"].alias("i"))


#: Words and band numbers by which a band's role is known (fixed values: Sentinel-2 and Landsat 8 and 9 numbering).
ROLES = {
    "red": ("red", "b04", "b4", "sr_b4"),
    "green": ("green", "b03", "b3", "sr_b3"),
    "blue": ("blue", "b02", "b2", "sr_b2"),
    "nir": ("nir", "nir08", "b08", "b8", "b5", "b05", "sr_b5"),
    "index": ("ndvi", "evi", "nbr", "ndwi", "kndvi", "savi"),
}


def band_roles(names: list[str]) -> dict[str, int]:
    """Which band of a cube shows red, green and blue, and which is an index: places by role, for a display. Names are
    matched whole, in any case; with no name for the three colours the first three bands stand for them (one band for
    all three, if there are fewer)."""
    low = [n.strip().lower() for n in names]
    out = {role: low.index(n) for role, words in ROLES.items() for n in reversed(words) if n in low}
    if not {"red", "green", "blue"} <= set(out) and names:
        out |= dict(zip(("red", "green", "blue"), (0, 1, 2) if len(names) >= 3 else (0, 0, 0)))
    return out


def accuracy(pairs: DataFrame) -> DataFrame:
    """(accuracy, kappa) of pairs (truth, predicted); a kappa without a value is 0."""
    m = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    t = m.groupBy("truth").agg(F.sum("n").alias("r"))
    p = m.groupBy("predicted").agg(F.sum("n").alias("c"))
    both = t.join(p, F.col("truth") == F.col("predicted")).agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("e"))
    total = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("o"))
    j = total.join(both)
    acc, exp = F.try_divide(F.col("o"), F.col("n")), F.coalesce(F.try_divide("e", F.col("n") * F.col("n")), F.lit(0.0))
    return j.select(acc.alias("accuracy"), F.coalesce(F.try_divide(acc - exp, 1 - exp), F.lit(0.0)).alias("kappa"))


# ---- queries


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).withColumn("v", F.col("v") % 4)


def q_majority(spark, d):
    return majority(_classes(spark, d))


def q_bayes(spark, d):
    r = raster(spark, d)
    p = r.select("y", "x", F.posexplode(F.array(F.col("v") % 5 + 1, F.col("v") % 7 + 1, F.col("v") % 3 + 1)).alias("c", "p"))
    return bayesian(p).select("y", "x", "c")


def q_mmu(spark, d):
    return minimum_mapping_unit(_classes(spark, d), 11)


def q_patches(spark, d):
    return patches(raster(spark, d), 8, 6)


def q_chips(spark, d):
    p = spark.createDataFrame([(0, 0, 0), (1, 1, 49), (2, 3, 20)], "id int, py int, px int")
    return chips(raster(spark, d), p, 2)


def q_stretch(spark, d):
    return stretch(raster(spark, d)).select("y", "x", r4(F.col("v")).alias("v"))


def q_nearest(spark, d):
    axis = raster(spark, d).select(F.col("x").alias("i"), (F.col("x") * 0.5 - 3).alias("c")).distinct()
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 * 0.7).alias("p"))
    return nearest(axis, p)


def q_accuracy(spark, d):
    out = accuracy(table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))
    return out.select(r4(F.col("accuracy")).alias("accuracy"), r4(F.col("kappa")).alias("kappa"))


_CLS = f"{RASTER}, c AS (SELECT y, x, v % 4 AS v FROM ras), s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM ras)"
_O = "o AS (SELECT a.d AS dy, b.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d))"


def _at(c: str, n: str, o: str) -> str:
    return f"CASE WHEN {c} + {o} < 0 THEN -({c} + {o}) - 1 WHEN {c} + {o} >= {n} THEN 2 * {n} - 1 - ({c} + {o}) ELSE {c} + {o} END"


_NB = f"n AS (SELECT t.y, t.x, {_at('t.y', 's.h', 'o.dy')} AS sy, {_at('t.x', 's.w', 'o.dx')} AS sx FROM (SELECT y, x FROM ras) t, o, s)"
QUERIES = {
    "majority_3x3": (q_majority, f"WITH {_CLS}, {_O}, {_NB}, k AS (SELECT n.y, n.x, c.v, count(*) AS m FROM n JOIN c ON c.y = sy AND c.x = sx GROUP BY ALL) SELECT y, x, v FROM k QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY m DESC, v) = 1"),
    "bayes_3x3": (
        q_bayes,
        f"WITH {RASTER}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM ras), {_O}, {_NB}, p AS (SELECT y, x, 0 AS c, v % 5 + 1 AS p FROM ras UNION ALL SELECT y, x, 1, v % 7 + 1 FROM ras UNION ALL SELECT y, x, 2, v % 3 + 1 FROM ras), m AS (SELECT n.y, n.x, p.c, avg(p.p) AS m FROM n JOIN p ON p.y = sy AND p.x = sx GROUP BY ALL) SELECT y, x, c FROM p JOIN m USING (y, x, c) QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY p * m DESC, c) = 1",
    ),
    "mmu_filter": (
        q_mmu,
        f"""WITH RECURSIVE {_CLS}, live AS (SELECT y, x, y * 1000 + x AS id FROM c WHERE v <> 0),
e AS (SELECT a.id AS a, b.id AS b FROM live a JOIN live b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(a, b) AS (SELECT id, id FROM live UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
n AS (SELECT a AS id, count(*) AS n FROM reach GROUP BY a)
SELECT c.y, c.x, CASE WHEN n.n < 11 THEN 0.0 ELSE c.v END AS v FROM c LEFT JOIN live USING (y, x) LEFT JOIN n USING (id)""",
    ),
    "patches": (
        q_patches,
        f"WITH {RASTER}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM ras), py AS (SELECT CAST(unnest(range(0, (SELECT h - 8 + 1 FROM s), 6)) AS INTEGER) AS py), px AS (SELECT CAST(unnest(range(0, (SELECT w - 8 + 1 FROM s), 6)) AS INTEGER) AS px) SELECT py AS patch_y, px AS patch_x, y - py AS y, x - px AS x, v FROM ras, py, px WHERE y BETWEEN py AND py + 7 AND x BETWEEN px AND px + 7",
    ),
    "chip_edge_pad": (
        q_chips,
        f"WITH {RASTER}, s AS (SELECT max(y) AS h, max(x) AS w FROM ras), p AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 49), (2, 3, 20)) z(id, py, px)), o AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS d) SELECT id, a.d AS dy, b.d AS dx, v FROM p CROSS JOIN o a CROSS JOIN o b CROSS JOIN s LEFT JOIN ras ON ras.y = greatest(least(py + a.d, s.h), 0) AND ras.x = greatest(least(px + b.d, s.w), 0)",
    ),
    "stretch_2_98": (q_stretch, f"WITH {RASTER}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM ras) SELECT y, x, {sql4('least(greatest((v - a) / (b - a), 0.0), 1.0)')} AS v FROM ras, q"),
    "nearest_pixel": (q_nearest, f"WITH {RASTER}, a AS (SELECT DISTINCT x AS i, x * 0.5 - 3 AS c FROM ras) SELECT s_suppkey AS id, i FROM supplier, a QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c - s_suppkey % 40 * 0.7), i) = 1"),
    "accuracy_kappa": (
        q_accuracy,
        f"WITH t AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS DOUBLE)) AS a, sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic) AS e FROM labels) SELECT {sql4('a')} AS accuracy, {sql4('(a - e / (n * n)) / (1 - e / (n * n))')} AS kappa FROM t",
    ),
}
