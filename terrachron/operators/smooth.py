"""Temporal smoothing and window functions.

Relational ones (Savitzky-Golay, moving sums, ranks, fills, interpolation) are Catalyst windows or higher-order functions
on the series row; those that solve systems (Whittaker, harmonic analysis) and the despiking loop are Arrow kernels that
work on all pixels of a batch at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..sources.cubes import MONTHLY, SPARSE, YEAR0, annual, monthly, r4, spine, sql4, to_series


def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row i: weights that give the fitted polynomial's value at place i of the window."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and longer than the order")
    x = np.arange(window) - window // 2
    a = np.vander(x, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(series: DataFrame, window: int = 5, order: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing (1964); at the ends the end windows' polynomials; 0 stays where the input was 0."""
    h = savgol_matrix(window, order)
    half, n = window // 2, F.size("vs")

    def at(i: Column) -> Column:
        first = F.greatest(F.least(i - half, n - window), F.lit(0))  # the window's first place
        row = i - first
        w = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in h]), (row + 1).cast("int"))
        return F.aggregate(F.zip_with(w, F.slice("vs", first + 1, F.lit(window)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    smooth = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get("vs", i) == 0, 0.0).otherwise(at(i)))
    return series.select("pixel", "ts", F.when(n >= window, smooth).alias("vs"))


def moving_sum(obs: DataFrame, k: int) -> DataFrame:
    """Sums of the last k values (as in a MOSUM process); null until k are there."""
    w = Window.partitionBy("pixel").orderBy("t").rowsBetween(1 - k, 0)
    return obs.withColumn("sum", F.when(F.count("v").over(w) == k, F.sum("v").over(w)))


def moving_average(obs: DataFrame, k: int) -> DataFrame:
    """Averages of k neighbours, null where they are not complete."""
    w = Window.partitionBy("pixel").orderBy("t").rowsBetween(-(k // 2), k - 1 - k // 2)
    return obs.withColumn("avg", F.when(F.count("v").over(w) == k, F.avg("v").over(w)))


def average_rank(obs: DataFrame) -> DataFrame:
    """Rank of each value in its pixel's series, ties averaged."""
    w = Window.partitionBy("pixel")
    return obs.withColumn("rank", F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("pixel", "v")) - 1) / 2.0)


def adjusted_rmse(obs: DataFrame) -> DataFrame:
    """(pixel, adj_rmse): median of absolute differences of neighbours."""
    w = Window.partitionBy("pixel").orderBy("t")
    d = obs.where("v is not null").select("pixel", F.abs(F.col("v") - F.lag("v").over(w)).alias("d"))
    return d.groupBy("pixel").agg(F.median("d").alias("adj_rmse"))


def fill(obs: DataFrame) -> DataFrame:
    """Nulls filled linearly between neighbours, with the nearest value at the ends."""
    back = Window.partitionBy("pixel").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("pixel").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    has = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    w = obs.withColumn("a", F.last(has, True).over(back)).withColumn("b", F.first(has, True).over(ahead))
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / F.greatest(F.col("b.t") - F.col("a.t"), F.lit(1))
    return w.withColumn("filled", F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(line)).drop("a", "b")


def interpolate(series: DataFrame, knots: list[int]) -> DataFrame:
    """The series' values at the knots, joined by lines and clamped outside: (pixel, t, value) for every step. Values at
    knots the series lacks are its own interpolation there."""
    k = sorted(knots)
    m = F.map_from_arrays("ts", "vs")
    vs = F.array(*[F.try_element_at(m, F.lit(t)) for t in k])
    df = series.select("pixel", F.explode("ts").alias("t"), vs.alias("k"))
    out = F.when(F.col("t") <= k[0], F.get("k", F.lit(0)))
    for i in range(len(k) - 1):
        a, b = F.get("k", F.lit(i)), F.get("k", F.lit(i + 1))
        out = out.when(F.col("t") <= k[i + 1], a + (b - a) * (F.col("t") - k[i]) / float(k[i + 1] - k[i]))
    return df.select("pixel", "t", out.otherwise(F.get("k", F.lit(len(k) - 1))).alias("value"))


def turning_points(series: DataFrame, dead: float = 1e-9) -> DataFrame:
    """(pixel, i, kind): peaks (1) and troughs (-1) of the series, at the middle of a plateau."""

    def kernel(ts, vs):
        out = []
        for p, row in enumerate(vs):
            out += [(p, i, k) for i, k in peaks(row, dead)]
        a = np.array(out, np.int64).reshape(-1, 3)
        return {"_row": a[:, 0], "i": a[:, 1].astype(np.int32), "kind": a[:, 2].astype(np.int32)}

    return run_kernel(series, kernel, "i int, kind int")


def peaks(v: np.ndarray, dead: float = 1e-9) -> list[tuple[int, int]]:
    d = np.sign(np.where(np.abs(np.diff(v)) <= dead, 0, np.diff(v)))
    out, last, at = [], 0, 0
    for i, s in enumerate(d):
        if s != 0:
            if last and s != last:
                out.append(((at + i) // 2, 1 if last > 0 else -1))
            last, at = s, i + 1
    return out


# ---- kernels


def whittaker(y: np.ndarray, lam: float, w: np.ndarray | None = None) -> np.ndarray:
    """Solve (W + lam D2'D2) z = W y for all rows at once by a banded LDL' (Eilers 2003). NaN has weight 0; a row whose
    system is singular stays as it is."""
    y = np.asarray(y, float)
    w = np.where(np.isnan(y), 0.0, 1.0 if w is None else w)
    n = y.shape[1]
    if n < 3:
        return y.copy()
    d = np.diff(np.eye(n), 2, axis=0)
    p = lam * (d.T @ d)
    a0, a1, a2 = np.diag(p)[None] + w, np.diag(p, 1), np.diag(p, 2)
    d0, c, e = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    z = w * np.nan_to_num(y)
    with np.errstate(all="ignore"):
        for i in range(n):
            t, u = a0[:, i].copy(), np.full(len(y), a1[i] if i < n - 1 else 0.0)
            if i >= 1:
                t -= c[:, i - 1] ** 2 * d0[:, i - 1]
                u -= d0[:, i - 1] * c[:, i - 1] * e[:, i - 1]
                z[:, i] -= c[:, i - 1] * z[:, i - 1]
            if i >= 2:
                t -= e[:, i - 2] ** 2 * d0[:, i - 2]
                z[:, i] -= e[:, i - 2] * z[:, i - 2]
            d0[:, i] = t
            c[:, i] = u / t
            e[:, i] = (a2[i] if i < n - 2 else 0.0) / t
        z /= d0
        for i in range(n - 2, -1, -1):
            z[:, i] -= c[:, i] * z[:, i + 1]
            if i < n - 2:
                z[:, i] -= e[:, i] * z[:, i + 2]
    bad = ~np.isfinite(z).all(axis=1) | (w > 0).sum(axis=1).__lt__(2)
    z[bad] = y[bad]
    return z


def hants(y: np.ndarray, frequencies: int = 3, threshold: float = 0.1, iterations: int = 10, period: int | None = None) -> np.ndarray:
    """Harmonic analysis (Roerink and others 2000): least squares on a constant and harmonics, points far below the fit
    dropped, until none is. NaN has weight 0."""
    y = np.asarray(y, float)
    n = y.shape[1]
    t = 2 * np.pi * np.arange(n) / (period or n)
    x = np.stack([np.ones(n), *[f(k * t) for k in range(1, frequencies + 1) for f in (np.cos, np.sin)]], axis=1)
    w = np.where(np.isnan(y), 0.0, 1.0)
    v = np.nan_to_num(y)
    for _ in range(iterations):
        xtx = np.einsum("pt,ti,tj->pij", w * w, x, x) + 1e-9 * np.eye(x.shape[1])
        b = np.linalg.solve(xtx, ((w * w * v) @ x)[..., None])[..., 0]
        fit = b @ x.T
        low = (v - fit < -threshold) & (w > 0)
        if not low.any():
            break
        w = np.where(low, 0.0, w)
    return fit


def desawtooth(v: np.ndarray, stop: float = 0.9) -> np.ndarray:
    """Damp spikes (Kennedy and others 2010): the strongest proportional spike is corrected toward its neighbours' mean
    again and again until the last correction's proportion is at most stop; the first is always applied."""
    v = np.array(v, float)
    for _ in range(10 * len(v)):
        if len(v) < 3:
            break
        mean = (v[:-2] + v[2:]) / 2
        md = np.maximum(np.abs(v[1:-1] - v[:-2]), np.abs(v[1:-1] - v[2:]))
        prop = np.where(md > 0, 1 - np.abs(v[:-2] - v[2:]) / np.where(md > 0, md, 1), 0)
        corr = prop * (mean - v[1:-1])
        i = int(np.argmax(prop))
        if prop[i] <= 0:
            break
        v[i + 1] += corr[i]
        if prop[i] <= stop:
            break
    return v


def smooth_with(series: DataFrame, method: str = "whittaker", **how) -> DataFrame:
    """(pixel, ts, vs) smoothed by whittaker, hants or desawtooth."""
    f = {"whittaker": lambda y: whittaker(y, how.get("lam", 10.0)), "hants": lambda y: hants(y, **how), "desawtooth": lambda y: np.stack([desawtooth(r, **how) for r in y]) if len(y) else y}[method]
    return run_kernel(series, lambda ts, vs: {"ts": ts, "vs": f(vs)}, "ts array<int>, vs array<double>")


# ---- queries


def _monthly_spine(spark, d):
    return to_series(monthly(spark, d))


def q_savgol(spark, d):
    s = savgol(_monthly_spine(spark, d))
    e = s.select("pixel", F.explode(F.arrays_zip("ts", "vs")).alias("e"))
    return e.select("pixel", F.col("e.ts").alias("month"), r4(F.col("e.vs")).alias("smoothed"))


def q_fill(spark, d):
    return fill(spine(annual(spark, d, "l_partkey"), 1995, 2001)).select("pixel", F.col("t").alias("year"), r4(F.col("filled")).alias("filled"))


def q_interp(spark, d):
    return interpolate(to_series(annual(spark, d)), [1996, 1998, 2001]).select("pixel", F.col("t").alias("year"), r4(F.col("value")).alias("value"))


def q_mosum(spark, d):
    return moving_sum(monthly(spark, d), 12).select("pixel", "t", F.col("sum").alias("value"))


def q_average(spark, d):
    return moving_average(monthly(spark, d), 3).select("pixel", "t", r4(F.col("avg")).alias("value"))


def q_rank(spark, d):
    return average_rank(monthly(spark, d)).select("pixel", "t", F.col("rank").alias("value"))


def q_adjusted(spark, d):
    return adjusted_rmse(monthly(spark, d))


def _kernel_query(method, **how):
    def q(spark, d):
        s = smooth_with(to_series(monthly(spark, d)), method, **how)
        return s.select("pixel", F.explode(F.arrays_zip("ts", "vs")).alias("e")).select("pixel", F.col("e.ts").alias("t"), r4(F.col("e.vs")).alias("value"))

    return q


def q_turning(spark, d):
    return turning_points(to_series(monthly(spark, d)))


_H = savgol_matrix(5, 2)
_SG = (
    f"WITH {MONTHLY}, w AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY pixel) AS n FROM monthly), "
    "p AS (SELECT a.pixel, a.t, a.v AS own, greatest(least(a.i - 2, a.n - 5), 0) AS f, a.i, a.n FROM w a), "
    "h AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {j}, CAST({float(_H[i, j])!r} AS DOUBLE))" for i in range(5) for j in range(5))
    + f") x(r, c, h)) SELECT p.pixel, p.t AS month, {sql4('CASE WHEN any_value(own) = 0 THEN 0.0 ELSE sum(h.h * b.v) END')} AS smoothed FROM p JOIN w b ON b.pixel = p.pixel AND b.i BETWEEN p.f AND p.f + 4 JOIN h ON h.r = p.i - p.f AND h.c = b.i - p.f GROUP BY p.pixel, p.t"
)
_FILL = f"""WITH {SPARSE}, y AS (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS t), g AS (SELECT p.pixel, y.t, v FROM (SELECT DISTINCT pixel FROM sparse) p CROSS JOIN y LEFT JOIN sparse ON sparse.pixel = p.pixel AND sparse.t = y.t),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS tb, first_value(v IGNORE NULLS) OVER a AS vb
 FROM g WINDOW b AS (PARTITION BY pixel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pixel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT pixel, t AS year, {sql4("CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END")} AS filled FROM w"""
_INTERP = f"""WITH annual AS (SELECT l_suppkey AS pixel, CAST(year(l_shipdate) AS INTEGER) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
k AS (SELECT pixel, max(v) FILTER (t = 1996) AS a, max(v) FILTER (t = 1998) AS b, max(v) FILTER (t = 2001) AS c FROM annual GROUP BY pixel)
SELECT pixel, t AS year, {sql4("CASE WHEN t <= 1996 THEN a WHEN t <= 1998 THEN a + (b - a) * (t - 1996) / 2.0 WHEN t <= 2001 THEN b + (c - b) * (t - 1998) / 3.0 ELSE c END")} AS value FROM annual JOIN k USING (pixel)"""
#: The pentadiagonal system by recursion: elimination row by row, then back substitution; lam is 10, weights are 1.
_WHITTAKER = f"""WITH RECURSIVE {MONTHLY}, x AS (SELECT pixel, t, v, row_number() OVER (PARTITION BY pixel ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY pixel) AS n FROM monthly),
a AS (SELECT pixel, t, v, i, n, CAST(1 + 10.0 * CASE WHEN i = 0 OR i = n - 1 THEN 1 WHEN i = 1 OR i = n - 2 THEN CASE WHEN n = 3 THEN 4 ELSE 5 END WHEN n = 3 THEN 4 ELSE 6 END AS DOUBLE) AS a0,
  CAST(CASE WHEN i = n - 1 THEN 0.0 WHEN i = 0 OR i = n - 2 THEN -20.0 ELSE -40.0 END AS DOUBLE) AS a1, CAST(CASE WHEN i < n - 2 THEN 10.0 ELSE 0.0 END AS DOUBLE) AS a2 FROM x),
f AS (SELECT pixel, i, n, a0 AS d, a1 / a0 AS c, a2 / a0 AS e, CAST(v AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS d1, CAST(0 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS z1 FROM a WHERE i = 0
  UNION ALL SELECT g.pixel, g.i, g.n, g.d, (g.a1 - g.pd * g.pc * g.pe) / g.d, g.a2 / g.d, g.v - g.pc * g.pz - g.e1 * g.z1, g.pd, g.pe, g.pz FROM
   (SELECT a.pixel, a.i, a.n, a.a1, a.a2, a.v, f.d AS pd, f.c AS pc, f.e AS pe, f.z AS pz, f.e1, f.z1, a.a0 - f.c * f.c * f.d - f.e1 * f.e1 * f.d1 AS d FROM f JOIN a ON a.pixel = f.pixel AND a.i = f.i + 1) g),
b AS (SELECT pixel, i, z / d AS s, CAST(0 AS DOUBLE) AS s1 FROM f WHERE i = n - 1 UNION ALL SELECT f.pixel, f.i, f.z / f.d - f.c * b.s - f.e * b.s1, b.s FROM b JOIN f ON f.pixel = b.pixel AND f.i = b.i - 1)
SELECT a.pixel, a.t, {sql4("CASE WHEN a.n < 3 THEN a.v ELSE b.s END")} AS value FROM a JOIN b USING (pixel, i)"""
_TURNING = f"""WITH {MONTHLY}, x AS (SELECT pixel, v, row_number() OVER (PARTITION BY pixel ORDER BY t) - 1 AS i FROM monthly),
d AS (SELECT pixel, i - 1 AS i, v - lag(v) OVER (PARTITION BY pixel ORDER BY i) AS d FROM x), s AS (SELECT pixel, i, sign(d) AS s FROM d WHERE abs(d) > 1e-9),
k AS (SELECT pixel, i, s, lag(s) OVER w AS s0, lag(i) OVER w AS i0 FROM s WINDOW w AS (PARTITION BY pixel ORDER BY i))
SELECT pixel, CAST((i0 + 1 + i) // 2 AS INTEGER) AS i, CAST(CASE WHEN s0 > 0 THEN 1 ELSE -1 END AS INTEGER) AS kind FROM k WHERE s <> s0"""
QUERIES = {
    "savgol_5_2": (q_savgol, _SG),
    "nan_fill": (q_fill, _FILL),
    "ftv_interp": (q_interp, _INTERP),
    "mosum_window": (q_mosum, f"WITH {MONTHLY} SELECT pixel, t, CASE WHEN count(v) OVER w = 12 THEN sum(v) OVER w END AS value FROM monthly WINDOW w AS (PARTITION BY pixel ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
    "moving_average": (q_average, f"WITH {MONTHLY} SELECT pixel, t, {sql4('CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END')} AS value FROM monthly WINDOW w AS (PARTITION BY pixel ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "rank_avg": (q_rank, f"WITH {MONTHLY} SELECT pixel, t, rank() OVER (PARTITION BY pixel ORDER BY v) + (count(*) OVER (PARTITION BY pixel, v) - 1) / 2.0 AS value FROM monthly"),
    "adj_rmse": (q_adjusted, f"WITH {MONTHLY}, d AS (SELECT pixel, abs(v - lag(v) OVER (PARTITION BY pixel ORDER BY t)) AS d FROM monthly) SELECT pixel, median(d) AS adj_rmse FROM d GROUP BY pixel"),
    "whittaker": (_kernel_query("whittaker", lam=10.0), _WHITTAKER),
    "hants": (_kernel_query("hants", period=12, threshold=50.0), None),
    "desawtooth": (_kernel_query("desawtooth"), None),
    "turning_points": (q_turning, _TURNING),
}
