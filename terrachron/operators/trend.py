"""Mann-Kendall trend tests and Theil-Sen slopes (Mann 1945, Kendall 1975, Sen 1968; Hamed and Rao 1998; Yue and Wang
2004; Hirsch and others 1982 for seasons).

A pixel's series is one row, so its assembly is the only shuffle. The tests are an Arrow kernel: pixels with the same
number of observations are worked on together, pairs, ranks and lags as arrays over all of them. Gaps keep their index:
slopes are per step of the grid.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..sources.cubes import ANNUAL, MONTHLY, SPARSE, annual, monthly, r4, sql4, to_series

#: Two-sided 5 %.
Z = 1.959963984540054
METHODS = ("original", "hamed_rao", "yue_wang", "seasonal")
METRICS = ("p", "z", "tau", "s", "var_s", "slope", "intercept")
#: Pairs of observations held at a time.
PAIRS = 2_000_000


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks (from 1) of each row's values and the sizes of the runs of equal values that they are in."""
    order = np.argsort(v, axis=1, kind="stable")
    w = np.take_along_axis(v, order, axis=1)
    k = np.arange(v.shape[1])
    new = np.concatenate([np.ones((len(v), 1), bool), w[:, 1:] != w[:, :-1]], axis=1)
    first = np.maximum.accumulate(np.where(new, k, 0), axis=1)
    end = np.concatenate([new[:, 1:], np.ones((len(v), 1), bool)], axis=1)
    last = np.minimum.accumulate(np.where(end, k, len(k))[:, ::-1], axis=1)[:, ::-1]
    ranks, size = np.empty(v.shape), np.empty(v.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, axis=1)
    np.put_along_axis(size, order, last - first + 1.0, axis=1)
    return ranks, size


def _variance(n: np.ndarray | int, size: np.ndarray) -> np.ndarray:
    """Variance of the score of n values whose runs of equals have these sizes (0: no value): each of the t members of a
    run takes (t - 1)(2t + 5) off."""
    return (n * (n - 1.0) * (2 * n + 5.0) - np.where(size > 0, (size - 1) * (2 * size + 5), 0).sum(axis=-1)) / 18


def _median(a: np.ndarray) -> np.ndarray:
    """Medians of rows; NaN is left out, nothing gives NaN."""
    a = np.sort(a, axis=1)
    n = (~np.isnan(a)).sum(axis=1)
    at = lambda k: np.take_along_axis(a, np.maximum(k, 0)[:, None], axis=1)[:, 0] if a.shape[1] else np.full(len(a), np.nan)
    return (at((n - 1) // 2) + at(n // 2)) / 2


def _correction(v: np.ndarray, slope: np.ndarray, method: str, z_alpha: float, lag: int | None) -> np.ndarray:
    """Factor of the variance for the autocorrelation of the detrended values or, for hamed_rao, of their ranks."""
    n = v.shape[1]
    d = v - np.arange(1, n + 1) * slope[:, None]
    y = _runs(d)[0] if method == "hamed_rao" else d
    y = y - y.mean(axis=1, keepdims=True)
    power = (y * y).sum(axis=1)
    factor = np.zeros(len(v))
    for k in range(1, min(n - 1, n - 1 if lag is None else lag) + 1):
        r = (y[:, :-k] * y[:, k:]).sum(axis=1) / np.where(power > 0, power, 1)
        if method == "hamed_rao":
            factor += np.where(np.abs(r) > z_alpha / math.sqrt(n), (n - k) * (n - k - 1.0) * (n - k - 2) * r, 0) / (n * (n - 1.0) * (n - 2))
        else:
            factor += (1 - k / n) * r
    return np.where(power > 0, 1 + 2 * factor, 1)


def _whole(i: np.ndarray, v: np.ndarray, method: str, z_alpha: float, lag: int | None) -> dict[str, np.ndarray]:
    n = v.shape[1]
    a, b = np.triu_indices(n, 1)
    rise = v[:, b] - v[:, a]
    slope = _median(rise / (i[:, b] - i[:, a]))
    s = np.sign(rise).sum(axis=1)
    var = _variance(n, _runs(v)[1])
    if method != "original":
        var = var * _correction(v, slope, method, z_alpha, lag)
    return {"s": s, "var_s": var, "tau": s / (n * (n - 1) / 2), "slope": slope, "intercept": _median(v) - _median(i) * slope}


def _seasons(i: np.ndarray, v: np.ndarray, period: int) -> dict[str, np.ndarray]:
    """Each season on its own, over a table of seasons by cycles; scores, variances and slopes are pooled."""
    cycles = int(i.max()) // period + 1
    table = np.full((len(v), period, cycles), np.nan)
    table[np.arange(len(v))[:, None], (i % period).astype(int), (i // period).astype(int)] = v
    a, b = np.triu_indices(cycles, 1)
    rise = table[:, :, b] - table[:, :, a]
    n = (~np.isnan(table)).sum(axis=2)
    size = _runs(table.reshape(-1, cycles))[1].reshape(table.shape)  # NaN equals nothing, itself included
    pairs = (n * (n - 1) / 2).sum(axis=1)
    s = np.nansum(np.sign(rise), axis=(1, 2))
    slope = _median((rise / (b - a)).reshape(len(v), -1))
    var = _variance(n, np.where(np.isnan(table), 0, size)).sum(axis=1)
    return {"s": s, "var_s": var, "tau": s / np.where(pairs > 0, pairs, np.nan), "slope": slope, "intercept": _median(v) - _median(i) / period * slope}


def mann_kendall(series: DataFrame, method: str = "original", *, period: int = 12, min_valid: int = 4, alpha: float = 0.05, lag: int | None = None) -> DataFrame:
    """(pixel, trend, h, p, z, tau, s, var_s, slope, intercept), one row a pixel.

    method: original, hamed_rao, yue_wang or seasonal. lag: only the first so many lags correct the variance (null: all).
    Pixels with fewer than min_valid observations have nulls; those with fewer than four have no trend (0, 0) and nulls.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    z_alpha = NormalDist().inv_cdf(1 - alpha / 2)

    def kernel(ts, vs):
        m = len(vs)
        out = {c: np.full(m, np.nan) for c in ("trend", "h", *METRICS)}
        count = (~np.isnan(vs)).sum(axis=1)
        step = ts - ts[:, :1]
        for n in np.unique(count[count >= max(min_valid, 1)]):
            rows = np.flatnonzero(count == n)
            if n < 4:
                out["trend"][rows] = out["h"][rows] = 0
                continue
            some = max(1, PAIRS // (n * n))
            for at in (rows[k : k + some] for k in range(0, len(rows), some)):
                there = ~np.isnan(vs[at])
                v, i = vs[at][there].reshape(len(at), n), step[at][there].reshape(len(at), n).astype(float)
                got = _seasons(i, v, period) if method == "seasonal" else _whole(i, v, method, z_alpha, lag)
                s, var = got["s"], got["var_s"]
                z = np.where(var > 0, (s - np.sign(s)) / np.sqrt(np.where(var > 0, var, 1)), 0.0)
                h = np.abs(z) > z_alpha
                got |= {"z": z, "h": h, "trend": np.where(h, np.sign(z), 0), "p": np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])}
                for c, x in got.items():
                    out[c][at] = x
        return out

    return run_kernel(series, kernel, "trend int, h int, " + ", ".join(f"{c} double" for c in METRICS))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("pixel", "trend", "h", *[r4(F.col(c)).alias(c) for c in ("z", "tau", "s", "var_s", "slope", "intercept")])


def q_original(spark, d):
    return _rounded(mann_kendall(to_series(annual(spark, d))))


def q_gaps(spark, d):
    return _rounded(mann_kendall(to_series(annual(spark, d, "l_partkey"), 1995, 2001)))


def q_hamed_rao(spark, d):
    return _rounded(mann_kendall(to_series(monthly(spark, d)), "hamed_rao"))


def q_yue_wang(spark, d):
    return _rounded(mann_kendall(to_series(monthly(spark, d)), "yue_wang"))


def q_seasonal(spark, d):
    return _rounded(mann_kendall(to_series(monthly(spark, d)), "seasonal", period=12))


_TAIL = f"""
SELECT pixel, CASE WHEN z IS NULL THEN NULL WHEN abs(z) > {Z} THEN CAST(sign(z) AS INTEGER) ELSE 0 END AS trend, CAST(abs(z) > {Z} AS INTEGER) AS h,
  {sql4("z")} AS z, {sql4("tau")} AS tau, {sql4("s")} AS s, {sql4("var_s")} AS var_s, {sql4("slope")} AS slope, {sql4("intercept")} AS intercept
FROM (SELECT DISTINCT pixel FROM x) LEFT JOIN
  (SELECT *, CASE WHEN s > 0 AND var_s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 AND var_s > 0 THEN (s + 1) / sqrt(var_s) ELSE 0.0 END AS z FROM mk) USING (pixel)
"""
_MK = """
x AS (SELECT pixel, CAST(t - {first} AS DOUBLE) AS i, v FROM {cube}),
n AS (SELECT pixel, CAST(count(*) AS DOUBLE) AS n, median(v) AS mv, median(i) AS mi FROM x GROUP BY pixel HAVING count(*) >= 4),
pr AS (SELECT a.pixel, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM x a JOIN x b ON a.pixel = b.pixel AND a.i < b.i GROUP BY a.pixel),
ti AS (SELECT pixel, sum(c * (c - 1.0) * (2.0 * c + 5.0)) AS ties FROM (SELECT pixel, v, count(*) AS c FROM x GROUP BY ALL) GROUP BY pixel),
base AS (SELECT n.pixel, n, CAST(s AS DOUBLE) AS s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var, slope, mv - mi * slope AS intercept, s / (n * (n - 1) / 2.0) AS tau
  FROM n JOIN pr USING (pixel) JOIN ti USING (pixel))"""
_ORIG = ",\nmk AS (SELECT *, var AS var_s FROM base)\n" + _TAIL
_ACF = """,
k AS (SELECT x.pixel, row_number() OVER (PARTITION BY x.pixel ORDER BY x.i) AS k, x.v - row_number() OVER (PARTITION BY x.pixel ORDER BY x.i) * b.slope AS d, b.n FROM x JOIN base b USING (pixel)),
y AS (SELECT pixel, k, n, {value} AS y0 FROM k),
c AS (SELECT pixel, k, n, y0 - avg(y0) OVER (PARTITION BY pixel) AS y FROM y),
ss AS (SELECT pixel, sum(y * y) AS ss FROM c GROUP BY pixel),
acf AS (SELECT a.pixel, b.k - a.k AS lag, any_value(a.n) AS n, sum(a.y * b.y) / any_value(ss) AS r FROM c a JOIN c b ON a.pixel = b.pixel AND a.k < b.k JOIN ss ON ss.pixel = a.pixel GROUP BY a.pixel, b.k - a.k),
f AS (SELECT pixel, {factor} AS f FROM acf GROUP BY pixel),
mk AS (SELECT base.*, var * f AS var_s FROM base JOIN f USING (pixel))
""" + _TAIL
_RANK = "rank() OVER (PARTITION BY pixel ORDER BY d) + (count(*) OVER (PARTITION BY pixel, d) - 1) / 2.0"
_HR = f"1 + 2.0 / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) * sum(CASE WHEN abs(r) > {Z} / sqrt(n) THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * r ELSE 0 END)"
_YW = "1 + 2.0 * sum((1 - lag / n) * r)"
_SEASON = (
    f"""WITH {MONTHLY},
x AS (SELECT pixel, t - min(t) OVER (PARTITION BY pixel) AS i, v FROM monthly),
g AS (SELECT pixel, i % 12 AS k, CAST(i // 12 AS DOUBLE) AS c, v FROM x),
pr AS (SELECT a.pixel, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.c - a.c)) AS slope, count(*) AS m FROM g a JOIN g b ON a.pixel = b.pixel AND a.k = b.k AND a.c < b.c GROUP BY a.pixel),
sz AS (SELECT pixel, k, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL),
ti AS (SELECT pixel, sum(c * (c - 1.0) * (2.0 * c + 5.0)) AS ties FROM (SELECT pixel, k, v, count(*) AS c FROM g GROUP BY ALL) GROUP BY pixel),
va AS (SELECT pixel, sum(n * (n - 1) * (2 * n + 5)) AS a FROM sz GROUP BY pixel),
md AS (SELECT pixel, median(v) AS mv, median(i) AS mi FROM x GROUP BY pixel HAVING count(*) >= 4),
mk AS (SELECT md.pixel, CAST(s AS DOUBLE) AS s, (a - ties) / 18.0 AS var_s, s / m AS tau, slope, mv - mi / 12 * slope AS intercept FROM md JOIN pr USING (pixel) JOIN ti USING (pixel) JOIN va USING (pixel))
"""
    + _TAIL
)

QUERIES = {
    "mk_original": (q_original, f"WITH {ANNUAL}," + _MK.format(cube="annual", first="min(t) OVER (PARTITION BY pixel)") + _ORIG),
    "mk_original_gaps": (q_gaps, f"WITH {SPARSE}," + _MK.format(cube="sparse", first="1995") + _ORIG),
    "mk_hamed_rao": (q_hamed_rao, f"WITH {MONTHLY}," + _MK.format(cube="monthly", first="min(t) OVER (PARTITION BY pixel)") + _ACF.format(value=_RANK, factor=_HR)),
    "mk_yue_wang": (q_yue_wang, f"WITH {MONTHLY}," + _MK.format(cube="monthly", first="min(t) OVER (PARTITION BY pixel)") + _ACF.format(value="d", factor=_YW)),
    "mk_seasonal": (q_seasonal, _SEASON),
}
