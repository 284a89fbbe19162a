"""Structural breaks in regular series: monitoring by MOSUM, Bai-Perron segmentation, and the trend/season alternation
(Verbesselt and others 2010, 2012; Bai and Perron 2003; Liu, Wu and Zidek 1997 for LWZ).

Times are those of a regular grid, start + i / frequency; null steps are left out. Pixels of one mask of valid steps
share their design matrix, so its products are made once and the per-pixel work is matrix products over the batch.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..sources.cubes import MONTHLY, monthly, r4, sql4, to_series

LEVELS = (0.2, 0.15, 0.1, 0.05, 0.025, 0.01)
#: Own simulations (numpy seed 20240101, 6,000 Brownian paths of 400 steps a unit): quantiles at 1 - LEVELS of the
#: monitoring MOSUM's largest ratio to its boundary, by window and period.
MONITOR = {
    0.25: {2: (1.007, 1.054, 1.124, 1.227, 1.307, 1.418), 4: (1.131, 1.174, 1.237, 1.320, 1.405, 1.509), 6: (1.140, 1.183, 1.241, 1.323, 1.406, 1.509), 8: (1.141, 1.185, 1.242, 1.323, 1.406, 1.509), 10: (1.142, 1.185, 1.242, 1.323, 1.406, 1.509)},
    0.5: {2: (1.308, 1.394, 1.503, 1.692, 1.834, 2.017), 4: (1.541, 1.624, 1.728, 1.872, 2.027, 2.224), 6: (1.564, 1.644, 1.738, 1.879, 2.036, 2.225), 8: (1.573, 1.649, 1.741, 1.881, 2.036, 2.225), 10: (1.576, 1.654, 1.742, 1.881, 2.036, 2.225)},
    1.0: {2: (1.627, 1.750, 1.920, 2.196, 2.475, 2.800), 4: (2.113, 2.246, 2.431, 2.723, 2.940, 3.322), 6: (2.164, 2.305, 2.479, 2.744, 2.963, 3.322), 8: (2.184, 2.321, 2.493, 2.748, 2.965, 3.322), 10: (2.192, 2.331, 2.499, 2.748, 2.965, 3.322)},
}
#: Likewise (10,000 bridges of 600 steps): the largest OLS-MOSUM increment, by window.
MOSUM = {0.05: (0.686, 0.708, 0.739, 0.788, 0.833, 0.890), 0.1: (0.885, 0.921, 0.964, 1.031, 1.091, 1.171), 0.15: (1.011, 1.056, 1.106, 1.192, 1.261, 1.351), 0.2: (1.091, 1.143, 1.206, 1.313, 1.391, 1.491), 0.25: (1.146, 1.204, 1.277, 1.386, 1.478, 1.612), 0.3: (1.178, 1.239, 1.319, 1.437, 1.541, 1.669), 0.4: (1.202, 1.266, 1.349, 1.480, 1.592, 1.745), 0.5: (1.184, 1.253, 1.343, 1.477, 1.617, 1.749)}


def monitor_critical(h: float, period: int, alpha: float) -> float:
    if h not in MONITOR or period not in MONITOR[h]:
        raise ValueError("h must be 0.25, 0.5 or 1 and the period 2, 4, 6, 8 or 10")
    return float(np.interp(-math.log(alpha), -np.log(LEVELS), MONITOR[h][period]))


def mosum_p(stat: float, h: float) -> float:
    """p-value of an OLS-MOSUM maximum, linear between simulated quantiles (0.2 and above count as 1)."""
    hs = sorted(MOSUM)
    q = [np.interp(h, hs, [MOSUM[x][i] for x in hs]) for i in range(len(LEVELS))]
    return 1.0 if stat < q[0] else float(np.interp(stat, q, LEVELS))


def design(n: int, frequency: int, order: int, start: float = 0.0, *, trend: bool = True, harmonics: bool = True) -> np.ndarray:
    """Columns 1, i + 1, cosines, sines on the grid; the sine at the Nyquist frequency is left out."""
    if order > frequency:
        raise ValueError("the order must not exceed the frequency")
    t = start + np.arange(n) / frequency
    cols = [np.ones(n)] + ([np.arange(1, n + 1.0)] if trend else [])
    if harmonics:
        cols += [np.cos(2 * np.pi * k * t) for k in range(1, order + 1)]
        cols += [np.sin(2 * np.pi * k * t) for k in range(1, order + 1) if 2 * k != frequency]
    return np.stack(cols, axis=1)


def _masks(v: np.ndarray):
    """(rows, valid steps) for each pattern of nulls."""
    good = ~np.isnan(v)
    pat, at = np.unique(good, axis=0, return_inverse=True)
    for k in range(len(pat)):
        yield np.flatnonzero(at.ravel() == k), np.flatnonzero(pat[k])


def monitor(series: DataFrame, start_time: float, monitor_start: float, frequency: int, *, order: int = 3, h: float = 0.25, period: int = 10, alpha: float = 0.05, min_valid: int = 10) -> DataFrame:
    """(pixel, valid, has_break, breakpoint_idx, breakpoint, magnitude, n_history, sigma) of each series.

    The history is fitted by least squares; a break is the first step from monitor_start on where the moving sum of
    floor(h n) residuals leaves the boundary. Pixels with too short a history have valid 0 and only n_history.
    """
    crit = monitor_critical(h, period, alpha)

    def kernel(ts, vs):
        m, n = vs.shape
        x = design(n, frequency, order, start_time)
        past = start_time + np.arange(n) / frequency < monitor_start
        out = {k: np.full(m, np.nan) for k in ("breakpoint_idx", "breakpoint", "magnitude", "n_history", "sigma")}
        out |= {"valid": np.zeros(m, np.int32), "has_break": np.zeros(m, np.int32)}
        for rows, at in _masks(vs):
            nh = int(past[at].sum())
            out["n_history"][rows] = nh
            k = int(h * nh)
            if k <= 1 or nh <= x.shape[1] or nh < min_valid:
                continue
            out["valid"][rows] = 1
            xa, y = x[at], vs[rows][:, at]
            beta = np.linalg.lstsq(xa[:nh], y[:, :nh].T, rcond=None)[0]
            e = y - (xa @ beta).T
            sigma = np.sqrt((e[:, :nh] ** 2).sum(1) / (nh - x.shape[1]))
            out["sigma"][rows] = sigma
            if len(at) > nh:
                c = np.cumsum(np.c_[np.zeros(len(rows)), e], axis=1)
                step = np.arange(nh + 1, len(at) + 1)
                ratio = step / nh
                bound = crit * np.sqrt(2 * np.where(ratio <= np.e, 1.0, np.log(ratio)))
                with np.errstate(all="ignore"):
                    proc = (c[:, step] - c[:, step - k]) / (sigma * math.sqrt(nh))[:, None]
                hit = (np.abs(proc) > bound) & (sigma > 0)[:, None]
                broke = hit.any(1)
                idx = at[nh + hit.argmax(1)]
                r = rows[broke]
                out["has_break"][r] = 1
                out["breakpoint_idx"][r] = idx[broke]
                out["breakpoint"][r] = start_time + idx[broke] / frequency
                out["magnitude"][rows] = np.median(e[:, nh:], axis=1)
            out["magnitude"][rows[~(sigma > 0)]] = np.nan
        return out

    fields = "valid int, has_break int, breakpoint_idx double, breakpoint double, magnitude double, n_history double, sigma double"
    return run_kernel(series, kernel, fields)


class Segmenter:
    """Residual sums of squares of all segments of at least h n rows, for many series of one design."""

    def __init__(self, x: np.ndarray, h: float):
        self.x, (self.n, self.k) = x, x.shape
        self.least = int(h * self.n)
        i, j = np.triu_indices(self.n + 1, max(self.least, self.k + 1))
        self.i, self.j = i, j
        xx = np.concatenate([np.zeros((1, self.k, self.k)), np.cumsum(np.einsum("ni,nj->nij", x, x), axis=0)])
        g = xx[j] - xx[i]
        scale = np.sqrt(np.einsum("pii->pi", g))
        scale[scale == 0] = 1
        self.inv = np.linalg.pinv(g / (scale[:, :, None] * scale[:, None, :]), hermitian=True) / (scale[:, :, None] * scale[:, None, :])

    def rss(self, y: np.ndarray) -> np.ndarray:
        """(n + 1, n + 1) table of one series: rows i to j - 1."""
        mid = y.mean()
        y = y - mid
        xy = np.concatenate([np.zeros((1, self.k)), np.cumsum(self.x * y[:, None], axis=0)])
        yy = np.r_[0.0, np.cumsum(y * y)]
        b = xy[self.j] - xy[self.i]
        out = np.full((self.n + 1, self.n + 1), np.inf)
        out[self.i, self.j] = np.maximum(yy[self.j] - yy[self.i] - np.einsum("pi,pij,pj->p", b, self.inv, b), 0)
        return out

    def partitions(self, rss: np.ndarray, most: int) -> list[tuple[float, list[int]]]:
        """For 0, 1, .. breaks the least sum and the last rows of all segments but the last."""
        best = rss[0].copy()
        back: list[np.ndarray] = []
        out = [(float(best[self.n]), [])]
        for m in range(most):
            c = best[:, None] + rss
            arg = np.argmin(c, axis=0)
            best = c[arg, np.arange(self.n + 1)]
            back.append(arg)
            if not np.isfinite(best[self.n]):
                break
            at, cut = self.n, []
            for a in reversed(back):
                at = int(a[at])
                cut.append(at - 1)
            out.append((float(best[self.n]), cut[::-1]))
        return out

    def choose(self, y: np.ndarray, most: int, penalty: str) -> list[int]:
        """Break rows by LWZ or BIC."""
        if self.least <= self.k or self.least > self.n / 2:
            return []
        n = self.n
        weight = 0.299 * math.log(n) ** 2.1 if penalty == "lwz" else math.log(n)
        parts = self.partitions(self.rss(y), most)

        def score(m: int) -> float:
            return n * (math.log(max(parts[m][0], 1e-300)) + 1 - math.log(n) + math.log(2 * math.pi)) + weight * (self.k + 1) * (m + 1)

        return parts[min(range(len(parts)), key=score)][1]

    def fitted(self, y: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        out, coef, edge = np.empty(self.n), [], [0, *[c + 1 for c in cuts], self.n]
        for a, b in zip(edge[:-1], edge[1:]):
            coef.append(np.linalg.lstsq(self.x[a:b], y[a:b], rcond=None)[0])
            out[a:b] = self.x[a:b] @ coef[-1]
        return out, coef


def lite(series: DataFrame, start_time: float, frequency: int, *, order: int = 3, h: float = 0.15, max_breaks: int = 5, min_valid: int = 20) -> DataFrame:
    """(pixel, valid, n_valid, n_breaks, breakpoints array, magnitude): optimal partition of the harmonic trend model, the
    number of breaks by LWZ. magnitude: the largest jump between neighbouring segments' fits."""

    def kernel(ts, vs):
        m, n = vs.shape
        x = design(n, frequency, order, start_time)
        out: dict = {"valid": np.zeros(m, np.int32), "n_valid": (~np.isnan(vs)).sum(1).astype(np.int32), "n_breaks": np.zeros(m, np.int32), "breakpoints": [[] for _ in range(m)], "magnitude": np.zeros(m)}
        for rows, at in _masks(vs):
            if len(at) < min_valid or int(h * len(at)) <= x.shape[1] or int(h * len(at)) > len(at) / 2:
                continue
            seg = Segmenter(x[at], h)
            for r in rows:
                y = vs[r, at]
                cuts = seg.choose(y, max_breaks, "lwz")
                out["valid"][r], out["n_breaks"][r] = 1, len(cuts)
                out["breakpoints"][r] = [int(at[c]) for c in cuts]
                if cuts:
                    _, coef = seg.fitted(y, cuts)
                    jumps = [float(x[at[c + 1]] @ coef[i + 1] - x[at[c]] @ coef[i]) for i, c in enumerate(cuts)]
                    out["magnitude"][r] = max(jumps, key=abs)
        return out

    return run_kernel(series, kernel, "valid int, n_valid int, n_breaks int, breakpoints array<int>, magnitude double")


def loess(n: int, window: int, degree: int, at: np.ndarray | None = None) -> np.ndarray:
    """Matrix that takes n equally spaced values to their local fits at the places `at` (all n by default): tricube weights
    over the nearest `window` values, wider by half of what the window exceeds them (Cleveland and others 1990)."""
    x = np.arange(n, dtype=float)
    at = x if at is None else np.asarray(at, float)
    out = np.zeros((len(at), n))
    for row, a in enumerate(at):
        d = np.abs(x - a)
        h = np.sort(d)[min(window, n) - 1] + max(0, (window - n) // 2)
        w = np.where(d <= 0.999 * h, (1 - np.minimum(d / max(h, 1e-12), 1) ** 3) ** 3, 0.0)
        w = np.where(d <= 0.001 * h, 1.0, w)
        design = np.vander(x - a, degree + 1, increasing=True)
        out[row] = np.linalg.pinv(design.T @ (w[:, None] * design))[0] @ (design.T * w)
    return out


def _average(n: int, k: int) -> np.ndarray:
    """Matrix of the moving averages of k of n values."""
    return sum(np.eye(n - k + 1, n, j) for j in range(k)) / k


def _odd(x: float) -> int:
    return int(np.ceil(x)) | 1


@lru_cache(maxsize=64)
def seasonal_operators(n: int, frequency: int) -> tuple[np.ndarray, np.ndarray]:
    """(season, trend) of one round of STL with a periodic season, as matrices on the series without its trend and without
    its season: the cycle-subseries are smoothed and carried one period past both ends, and what passes a low-pass filter
    (averages of a period twice, of three, then a local line) is taken off."""
    window = 10 * n + 1
    cycle = np.zeros((n + 2 * frequency, n))
    for k in range(min(frequency, n)):
        m = len(range(k, n, frequency))
        cycle[np.ix_(k + frequency * np.arange(m + 2), np.arange(k, n, frequency))] = loess(m, window, 0, np.arange(-1, m + 1))
    low = loess(n, _odd(frequency), 1) @ _average(n + 2, 3) @ _average(n + frequency + 1, frequency) @ _average(n + 2 * frequency, frequency)
    season = (np.eye(n, n + 2 * frequency, frequency) - low) @ cycle
    return season, loess(n, _odd(1.5 * frequency / (1 - 1.5 / window)), 1)


def periodic_season(y: np.ndarray, frequency: int, rounds: int = 2) -> np.ndarray:
    """Season of the rows of y (no gaps) by STL (Cleveland and others 1990) without robustness weights; at the end each
    phase gets its mean, so it repeats exactly."""
    n = y.shape[1]
    to_season, to_trend = seasonal_operators(n, frequency)
    trend = np.zeros_like(y)
    for _ in range(rounds):
        season = (y - trend) @ to_season.T
        trend = (y - season) @ to_trend.T
    phase = np.arange(n) % frequency
    mean = (phase[None] == np.arange(frequency)[:, None]).astype(float)
    mean /= np.maximum(mean.sum(1, keepdims=True), 1)
    return (season @ mean.T)[:, phase]


def _stable(x: np.ndarray, y: np.ndarray, h: float, level: float) -> bool:
    """The OLS-MOSUM test does not reject constancy at the level."""
    n, k = x.shape
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    s = math.sqrt((e @ e) / max(1, n - k))
    w = int(h * n)
    if s <= 0 or w < 1:
        return True
    c = np.r_[0.0, np.cumsum(e)]
    return mosum_p(float(np.abs(c[w:] - c[:-w]).max() / (s * math.sqrt(n))), h) > level


def classic(series: DataFrame, start_time: float, frequency: int, *, order: int = 3, h: float = 0.15, max_breaks_trend: int = 5, max_breaks_season: int = 5, max_iter: int = 10, level: float = 0.05, min_valid: int = 20) -> DataFrame:
    """(pixel, valid, n_valid, n_trend_breaks, n_season_breaks, trend_breaks, season_breaks, magnitude, time, n_iter).

    Trend and season are fitted in turns, each to the series without the other and each split only where its MOSUM test
    finds change, until neither set of breaks moves. Series of two cycles or fewer are not valid.
    """

    def kernel(ts, vs):
        m, n = vs.shape
        xt = design(n, frequency, order, start_time, harmonics=False)
        xs = design(n, frequency, order, start_time, trend=False)
        out: dict = {k: np.zeros(m, np.int32) for k in ("valid", "n_trend_breaks", "n_season_breaks", "n_iter")}
        out |= {"n_valid": (~np.isnan(vs)).sum(1).astype(np.int32), "trend_breaks": [[] for _ in range(m)], "season_breaks": [[] for _ in range(m)], "magnitude": np.full(m, np.nan), "time": np.full(m, np.nan)}
        if frequency < 2 or n <= 2 * frequency:
            return out
        for rows, at in _masks(vs):
            if len(at) < min_valid or len(at) <= 2 * frequency:
                continue
            full = np.stack([np.interp(np.arange(n), at, vs[r, at]) for r in rows])
            seed = periodic_season(full, frequency)
            st, ss = Segmenter(xt[at], h), Segmenter(xs[at], h)
            for r, season in zip(rows, seed):
                y, season = vs[r, at], season[at]
                tb, sb = None, None
                for it in range(max_iter):
                    v = y - season
                    new_t = [] if _stable(st.x, v, h, level) else st.choose(v, max_breaks_trend, "bic")
                    trend, coef = st.fitted(v, new_t)
                    w = y - trend
                    new_s = [] if _stable(ss.x, w, h, level) else ss.choose(w, max_breaks_season, "bic")
                    season, _ = ss.fitted(w, new_s)
                    same = (new_t, new_s) == (tb, sb)
                    tb, sb = new_t, new_s
                    out["n_iter"][r] = it + 1
                    if same:
                        break
                out["valid"][r], out["n_trend_breaks"][r], out["n_season_breaks"][r] = 1, len(tb), len(sb)
                out["trend_breaks"][r], out["season_breaks"][r] = [int(at[c]) for c in tb], [int(at[c]) for c in sb]
                out["magnitude"][r] = 0.0
                if tb:
                    jump = [float(st.x[c + 1] @ coef[i + 1] - st.x[c] @ coef[i]) for i, c in enumerate(tb)]
                    k = max(range(len(jump)), key=lambda i: abs(jump[i]))
                    out["magnitude"][r], out["time"][r] = jump[k], start_time + at[tb[k]] / frequency
        return out

    fields = "valid int, n_valid int, n_trend_breaks int, n_season_breaks int, trend_breaks array<int>, season_breaks array<int>, magnitude double, time double, n_iter int"
    return run_kernel(series, kernel, fields)


# ---- queries


def _grid(spark, d):
    return to_series(monthly(spark, d), 0, 82)


def q_design(spark, d):
    x = design(83, 12, 3)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    names = ["c0", "trend", "cos1", "cos2", "cos3", "sin1", "sin2", "sin3"]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in names))
    return df.select("i", *[r4(F.col(c)).alias(c) for c in names])


def q_monitor(spark, d):
    out = monitor(_grid(spark, d), 1995.0, 1999.0, 12, order=1)
    return out.select("pixel", "valid", "has_break", "breakpoint_idx", "n_history", r4(F.col("magnitude")).alias("magnitude"), r4(F.col("sigma")).alias("sigma"))


def q_lite(spark, d):
    return lite(_grid(spark, d), 1995.0, 12, order=1)


def q_classic(spark, d):
    return classic(_grid(spark, d), 1995.0, 12, order=1)


def q_season(spark, d):
    def kernel(ts, vs):
        return {"season": periodic_season(np.nan_to_num(vs), 12)}

    return run_kernel(_grid(spark, d), kernel, "season array<double>")


#: The monitor of order 1: the design's columns and the values are made orthogonal one after the other over the history.
_FIT = "sum({a} * {b}) FILTER (hist) OVER w / sum({a} * {a}) FILTER (hist) OVER w"
_MONITOR = f"""WITH {MONTHLY}, x AS (SELECT pixel, t AS i, CAST(v AS DOUBLE) AS v, t < 48 AS hist, t + 1.0 AS a, cos(2 * pi() * (1995.0 + t / 12.0)) AS b, sin(2 * pi() * (1995.0 + t / 12.0)) AS c FROM monthly WHERE t <= 82),
g1 AS (SELECT pixel, i, hist, count(*) FILTER (hist) OVER w AS n, {", ".join(f"{k} - avg({k}) FILTER (hist) OVER w AS {k}" for k in "vabc")} FROM x WINDOW w AS (PARTITION BY pixel)),
g2 AS (SELECT pixel, i, hist, n, {", ".join(f"{k} - a * ({_FIT.format(a='a', b=k)}) AS {k}" for k in "vbc")} FROM g1 WINDOW w AS (PARTITION BY pixel)),
g3 AS (SELECT pixel, i, hist, n, {", ".join(f"{k} - b * ({_FIT.format(a='b', b=k)}) AS {k}" for k in "vc")} FROM g2 WINDOW w AS (PARTITION BY pixel)),
g4 AS (SELECT pixel, i, hist, n, v - c * ({_FIT.format(a='c', b='v')}) AS e FROM g3 WINDOW w AS (PARTITION BY pixel)),
s AS (SELECT pixel, i, hist, n, e, CAST(floor(0.25 * n) AS INTEGER) AS k, sqrt(sum(e * e) FILTER (hist) OVER w / nullif(n - 4, 0)) AS sigma, row_number() OVER o AS pos, sum(e) OVER o AS cum FROM g4 WINDOW w AS (PARTITION BY pixel), o AS (PARTITION BY pixel ORDER BY i)),
h AS (SELECT s.pixel, min(s.i) AS i FROM s JOIN s p ON p.pixel = s.pixel AND p.pos = s.pos - s.k WHERE s.pos > s.n
  AND abs(s.cum - p.cum) / (s.sigma * sqrt(s.n)) > {monitor_critical(0.25, 10, 0.05)!r} * sqrt(2 * greatest(1.0, ln(s.pos / s.n))) GROUP BY s.pixel),
q AS (SELECT pixel, any_value(n) AS n, any_value(k) AS k, any_value(sigma) AS sigma, median(e) FILTER (NOT hist) AS magnitude FROM s GROUP BY pixel)
SELECT pixel, CAST(ok AS INTEGER) AS valid, CAST(ok AND h.i IS NOT NULL AS INTEGER) AS has_break, CASE WHEN ok THEN CAST(h.i AS DOUBLE) END AS breakpoint_idx, CAST(n AS DOUBLE) AS n_history,
  CASE WHEN ok THEN {sql4("magnitude")} END AS magnitude, CASE WHEN ok THEN {sql4("sigma")} END AS sigma FROM (SELECT *, k > 1 AND n > 4 AND n >= 10 AS ok FROM q) LEFT JOIN h USING (pixel)"""
def _lite_sql(most: int) -> str:
    """Optimal partitions of a line by prefix sums: the residuals of all segments, then one join for each break more. The
    trend's column is centred in each segment, so two sums give its residual."""
    step = """b{m} AS (SELECT r.pixel, r.j, min_by(list_append(b.cut, r.i), b.cost + r.rss) AS cut, min(b.cost + r.rss) AS cost FROM b{l} b JOIN r ON r.pixel = b.pixel AND r.i = b.j GROUP BY r.pixel, r.j)"""
    sums = "n, v, i, vv, ii, vi"
    return f"""WITH {MONTHLY}, x AS (SELECT pixel, t, CAST(v AS DOUBLE) - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY pixel) AS y, t + 1.0 AS a, row_number() OVER (PARTITION BY pixel ORDER BY t) AS k, count(*) OVER (PARTITION BY pixel) AS nn FROM monthly WHERE t <= 82),
c AS (SELECT pixel, k, CAST(k AS DOUBLE) AS n, sum(y) OVER w AS v, sum(a) OVER w AS i, sum(y * y) OVER w AS vv, sum(a * a) OVER w AS ii, sum(a * y) OVER w AS vi FROM x WINDOW w AS (PARTITION BY pixel ORDER BY k)
  UNION ALL SELECT DISTINCT pixel, 0, {", ".join(["CAST(0 AS DOUBLE)"] * 6)} FROM x),
z AS (SELECT pixel, any_value(nn) AS nn, greatest(CAST(floor(0.15 * any_value(nn)) AS INTEGER), 3) AS least FROM x GROUP BY pixel),
d AS (SELECT p.pixel, p.k AS i0, q.k AS j0, {", ".join(f"q.{c} - p.{c} AS {c}" for c in sums.split(", "))} FROM c p JOIN c q ON q.pixel = p.pixel JOIN z ON z.pixel = p.pixel WHERE q.k - p.k >= least),
r AS MATERIALIZED (SELECT pixel, i0 AS i, j0 AS j, greatest(0.0, (vv - v * v / n) - (vi - v * i / n) * (vi - v * i / n) / (ii - i * i / n)) AS rss, v, n, i AS si, ii, vi FROM d),
b0 AS (SELECT pixel, j, CAST([] AS BIGINT[]) AS cut, rss AS cost FROM r WHERE i = 0),
{("," + chr(10)).join(step.format(m=m, l=m - 1) for m in range(1, most + 1))},
a AS ({" UNION ALL ".join(f"SELECT b.pixel, {m} AS m, cut, nn, nn * (ln(greatest(cost, 1e-300)) + 1 - ln(nn) + ln(2 * pi())) + 0.299 * pow(ln(nn), 2.1) * 3 * {m + 1} AS score FROM b{m} b JOIN z ON z.pixel = b.pixel AND b.j = z.nn" for m in range(most + 1))}),
best AS (SELECT pixel, any_value(nn) AS nn, arg_min(m, score) AS m, arg_min(cut, score) AS cut FROM a GROUP BY pixel),
ok AS (SELECT z.pixel, z.nn, z.nn >= 20 AS valid, CASE WHEN floor(0.15 * z.nn) > 2 THEN coalesce(best.m, 0) ELSE 0 END AS m, CASE WHEN floor(0.15 * z.nn) > 2 THEN coalesce(best.cut, []) ELSE [] END AS cut FROM z LEFT JOIN best USING (pixel))
SELECT ok.pixel, CAST(valid AS INTEGER) AS valid, CAST(ok.nn AS INTEGER) AS n_valid, CAST(CASE WHEN valid THEN m ELSE 0 END AS INTEGER) AS n_breaks,
  coalesce((SELECT string_agg(CAST(x.t AS VARCHAR), ',' ORDER BY x.t) FROM x WHERE x.pixel = ok.pixel AND valid AND list_contains(ok.cut, x.k)), '') AS breakpoints FROM ok"""


def q_lite_trend(spark, d):
    out = lite(_grid(spark, d), 1995.0, 12, order=0)
    return out.select("pixel", "valid", "n_valid", "n_breaks", F.array_join(F.coalesce("breakpoints", F.array().cast("array<int>")), ",").alias("breakpoints"))


QUERIES = {
    "bfast_lite_trend": (q_lite_trend, _lite_sql(5)),
    "design_matrix": (q_design, "SELECT CAST(i AS INTEGER) AS i, 1.0::DOUBLE AS c0, CAST(i + 1 AS DOUBLE) AS trend, " + ", ".join(f"{sql4(f'{f}(2 * pi() * {k} * (i / 12.0))')} AS {f}{k}" for f in ("cos", "sin") for k in (1, 2, 3)) + " FROM range(83) r(i)"),
    "bfast_monitor_o1": (q_monitor, _MONITOR),
    "bfast_lite": (q_lite, None),
    "bfast_classic": (q_classic, None),
    "stl_season": (q_season, None),
}
