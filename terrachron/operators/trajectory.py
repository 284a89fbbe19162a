"""Piecewise-linear trajectories of yearly series (Kennedy, Yang and Cohen 2010).

Despike; find candidate vertices by splitting where a regression errs most; cull them by the angle they make; fit a
ladder of models with ever fewer vertices, and choose by the F-test; fall back to a joint fit, then to a flat line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..functions.stats import f_tail
from ..sources.cubes import annual, r4, table
from .events import extract_events
from .smooth import desawtooth


@dataclass
class Options:
    max_segments: int = 6
    pval_threshold: float = 0.05
    recovery_threshold: float = 0.25
    spike_threshold: float = 0.9
    best_model_proportion: float = 0.75
    vertex_count_overshoot: int = 3
    min_observations_needed: int = 6
    #: -1 where the value falls with disturbance.
    modifier: float = -1.0


@dataclass
class Model:
    at: list[int]
    value: np.ndarray
    slope: np.ndarray
    f: float
    p: float


def _line_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fitted values of the regression line."""
    d = x - x.mean()
    s = d @ d
    return y.mean() + (d * (d @ y / s) if s > 0 else 0.0)


def candidates(x: np.ndarray, y: np.ndarray, target: int) -> list[int]:
    """First and last place, then again and again the place of the largest residual in the segment with the largest error
    for its length. Ends don't count, nor does the place before the last unless the series rises there."""
    n = len(x)
    v = [0, n - 1]
    for _ in range(21):
        if len(v) >= min(target, n - 2):
            break
        ranked = []
        for a, b in zip(v[:-1], v[1:]):
            if b - a < 2:
                continue
            r = np.abs(y[a : b + 1] - _line_fit(x[a : b + 1], y[a : b + 1]))
            mse = float(r @ r) / (b - a + 1)
            r[[0, -1]] = 0
            if b == n - 1 and not y[b] > y[b - 1]:
                r[-2] = 0
            if mse > 0:
                ranked.append((-mse, a, a + int(r.argmax()) if r.max() > 0 else -1))
        place = next((p for _, _, p in sorted(ranked) if p >= 0), -1)
        if place < 0:
            break
        v = sorted([*v, place])
    return v


def _bend(x: np.ndarray, y: np.ndarray, weight: float = 2.0) -> np.ndarray:
    """How strongly each inner vertex bends: the steeper of its two angles, more for a rise after it."""
    if len(x) < 3:
        return np.zeros(0)
    dx, dy = np.diff(x).astype(float), np.diff(y)
    angle = np.abs(np.arctan(dy / dx))
    span = y.max() - y.min() or 1.0
    return np.maximum(angle[:-1], angle[1:]) * (np.maximum(dy[1:] * weight / span, 0) + 1)


def cull(x: np.ndarray, y: np.ndarray, v: list[int], keep: int) -> list[int]:
    """Drop the least bent vertex until `keep` are left, on axes scaled to a square."""
    span = y.max() - y.min() or 1.0
    s = (y - y.min()) / span * (x[-1] - x[0] or 1)
    whole = s.max() - s.min() or 1.0
    v = list(v)
    while len(v) > max(keep, 2) and len(v) > 2:
        dx, dy = np.diff(x[v]).astype(float), np.diff(s[v])
        angle = np.abs(np.arctan(dy / dx))
        bend = np.maximum(angle[:-1], angle[1:]) * (np.maximum(dy[1:] * 2.0 / whole, 0) + 1)
        v.pop(1 + int(bend.argmin()))
    return v


def interpolated(x: np.ndarray, at: list[int], value: np.ndarray) -> np.ndarray:
    return np.interp(x, x[at], value)


def _tested(x: np.ndarray, y: np.ndarray, at: list[int], value: np.ndarray, slope: np.ndarray) -> Model:
    """p in single precision: what rounds to 0 ties, and ties go to the model with more vertices."""
    n, k = len(y), 2 * len(at) - 2
    total = float(((y - y.mean()) ** 2).sum())
    rest = min(float(((y - interpolated(x, at, value)) ** 2).sum()), total)
    if n - k - 1 <= 0:
        return Model(at, value, slope, 0.0, 1.0)
    ms = (total - rest) / k
    f = 1e-5 if ms < 1e-5 else (ms / (rest / (n - k - 1)) if rest > 0 else np.inf)
    p = float(np.float32(1) - np.float32(1 - (f_tail(f, k, n - k - 1) if np.isfinite(f) else 0.0)))
    return Model(at, value, slope, float(f), p)


def anchored(x: np.ndarray, y: np.ndarray, at: list[int]) -> Model:
    """Segment by segment from the left, each from where the last one ended: the line to the next vertex's value or the
    regression through the start, whichever errs less; the first may choose its start too."""
    value, slope = np.zeros(len(at)), np.zeros(len(at) - 1)
    value[0] = y[at[0]]
    for j, (a, b) in enumerate(zip(at[:-1], at[1:])):
        d, seg = (x[a : b + 1] - x[a]).astype(float), y[a : b + 1]
        direct = (value[j], (y[b] - value[j]) / d[-1])
        if j == 0:
            s, c = np.polyfit(d, seg, 1) if len(d) > 2 else (direct[1], direct[0])
            fitted = (c, s)
        else:
            fitted = (value[j], float(d @ (seg - value[j]) / (d @ d)))
        err = [float(((seg - c - s * d) ** 2).sum()) for c, s in (fitted, direct)]
        c, s = fitted if err[0] < err[1] else direct
        value[j], value[j + 1], slope[j] = c, c + s * d[-1], s
    return _tested(x, y, at, value, slope)


def jointly(x: np.ndarray, y: np.ndarray, at: list[int]) -> Model:
    """All vertex values by one least-squares fit."""
    hat = np.stack([np.interp(x, x[at], e) for e in np.eye(len(at))], axis=1)
    value = np.linalg.lstsq(hat, y, rcond=None)[0]
    return _tested(x, y, at, value, np.diff(value) / np.diff(at))


def without_weakest(x: np.ndarray, y: np.ndarray, m: Model) -> list[int]:
    """Leave out the vertex that a line between its neighbours misses least."""
    worst = []
    for i in range(1, len(m.at) - 1):
        a, b = m.at[i - 1], m.at[i + 1]
        line = m.value[i - 1] + (m.value[i + 1] - m.value[i - 1]) * (x[a : b + 1] - x[a]) / (x[b] - x[a])
        worst.append(float(((y[a : b + 1] - line) ** 2).sum()) / (x[b] - x[a]))
    return m.at if not worst else [v for k, v in enumerate(m.at) if k != 1 + int(np.argmin(worst))]


def simplified(x: np.ndarray, y: np.ndarray, m: Model, limit: float) -> list[int]:
    """The next rung's vertices. A recovery faster than the limit loses the vertex it ends at, and the observation there
    is levelled (in y, for all later rungs); else the weakest vertex goes."""
    span = np.ptp(m.value) or 1.0
    speed = np.where((m.slope < 0) & (m.slope != -1), -m.slope / span, -1.0)
    k = int(speed.argmax())
    if speed[k] > limit:
        i = m.at[k + 1]
        if k + 1 < len(m.at) - 1:
            y[i] = np.interp(x[i], [x[i - 1], x[i + 1]], [y[i - 1], y[i + 1]])
            return [v for v in m.at if v != i]
        y[i] = y[i - 1]
        m = Model(m.at, np.r_[m.value[:-1], y[i]], m.slope, m.f, m.p)
    return without_weakest(x, y, m)


def choose(ladder: list[Model], o: Options, joint: bool) -> Model:
    """The first rung whose p is near the least, unless it recovers too fast."""
    p = np.array([m.p for m in ladder])
    for _ in range(len(ladder) + 1):
        near = np.flatnonzero(p <= (2 - o.best_model_proportion) * p.min())
        if not len(near):
            if joint:
                ladder[-1].p = 1.0
                return ladder[-1]
            return ladder[int(np.argmin([m.f for m in ladder]))]
        m = ladder[near[0]]
        if not ((m.slope < 0) & (-m.slope > o.recovery_threshold * np.ptp(m.value))).any():
            return m
        p[near[0]] = m.p = 1.0
    return m


def fit(years: np.ndarray, values: np.ndarray, o: Options = Options()) -> tuple[list[tuple[int, float]], float]:
    """Vertices (year, value) and the root mean square error of one series; NaN is no observation. Too few observations
    are returned as they are, with error 0."""
    good = np.flatnonzero(~np.isnan(values))
    n, full = len(good), len(years)
    if n == 0:
        return [], 0.0
    if n < max(2, o.min_observations_needed):
        return [(int(years[i]), float(values[i])) for i in good], 0.0
    x, raw = years[good], values[good]
    y = (desawtooth(raw, o.spike_threshold) if o.spike_threshold < 1 else raw.copy()) * o.modifier
    most = o.max_segments + 1
    first = cull(x, y, candidates(x, y, most + max(0, o.vertex_count_overshoot)), most)

    def climb(model, lessen):
        out = [model(x, y, first)]
        for _ in range(len(first) - 2):
            out.append(model(x, y, lessen(out[-1])))
        return out

    best = choose(climb(anchored, lambda m: simplified(x, y, m, o.recovery_threshold)), o, False)
    if best.p > o.pval_threshold:
        best = choose(climb(jointly, lambda m: without_weakest(x, y, m)), o, True)
    if best.p > o.pval_threshold:
        at, value = [0, full - 1], np.full(2, y.mean())
    else:
        at, value = [int(good[i]) for i in best.at], best.value
        for front, missing in ((True, good[0] != 0), (False, good[-1] != full - 1)):
            if missing:
                at = [0, *at] if front else [*at, full - 1]
                value = np.r_[value[0], value] if front else np.r_[value, value[-1]]
                if len(at) > most:
                    k = 1 + int(_bend(np.array(at), np.trunc(value)).argmin())
                    at, value = [a for i, a in enumerate(at) if i != k], np.delete(value, k)
    rest = raw * o.modifier - np.interp(x, years[at], value)
    rmse = float(np.sqrt((rest @ rest) / max(1, n - len(at))))
    return [(int(years[i]), float(v * o.modifier)) for i, v in zip(at, value)], rmse


def segment(series: DataFrame, options: Options = Options()) -> DataFrame:
    """(pixel, v array of (year, value), n_vertices, rmse). Pixels without any observation are dropped before the kernel."""
    live = series.where(F.exists("vs", lambda v: v.isNotNull()))

    def kernel(ts, vs):
        got = [fit(t, v, options) for t, v in zip(ts, vs)]
        return {"v": [[{"year": y, "value": z} for y, z in g[0]] for g in got], "n_vertices": np.array([len(g[0]) for g in got], np.int32), "rmse": np.array([g[1] for g in got])}

    return run_kernel(live, kernel, "v array<struct<year:int,value:double>>, n_vertices int, rmse double")


# ---- queries


def quarters(spark, d):
    """A series of quarters of each supplier, as its years."""
    q = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), q.alias("t"), "l_quantity").groupBy("pixel", "t").agg(F.sum("l_quantity").alias("v"))
    from ..sources.cubes import to_series

    return to_series(t, 0, 27)


def q_landtrendr(spark, d):
    s = segment(quarters(spark, d))
    return s.select("pixel", "n_vertices", r4(F.col("rmse")).alias("rmse"), F.transform("v", lambda x: x["year"]).alias("years"))


def q_landtrendr_events(spark, d):
    return extract_events(segment(quarters(spark, d)), "loss", "greatest")


def q_landtrendr_annual(spark, d):
    from ..sources.cubes import to_series

    return segment(to_series(annual(spark, d), 1995, 2001)).select("pixel", "n_vertices", r4(F.col("rmse")).alias("rmse"))


QUERIES = {"landtrendr": (q_landtrendr, None), "landtrendr_events": (q_landtrendr_events, None), "landtrendr_annual": (q_landtrendr_annual, None)}
