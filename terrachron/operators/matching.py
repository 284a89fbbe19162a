"""Time-weighted dynamic time warping (Maus and others 2016) and pattern classification.

The dynamic programme runs over the cells of the (short) alignment matrix; each cell is an array over all pixels of a
batch, for all patterns in one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..sources.cubes import YEAR0, monthly, r4, sql4, to_series


def local_cost(v: np.ndarray, t: np.ndarray, p: np.ndarray, pt: np.ndarray, alpha: float, beta: float, gamma: float, max_warp: float) -> np.ndarray:
    """(pixels, steps, pattern steps): value distance (L1 for one band, else L2) plus alpha / (1 + exp(-beta (dt - gamma)));
    infinite beyond max_warp."""
    d = np.abs(v[:, :, None, 0] - p[None, None, :, 0]) if v.shape[3 - 1] == 1 else np.sqrt(((v[:, :, None, :] - p[None, None, :, :]) ** 2).sum(-1))
    dt = np.minimum(np.abs(t[:, :, None] - pt), 2000)
    cost = d + alpha / (1 + np.exp(-beta * (dt - gamma)))
    return np.where(np.abs(t[:, :, None] - pt) > max_warp, np.inf, cost)


def warp(cost: np.ndarray, subsequence: bool = False, path: bool = False, abort: float = np.inf):
    """Distances (and paths) over cost (pixels, n, m). A step comes from the diagonal, from above or from the left, in
    this order among equals. subsequence: the pattern may begin and end anywhere in the series. A pixel whose whole row
    passes `abort` is given up: costs are not negative, so its distance would too."""
    k, n, m = cost.shape
    acc = np.full((n, m, k), np.inf)
    step = np.zeros((n, m, k), np.int8) if path else None
    cost = np.ascontiguousarray(cost.transpose(1, 2, 0))
    inf = np.full(k, np.inf)
    for i in range(n):
        for j in range(m):
            if j == 0 and (i == 0 or subsequence):
                best = np.minimum(acc[i - 1, 0], 0.0) if i else np.zeros(k)
                s = np.where(acc[i - 1, 0] < 0, 2, 0) if i else 0
            else:
                a, b, c = acc[i - 1, j - 1] if i and j else inf, acc[i - 1, j] if i else inf, acc[i, j - 1] if j else inf
                best = np.minimum(np.minimum(a, b), c)
                s = np.where(a == best, 1, np.where(b == best, 2, 3)) if path else 0
            acc[i, j] = cost[i, j] + best
            if path:
                step[i, j] = s
        if np.isfinite(abort) and not subsequence:
            gone = acc[i].min(axis=0) > abort
            if gone.any():
                acc[:, :, gone] = np.inf
                cost[:, :, gone] = np.inf
                if gone.all():
                    break
    end = np.argmin(acc[:, -1], axis=0) if subsequence else np.full(k, n - 1)
    dist = acc[end, -1, np.arange(k)]
    dist = np.where(dist > abort, np.inf, dist) if not subsequence else dist
    if not path:
        return dist
    paths = []
    for q in range(k):
        i, j, out = int(end[q]), m - 1, []
        while np.isfinite(dist[q]):
            out.append((i, j))
            s = step[i, j, q]
            if s == 0 or (i, j) == (0, 0):
                break
            i, j = i - (s in (1, 2)), j - (s in (1, 3))
        paths.append(out[::-1])
    return dist, paths


def envelope_bound(v: np.ndarray, t: np.ndarray, p: np.ndarray, pt: np.ndarray, max_warp: float) -> np.ndarray:
    """A lower bound of each pixel's distance (Keogh 2002): every step is matched with some step of the pattern in reach,
    and so lies at least as far as the envelope of these, in the first band."""
    reach = np.abs(t[:, :, None] - pt) <= max_warp
    low, high = np.where(reach, p[:, 0], np.inf).min(axis=2), np.where(reach, p[:, 0], -np.inf).max(axis=2)
    x = v[:, :, 0]
    return np.maximum(np.maximum(low - x, x - high), 0.0).sum(axis=1)


def _by_length(ts: np.ndarray, bands: list[np.ndarray]):
    """(rows, values (rows, steps, bands), times) of the pixels with the same number of steps that have all bands."""
    good = ~np.isnan(bands[0])
    for b in bands[1:]:
        good &= ~np.isnan(b)
    count = good.sum(axis=1)
    for n in np.unique(count[count > 0]):
        own = np.flatnonzero(count == n)
        at = good[own]
        yield own, np.stack([b[own][at].reshape(len(own), n) for b in bands], axis=2), ts[own][at].reshape(len(own), n)


def _pattern(values, dates, bands: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.asarray(values, float)
    p = p[:, None] if p.ndim == 1 else p.T
    if p.shape != (len(dates), bands):
        raise ValueError("a pattern needs a value for each date, a row for each band")
    return p, np.asarray(dates, float)


def _columns(vs: np.ndarray, more) -> list[np.ndarray]:
    return [vs, *[np.array([[np.nan if x is None else x for x in r] for r in c], float).reshape(vs.shape) for c in more]]


def twdtw(series: DataFrame, pattern: list, dates: list[int], *, bands: tuple[str, ...] = ("vs",), alpha: float = 0.1, beta: float = 0.05, gamma: float = 50.0, max_time_warp: float = 365.0, subsequence: bool = False, abort_threshold: float = float("inf")) -> DataFrame:
    """(pixel, distance, path) of series against a pattern; an unreachable end is a null distance with an empty path.

    bands: the series' array columns; with several, the pattern is a list for each band and the values' distance is the
    Euclidean one. Steps that lack a band are left out. Pixels beyond abort_threshold (but not in subsequence mode) get
    a null distance, most of them without the programme, by their lower bound or by a row that passes the threshold.
    """
    p, pt = _pattern(pattern, dates, len(bands))

    def kernel(ts, vs, *more):
        out: dict = {"distance": np.full(len(vs), np.nan), "path": [[] for _ in vs]}
        for own, v, t in _by_length(ts, _columns(vs, more)):
            if np.isfinite(abort_threshold) and not subsequence:
                may = envelope_bound(v, t, p, pt, max_time_warp) <= abort_threshold
                own, v, t = own[may], v[may], t[may]
                if not len(own):
                    continue
            dist, paths = warp(local_cost(v, t, p, pt, alpha, beta, gamma, max_time_warp), subsequence, True, abort_threshold)
            out["distance"][own] = np.where(np.isfinite(dist), dist, np.nan)
            for i, q in zip(own, paths):
                out["path"][i] = [{"i": a, "j": b} for a, b in q]
        return out

    return run_kernel(series.withColumnRenamed(bands[0], "vs"), kernel, "distance double, path array<struct<i:int,j:int>>", extra=bands[1:])


def classify(series: DataFrame, patterns: dict[str, tuple[list, list[int]]], *, bands: tuple[str, ...] = ("vs",), alpha: float = 0.1, beta: float = 0.05, gamma: float = 50.0, max_time_warp: float = 365.0, subsequence: bool = False) -> DataFrame:
    """(pixel, class, label, distance): the nearest pattern, the first of the dict among equals; none in reach: -1, null
    and infinity. All patterns are matched in one pass over the series; a pattern need not beat what a pixel has reached
    already, so that is where its programme is given up."""
    names = list(patterns)
    shapes = [_pattern(*patterns[n], len(bands)) for n in names]

    def kernel(ts, vs, *more):
        best, cls = np.full(len(vs), np.inf), np.full(len(vs), -1)
        for own, v, t in _by_length(ts, _columns(vs, more)):
            for c, (p, pt) in enumerate(shapes):
                some = np.arange(len(own)) if subsequence else np.flatnonzero(envelope_bound(v, t, p, pt, max_time_warp) < best[own])
                if not len(some):
                    continue
                d = warp(local_cost(v[some], t[some], p, pt, alpha, beta, gamma, max_time_warp), subsequence)
                less = d < best[own[some]]
                best[own[some[less]]], cls[own[some[less]]] = d[less], c
        return {"class": cls.astype(np.int32), "label": [names[c] if c >= 0 else None for c in cls], "distance": best}

    return run_kernel(series.withColumnRenamed(bands[0], "vs"), kernel, "class int, label string, distance double", extra=bands[1:])


def keogh_bound(series: DataFrame, pattern: list[float], window: int) -> DataFrame:
    """(pixel, bound): the lower bound of Keogh (2002) from the pattern's envelope; for series on the pattern's grid. A
    plain expression, so it can prune pixels before the kernel sees them."""
    lo = [min(pattern[max(0, i - window) : i + window + 1]) for i in range(len(pattern))]
    hi = [max(pattern[max(0, i - window) : i + window + 1]) for i in range(len(pattern))]
    env = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(lo, hi)])
    each = F.zip_with("vs", env, lambda v, e: F.coalesce(F.greatest(v - e["b"], e["a"] - v, F.lit(0.0)), F.lit(0.0)))
    return series.select("pixel", F.aggregate(F.slice(each, 1, len(pattern)), F.lit(0.0), lambda s, x: s + x).alias("bound"))


#: Patterns of the queries, on the middle days of months.
DAYS = [15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349]
PATTERNS = {"rise": ([float(100 + 20 * i) for i in range(12)], DAYS), "flat": ([150.0] * 12, DAYS), "fall": ([float(340 - 20 * i) for i in range(12)], DAYS)}


def _years(spark, d):
    """The twelve months of each pixel and year, as a pixel of its own (pixel * 10 + years since the first)."""
    s = to_series(monthly(spark, d), 0, 83)
    day = F.array(*[F.lit(x) for x in DAYS])
    each = s.select("pixel", "vs", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("y"))
    return each.select((F.col("pixel") * 10 + F.col("y")).alias("pixel"), day.alias("ts"), F.transform(F.slice("vs", F.col("y") * 12 + 1, F.lit(12)), lambda v: F.coalesce(v, F.lit(0.0))).alias("vs"))


def _named(df):
    return [F.floor(F.col("pixel") / 10).alias("pixel"), (F.col("pixel") % 10 + YEAR0).cast("int").alias("year")]


def q_distance(spark, d):
    got = twdtw(_years(spark, d), *PATTERNS["rise"])
    return got.select(*_named(got), r4(F.col("distance")).alias("distance"))


def q_subsequence(spark, d):
    got = twdtw(_years(spark, d), PATTERNS["rise"][0][3:6], DAYS[3:6], subsequence=True)
    return got.select(*_named(got), r4(F.col("distance")).alias("distance"))


def q_two_bands(spark, d):
    s = _years(spark, d).withColumn("w", F.transform("vs", lambda v: v / 2.0 + 10.0))
    p = PATTERNS["fall"][0][:5]
    got = twdtw(s, [p, [x / 2.0 for x in p]], DAYS[:5], bands=("vs", "w"))
    return got.select(*_named(got), r4(F.col("distance")).alias("distance"))


def q_abort(spark, d):
    got = twdtw(_years(spark, d), *PATTERNS["flat"], abort_threshold=700.0)
    return got.select(*_named(got), r4(F.col("distance")).alias("distance"))


def q_classify(spark, d):
    got = classify(_years(spark, d), PATTERNS)
    return got.select(*_named(got), F.col("class"), "label", r4(F.col("distance")).alias("distance"))


def q_bound(spark, d):
    got = keogh_bound(_years(spark, d), PATTERNS["rise"][0], 1)
    return got.select(*_named(got), r4(F.col("bound")).alias("bound"))


_SQL_YEARS = f"""mo AS (SELECT l_suppkey AS pixel, CAST((year(l_shipdate) - {YEAR0}) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
y AS (SELECT p.pixel, CAST({YEAR0} + m.k // 12 AS INTEGER) AS year, list(coalesce(mo.v, 0.0) ORDER BY m.k) AS v
  FROM (SELECT DISTINCT pixel FROM mo) p CROSS JOIN range(84) m(k) LEFT JOIN mo ON mo.pixel = p.pixel AND mo.t = m.k GROUP BY p.pixel, m.k // 12)"""


def _sql_warp(pattern: list[float], dates: list[int], *, subsequence: bool = False, cost: str = "abs(v[{i}] - {p})", name: str = "r") -> tuple[str, str]:
    """Tables of the programme's rows, each over the one before, and the last one's name: (pixel, year, v, d, the last
    column of every row so far)."""
    n, m, prev, out = len(DAYS), len(pattern), "y", []
    for i in range(n):
        cur = f"SELECT pixel, year, v{''.join(f', c{j}' for j in range(m)) + ', ends' if i else ''} FROM {prev}"
        for j in range(m):
            value = f"{cost.format(i=i + 1, p=repr(pattern[j]))} + 0.1 / (1 + exp(-0.05 * ({abs(DAYS[i] - dates[j])} - 50.0)))"
            if j == 0 and (i == 0 or subsequence):
                best = "least(0.0, c0)" if i else "0.0"
            else:
                opts = ([f"c{j - 1}"] if i and j else []) + ([f"c{j}"] if i else []) + ([f"d{j - 1}"] if j else [])
                best = opts[0] if len(opts) == 1 else f"least({', '.join(opts)})"
            cur = f"SELECT *, {value} + {best} AS d{j} FROM ({cur})"
        ends = f"list_append(ends, d{m - 1})" if i else f"[d{m - 1}]"
        out.append(f"{name}{i} AS MATERIALIZED (SELECT pixel, year, v, {', '.join(f'd{j} AS c{j}' for j in range(m))}, {ends} AS ends FROM ({cur}))")
        prev = f"{name}{i}"
    return ",\n".join(out), prev


def _sql_distance(value: str, *tables: tuple[str, str]) -> str:
    return f"WITH {_SQL_YEARS},\n{tables[0][0]}\nSELECT pixel, year, {value} AS distance FROM {tables[0][1]}"


def _sql_classify() -> str:
    tables = [_sql_warp(*PATTERNS[n], name=f"p{c}_") for c, n in enumerate(PATTERNS)]
    joins = " JOIN ".join([tables[0][1] + " a", *[f"{t[1]} {x} USING (pixel, year)" for t, x in zip(tables[1:], "bc")]])
    return f"""WITH {_SQL_YEARS},
{(','+chr(10)).join(t[0] for t in tables)},
d AS (SELECT pixel, year, a.ends[12] AS a, b.ends[12] AS b, c.ends[12] AS c FROM {joins})
SELECT pixel, year, CAST(CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS INTEGER) AS class,
  CASE WHEN a <= b AND a <= c THEN 'rise' WHEN b <= c THEN 'flat' ELSE 'fall' END AS label, {sql4('least(a, b, c)')} AS distance FROM d"""


_LOW = [min(PATTERNS["rise"][0][max(0, i - 1) : i + 2]) for i in range(12)]
_HIGH = [max(PATTERNS["rise"][0][max(0, i - 1) : i + 2]) for i in range(12)]
_FALL = PATTERNS["fall"][0][:5]
QUERIES = {
    "twdtw_distance": (q_distance, _sql_distance(sql4("ends[12]"), _sql_warp(*PATTERNS["rise"]))),
    "twdtw_subsequence": (q_subsequence, _sql_distance(sql4("list_min(ends)"), _sql_warp(PATTERNS["rise"][0][3:6], DAYS[3:6], subsequence=True))),
    "twdtw_two_bands": (q_two_bands, _sql_distance(sql4("ends[12]"), _sql_warp(_FALL, DAYS[:5], cost="sqrt((v[{i}] - {p}) * (v[{i}] - {p}) + (v[{i}] / 2.0 + 10.0 - {p} / 2.0) * (v[{i}] / 2.0 + 10.0 - {p} / 2.0))"))),
    "twdtw_abort": (q_abort, _sql_distance(f"CASE WHEN ends[12] <= 700.0 THEN {sql4('ends[12]')} END", _sql_warp(*PATTERNS["flat"]))),
    "twdtw_classify": (q_classify, _sql_classify()),
    "twdtw_keogh": (q_bound, f"WITH {_SQL_YEARS} SELECT pixel, year, {sql4(' + '.join(f'greatest(v[{i + 1}] - {h}, {l} - v[{i + 1}], 0.0)' for i, (l, h) in enumerate(zip(_LOW, _HIGH))))} AS bound FROM y"),
}
