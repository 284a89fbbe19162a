"""Continuous change detection with harmonic models (Zhu and Woodcock 2014; Zhu, Woodcock and Olofsson 2012 for the
multi-temporal mask).

A pixel is one row: ordinal days, quality codes (0 and 1 clear, 2 water, 3 snow, 4 cloud, 255 fill) and the bands'
values times 10000. The scan is sequential in time and runs in numpy within the row.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_quantile, lassos, robust_fit, robust_fits
from ..sources.cubes import irregular, monthly, r4, to_series

W = 2 * math.pi / 365.25
LAMBDA, LEAST, LEAST_YEARS = 20.0, 12, 1.0


@dataclass
class Settings:
    consecutive: int = 6
    chi2_prob: float = 0.99
    tmax_prob: float = 0.999999
    detection_bands: tuple[int, ...] = (1, 2, 3, 4, 5)
    tmask_bands: tuple[int, int] = (1, 4)
    num_c: int = 8
    valid_range: tuple[float, float] = (0.0, 10000.0)
    cuts: tuple[float, float] = field(init=False)

    def __post_init__(self):
        k = len(self.detection_bands)
        self.cuts = chi2_quantile(self.chi2_prob, k), chi2_quantile(self.tmax_prob, k)


def terms(t: np.ndarray, c: int) -> np.ndarray:
    """Slope and harmonics of the first c coefficients (without the constant)."""
    cols = [t] + [f(k * W * t) for k in range(1, (c - 2) // 2 + 1) for f in (np.cos, np.sin)]
    return np.stack(cols, axis=1)


def n_coefficients(n: int, most: int) -> int:
    return min(4 if n < 18 else 6 if n < 24 else 8, most)


class Fitted:
    """One model a band, of c coefficients b padded to 8. x (steps, 7) are the terms of 8 coefficients, y (bands, steps)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: int, b: np.ndarray):
        self.coef = np.zeros((len(y), 8))
        self.coef[:, :c] = b
        self.rest = y - self.at(x)
        self.rmse = np.sqrt((self.rest**2).sum(axis=1) / max(1, len(x) - c))

    def at(self, x: np.ndarray) -> np.ndarray:
        return self.coef[:, :1] + self.coef[:, 1:] @ x.T


def fits(asked: list[tuple[np.ndarray, np.ndarray, int]]) -> list[Fitted]:
    """Models of many (x, y, c), made together."""
    found = lassos([(x[:, : c - 1], y) for x, y, c in asked], LAMBDA)
    return [Fitted(*ask, b) for ask, b in zip(asked, found)]


def multitemporal_masks(asked: list[tuple[np.ndarray, np.ndarray, float, np.ndarray]], limit: float = 3.89) -> list[np.ndarray]:
    """True where a robust annual fit calls an observation cloud or shadow, for many (times, green and swir, years, spread
    of both)."""
    size = np.array([len(t) for t, *_ in asked])
    ok = np.arange(size.max(initial=0)) < size[:, None]
    t, y = np.zeros(ok.shape), np.zeros((2, *ok.shape))
    t[ok] = np.concatenate([t for t, *_ in asked])
    y[:, ok] = np.concatenate([v for _, v, *_ in asked], axis=1)
    n = np.array([max(1, math.ceil(years)) for *_, years, _ in asked])[:, None]
    x = np.stack([np.ones(t.shape), np.cos(W * t), np.sin(W * t), np.cos(W / n * t), np.sin(W / n * t)], axis=2)
    bad = np.zeros(ok.shape, bool)
    for v, s in zip(y, np.array([s for *_, s in asked]).T):
        bad |= np.abs(v - (x @ robust_fits(x, v, ok)[..., None])[..., 0]) > limit * s[:, None]
    bad &= (size > x.shape[2])[:, None]
    return [row[:k] for row, k in zip(bad, size)]


def _segment(f: Fitted, t: np.ndarray, a: int, b: int, brk: float, mag: np.ndarray, prob: float, category: int, rmse: np.ndarray | None = None) -> dict:
    return {"t_start": int(t[a]), "t_end": int(t[b]), "t_break": int(brk), "coefs": f.coef.tolist(), "rmse": (f.rmse if rmse is None else rmse).tolist(), "magnitude": mag.tolist(), "change_prob": float(prob), "category": category, "num_obs": b - a + 1}


def detect(days: np.ndarray, qa: np.ndarray, bands: np.ndarray, s: Settings) -> list[dict]:
    """Segments of one pixel. bands: (band, time); t in the models is the ordinal day plus 366."""
    return detect_all([(days, qa, bands)], s)[0]


def detect_all(pixels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], s: Settings) -> list[list[dict]]:
    """Segments of many pixels. Their scans go on side by side; what they ask for is fitted together."""
    scans, out = [_scan(*p, s) for p in pixels], [[] for _ in pixels]
    told: list[tuple[int, object]] = [(k, None) for k in range(len(scans))]
    while told:
        asked: dict = {fits: [], multitemporal_masks: []}
        for k, answer in told:
            try:
                what, ask = scans[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
            else:
                asked[what].append((k, ask))
        told = [x for what, asks in asked.items() if asks for x in zip([k for k, _ in asks], what([ask for _, ask in asks]))]
    return out


def _scan(days: np.ndarray, qa: np.ndarray, bands: np.ndarray, s: Settings) -> Generator[tuple, object, list[dict]]:
    """detect as a scan that yields (function, what it asks of it), is sent the answer, and returns the segments."""
    bands = np.asarray(bands, float)
    qa = np.where(np.isnan(bands).any(axis=0), 255, qa)
    seen = qa < 255
    if not len(days) or seen.sum() < 0.5 * len(days):
        return []
    inside = ((bands > s.valid_range[0]) & (bands < s.valid_range[1])).all(axis=0)
    clear, snow = seen & (qa <= 1), seen & (qa == 3)
    share = clear.sum() / seen.sum()
    nb, zero = len(bands), np.zeros(len(bands))
    if share < 0.25:
        category = 44
        if snow.sum() / max(1, (clear | snow).sum()) > 0.75:
            use, category = (snow | clear) & inside, 54
        else:
            use = seen & inside
            if use.sum():
                use &= bands[s.tmask_bands[0]] < np.median(bands[s.tmask_bands[0]][use]) + 400
        t, at = np.unique(days[use], return_index=True)
        if len(t) < LEAST:
            return []
        f = yield fits, (terms(t + 366.0, 8), bands[:, use][:, at], 4)
        return [_segment(f, t, 0, len(t) - 1, 0, zero, 0, category)]
    use = clear & inside
    t, at = np.unique(days[use], return_index=True)
    y = bands[:, use][:, at]
    if len(t) < LEAST + s.consecutive:
        return []
    spread = np.maximum(np.median(np.abs(np.diff(y, axis=1)), axis=1), 1e-6)
    det, (cut, top) = list(s.detection_bands), s.cuts
    out: list[dict] = []
    x, rest = terms(t + 366.0, 8), y

    def away(model: Fitted, scale: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences of observations from the model, and their squared normalised lengths."""
        d = y[:, i] - model.at(x[i])
        return d, ((d[det] / scale[det, None]) ** 2).sum(axis=0)

    def drop(k: int | np.ndarray) -> None:
        nonlocal t, y, x, rest
        t, y, x, rest = np.delete(t, k), np.delete(y, k, axis=1), np.delete(x, k, axis=0), np.delete(rest, k, axis=1)

    start, i, last, model, fitted_n, rmse = 0, LEAST - 1, 0, None, 0, spread
    while i + s.consecutive < len(t):
        span, years = i - start + 1, (t[i] - t[start]) / 365.25
        if span < LEAST or years < LEAST_YEARS:
            i += 1
            continue
        if model is None:
            w = np.arange(start, i + s.consecutive + 1)
            two = list(s.tmask_bands)
            bad = yield multitemporal_masks, (t[w] + 366.0, y[two][:, w], (t[w[-1]] - t[w[0]]) / 365.25, spread[two])
            gone = w[: span][bad[:span]]
            if span - len(gone) < LEAST:
                i += 1
                continue
            if len(gone):
                end = t[i]
                drop(gone)
                i = int(np.searchsorted(t, end, "right")) - 1
                if i - start + 1 < LEAST or (t[i] - t[start]) / 365.25 < LEAST_YEARS:
                    i += 1
                    continue
            f = yield fits, (x[start : i + 1], y[:, start : i + 1], 4)
            scale = np.maximum(spread, f.rmse)
            v = (np.abs(f.coef[:, 1] * (t[i] - t[start])) + np.abs(f.rest[:, 0]) + np.abs(f.rest[:, -1])) / scale
            if (v[det] ** 2).sum() > cut:
                start, i = start + 1, i + 1
                continue
            # look back over what earlier starts left out
            k = start - 1
            while k >= last:
                back = np.arange(k, max(last - 1, k - s.consecutive), -1)
                _, far = away(f, scale, back)
                if (far > cut).all():
                    break
                if far[0] > top:
                    drop(k)
                    start, i = start - 1, i - 1
                else:
                    start = k
                k -= 1
            if not out and start - last >= s.consecutive:
                early = yield fits, (x[last:start], y[:, last:start], 4)
                d, far = away(f, scale, np.arange(last, start))
                out.append(_segment(early, t, last, start - 1, t[start], -np.median(d, axis=1), 1.0, 14))
            model, fitted_n = f, 0
        n = i - start + 1
        c = n_coefficients(n, s.num_c)
        if fitted_n == 0 or n >= 1.33 * fitted_n or (n < 24 and n > fitted_n):
            model, fitted_n = (yield fits, (x[start : i + 1], y[:, start : i + 1], c)), n
            rmse, rest = model.rmse, y - model.at(x)
        # this step and those up to the next fit, judged together
        stop, near = i + 1, rmse[:, None]
        if n >= 24:
            while stop + s.consecutive < len(t) and stop - start + 1 < 1.33 * fitted_n:
                stop += 1
            steps = np.arange(i, stop)[:, None]
            doy = np.abs((t[start:stop] - t[steps + s.consecutive] + 182.6) % 365.25 - 182.6)
            doy[np.arange(start, stop) > steps] = np.inf
            near = np.sqrt((rest[:, start:stop][:, np.argsort(doy, axis=1, kind="stable")[:, :24]] ** 2).sum(axis=2) / max(1, 24 - c))
            d = rest[:, steps + np.arange(1, s.consecutive + 1)]
        else:
            d = rest[:, None, i + 1 : i + 1 + s.consecutive]
        far = ((d[det] / np.maximum(spread[:, None], near)[det, :, None]) ** 2).sum(axis=0)
        found = np.flatnonzero((far.min(axis=1) > cut) | (far[:, 0] > top))
        if not len(found):
            i = stop
            continue
        k = found[0]
        i += int(k)
        if far[k].min() > cut:
            out.append(_segment(model, t, start, i, t[i + 1], np.median(d[:, k], axis=1), 1.0, c, near[:, k]))
            last = start = i + 1
            model, fitted_n = None, 0
            i += LEAST
        else:
            drop(i + 1)
    if model is not None:
        end = len(t) - 1
        tail = np.arange(max(start, end - s.consecutive + 1), end + 1)
        d, far = away(model, np.maximum(spread, rmse), tail)
        run = 0
        while run < len(far) and far[len(far) - 1 - run] > cut:
            run += 1
        stop = end - run
        m = model
        if stop - start + 1 >= LEAST:
            m = yield fits, (x[start : stop + 1], y[:, start : stop + 1], n_coefficients(stop - start + 1, s.num_c))
        mag = np.median(d[:, len(far) - run :], axis=1) if run else zero
        out.append(_segment(m, t, start, stop, t[stop + 1] if run else 0, mag, run / s.consecutive, n_coefficients(stop - start + 1, s.num_c)))
    elif len(t) - start >= LEAST:
        f = yield fits, (x[start:], y[:, start:], 4)
        out.append(_segment(f, t, start, len(t) - 1, 0, zero, 0, 24))
    return out


#: Pixels whose scans a worker holds at a time.
PIXELS = 1000
SEGMENT = "struct<t_start:int,t_end:int,t_break:int,coefs:array<array<double>>,rmse:array<double>,magnitude:array<double>,change_prob:double,category:int,num_obs:int>"


def ccdc(pixels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(pixel, segs) of rows (pixel, ts, qa, bands array of arrays): one row a pixel, its segments in time order."""

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(f"array<{SEGMENT}>"))
    none = np.empty(0, np.int64), np.empty(0), np.empty((1, 0))

    def run(it):
        for b in (batch.slice(k, PIXELS) for batch in it for k in range(0, batch.num_rows, PIXELS)):
            rows = []
            for ts, qa, bands in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                v = np.array([[np.nan if x is None else x for x in band] for band in bands or []], float)
                rows.append((np.array(ts or [], np.int64), np.array([255 if q is None else q for q in qa or []]), v) if len(v) else none)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(detect_all(rows, settings), kind)], names=["pixel", "segs"])

    return pixels.select("pixel", "ts", "qa", "bands").mapInArrow(run, f"pixel bigint, segs array<{SEGMENT}>")


def gate(pixels: DataFrame) -> DataFrame:
    """(pixel, n, n_seen, clear_share, snow_share, path): which way the detector takes, from the quality codes alone; a
    plain expression, so pixels without data never reach Python."""
    count = lambda f: F.size(F.filter("qa", f))
    seen, clear, snow = count(lambda q: q < 255), count(lambda q: q <= 1), count(lambda q: q == 3)
    df = pixels.select("pixel", F.size("qa").alias("n"), seen.alias("n_seen"), clear.alias("c"), snow.alias("s"))
    cs, ss = F.try_divide(F.col("c").cast("double"), F.col("n_seen")), F.try_divide(F.col("s").cast("double"), F.col("c") + F.col("s"))
    path = F.when(F.col("n_seen") < 0.5 * F.col("n"), "none").when(cs >= 0.25, "detect").when(ss > 0.75, "snow").otherwise("fallback")
    return df.select("pixel", "n", "n_seen", cs.alias("clear_share"), ss.alias("snow_share"), path.alias("path"))


def tmask_pixel(days: np.ndarray, green: np.ndarray, swir: np.ndarray, scale: float = 10000.0) -> np.ndarray:
    """True where clear: a Huber fit of trend and season, cloud if green is 0.04 above it, shadow if swir is 0.04 below.
    Fewer than five observations are all clear."""
    if len(days) < 5:
        return np.ones(len(days), bool)
    t = np.asarray(days, float)
    x = np.stack([np.ones(len(t)), (t - t.mean()) / 365.25, np.cos(W * t), np.sin(W * t)], axis=1)
    r = [v / scale - x @ robust_fit(x, v / scale, "huber", 1.35, 100) for v in (np.asarray(green, float), np.asarray(swir, float))]
    return ~((r[0] > 0.04) | (r[1] < -0.04))


def tmask_pixels(days: np.ndarray, green: np.ndarray, swir: np.ndarray, ok: np.ndarray, scale: float = 10000.0) -> np.ndarray:
    """tmask_pixel of many, all (pixels, steps), over the steps that are ok; the others stay clear."""
    t = days.astype(float)
    mean = (t * ok).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
    x = np.stack([np.ones(t.shape), (t - mean[:, None]) / 365.25, np.cos(W * t), np.sin(W * t)], axis=2)
    r = [v / scale - (x @ robust_fits(x, v / scale, ok, "huber", 1.35, 100)[..., None])[..., 0] for v in (green, swir)]
    return ~ok | ~((r[0] > 0.04) | (r[1] < -0.04))


#: Pixels times steps that tmask fits together.
CELLS = 1 << 16


def tmask(series: DataFrame, scale: float = 10000.0) -> DataFrame:
    """(pixel, ts, clear) of rows (pixel, ts, vs green, swir). Only where both are above 0 is anything judged, and only if
    there are more than five such times; all else stays clear."""
    from ..functions.kernels import run_kernel

    def kernel(ts, vs, swir):
        clear, n = [], max(1, CELLS // max(1, ts.shape[1]))
        for k in range(0, len(ts), n):
            t, g = ts[k : k + n], vs[k : k + n]
            w = np.array([[np.nan if x is None else x for x in row] for row in swir[k : k + n]], float).reshape(g.shape)
            ok = (g > 0) & (w > 0)
            many = np.flatnonzero(ok.sum(axis=1) > 5)
            c = np.ones(t.shape, bool)
            if len(many):
                c[many] = tmask_pixels(t[many], g[many], w[many], ok[many], scale)
            clear += c.tolist()
        return {"ts": ts, "clear": clear}

    return run_kernel(series, kernel, "ts array<int>, clear array<boolean>", extra=("swir",))


# ---- queries


def _pixels(spark, d):
    """Users as pixels: their days, one band a kind of event, six bands by repeating one, days stretched to years."""
    w = irregular(spark, d).groupBy("pixel", "t").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(b) for b in ("click", "error", "purchase", "signup", "view")])
    day = F.lit(730000) + F.dayofmonth("t") * 40
    fill = lambda c: F.coalesce(F.col(c), F.lit(5.0)) * 10 + 500
    rows = w.select("pixel", F.struct(day.alias("t"), F.when(F.col("view").isNull(), 255).otherwise((F.col("pixel") + F.dayofmonth("t")) % 5).cast("int").alias("q"), F.array(*[fill(c) for c in ("click", "error", "purchase", "signup", "view", "click")]).alias("b")).alias("s"))
    g = rows.groupBy("pixel").agg(F.array_sort(F.collect_list("s")).alias("s"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform("s", lambda x: F.get(x["b"], k)))
    return g.select("pixel", F.transform("s", lambda x: x["t"]).alias("ts"), F.transform("s", lambda x: x["q"]).alias("qa"), bands.alias("bands"))


def _stacks(spark, d):
    """Suppliers as pixels: months as days, six bands made of their quantities, every second one with a step in 1999."""
    m = to_series(monthly(spark, d), 0, 82)
    days = F.transform("ts", lambda t: (t * 30.4375).cast("int") + 728294)

    def band(b):
        step = lambda i: F.when((i >= 50) & (F.col("pixel") % 2 == 0), float((-1) ** b * 150 * (b + 1))).otherwise(0.0)
        return F.transform("vs", lambda v, i: F.coalesce(v, F.lit(0.0)) * (0.05 * (b + 1)) + 400.0 * (b + 1) + step(i))

    bands = [band(b) for b in range(6)]
    qa = F.transform("vs", lambda v, i: F.when(v.isNull(), 255).otherwise(F.when((i + F.col("pixel")) % 13 == 0, 4).otherwise(0)).cast("int"))
    return m.select("pixel", days.alias("ts"), qa.alias("qa"), F.array(*bands).alias("bands"))


def q_ccdc(spark, d):
    e = ccdc(_stacks(spark, d)).select("pixel", F.posexplode("segs").alias("segment", "s"))
    rounded = lambda c: F.transform(c, lambda x: r4(x))
    return e.select("pixel", "segment", "s.t_start", "s.t_end", "s.t_break", "s.category", "s.num_obs", r4(F.col("s.change_prob")).alias("change_prob"), rounded("s.rmse").alias("rmse"), rounded("s.magnitude").alias("magnitude"), F.transform("s.coefs", rounded).alias("coefs"))


def q_gate(spark, d):
    g = gate(_pixels(spark, d))
    return g.select("pixel", "n", "n_seen", r4(F.col("clear_share")).alias("clear_share"), r4(F.col("snow_share")).alias("snow_share"), "path")


def q_tmask(spark, d):
    p = _pixels(spark, d)
    s = p.select("pixel", "ts", F.get("bands", F.lit(1)).alias("vs"), F.get("bands", F.lit(4)).alias("swir"))
    e = tmask(s, 1000.0).select("pixel", F.explode(F.arrays_zip("ts", "clear")).alias("e"))
    return e.select("pixel", F.col("e.ts").alias("t"), F.col("e.clear").alias("clear"))


_GATE = """WITH ev AS (SELECT user_id AS pixel, CAST(ts AS DATE) AS t, event_type AS band, max(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT pixel, t, max(v) FILTER (band = 'view') AS v FROM ev GROUP BY ALL), q AS (SELECT pixel, CASE WHEN v IS NULL THEN 255 ELSE (pixel + day(t)) % 5 END AS q FROM w),
g AS (SELECT pixel, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (q < 255) AS INTEGER) AS n_seen, count(*) FILTER (q <= 1) AS c, count(*) FILTER (q = 3) AS s FROM q GROUP BY pixel)
SELECT pixel, n, n_seen, floor(c / nullif(n_seen, 0) * 10000.0 + 0.5) / 10000.0 AS clear_share, floor(s / nullif(c + s, 0) * 10000.0 + 0.5) / 10000.0 AS snow_share,
CASE WHEN n_seen < 0.5 * n THEN 'none' WHEN c / nullif(n_seen, 0) >= 0.25 THEN 'detect' WHEN s / nullif(c + s, 0) > 0.75 THEN 'snow' ELSE 'fallback' END AS path FROM g"""
QUERIES = {"ccdc": (q_ccdc, None), "ccdc_gate": (q_gate, _GATE), "tmask": (q_tmask, None)}
