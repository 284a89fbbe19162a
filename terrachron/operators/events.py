"""Disturbance events of vertex series, and consumers of segment models: prediction, synthetic images, water masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cubes import ANNUAL, annual, r4, sql4, table

OMEGA = 2 * math.pi / 365.25


def extract_events(vertices: DataFrame, event: str = "loss", sort_by: str = "greatest", *, min_magnitude: float = 0.0, min_duration: int = 1, pre_val: float = 0.0) -> DataFrame:
    """(pixel, yod, magnitude, duration, pre_val, post_val, rate[, dsnr]): the first-ranked segment of each pixel.

    vertices: pixel, v array of (year, value) in order[, rmse]. A segment is a change between neighbours in the event's
    direction; ties go to the earliest. Pixels without an event give zeros. Any other sort_by is `greatest`. Segments
    are ranked within the pixel's row.
    """
    sign = {"loss": -1.0, "gain": 1.0}[event]
    if sort_by == "dsnr" and "rmse" not in vertices.columns:
        raise ValueError("dsnr needs rmse")
    rmse = F.col("rmse") if "rmse" in vertices.columns else F.lit(None).cast("double")

    def segment(a: Column, i: Column) -> Column:
        b = F.get("v", i + 1)
        mag, dur = sign * (b["value"] - a["value"]), b["year"] - a["year"]
        score = {"newest": a["year"].cast("double"), "fastest": mag / dur, "longest": dur.cast("double"), "dsnr": F.try_divide(mag, rmse)}.get(sort_by, mag)
        ok = (mag >= min_magnitude) & (mag >= 0) & (dur >= min_duration) & (a["value"] >= pre_val)
        return F.struct(ok.alias("ok"), score.alias("score"), (-i).alias("first"), a["year"].alias("yod"), mag.alias("magnitude"), dur.alias("duration"), a["value"].alias("pre_val"), b["value"].alias("post_val"), (mag / dur).alias("rate"))

    n = F.size("v")
    seg = F.when(n >= 2, F.filter(F.transform(F.slice("v", F.lit(1), F.greatest(n - 1, F.lit(0))), segment), lambda s: s["ok"]))
    best = vertices.select("pixel", rmse.alias("rmse"), F.array_max(seg).alias("s"))
    zero = lambda c, t: F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast(t).alias(c)
    out = [zero("yod", "int"), zero("magnitude", "double"), zero("duration", "int"), zero("pre_val", "double"), zero("post_val", "double"), zero("rate", "double")]
    if "rmse" in vertices.columns:
        out.append(F.coalesce(F.try_divide(F.col("s.magnitude"), F.col("rmse")), F.lit(0.0)).alias("dsnr"))
    return best.select("pixel", *out)


def predict(c: Column, day: Column) -> Column:
    """Value of an eight-coefficient harmonic model (constant, slope, three harmonics) at an ordinal day."""
    t = day + 366.0
    out = F.get(c, F.lit(0)) + F.get(c, F.lit(1)) * t
    for k in (1, 2, 3):
        out = out + F.get(c, F.lit(2 * k)) * F.cos(k * OMEGA * t) + F.get(c, F.lit(2 * k + 1)) * F.sin(k * OMEGA * t)
    return out


def synthetic(segments: DataFrame, day: int) -> DataFrame:
    """(pixel, band, value): the image of a day. segments: pixel, segs array of (t_start, t_end, coefs[band][8]).
    The first segment that covers the day, else the first of all."""
    hit = F.filter("segs", lambda s: (s["t_start"] <= day) & (s["t_end"] >= day))
    seg = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))).otherwise(F.get("segs", F.lit(0)))
    return segments.select("pixel", F.posexplode(seg["coefs"]).alias("band", "c")).select("pixel", "band", predict(F.col("c"), F.lit(float(day))).alias("value"))


def water_mask(segments: DataFrame, green: int = 1, swir: int = 4, limit: float = 500.0) -> DataFrame:
    """(pixel, water): the first segment's green intercept is above its short-wave one, which is below the limit; not
    both zero."""
    g, s = [F.get("segs", F.lit(0))["coefs"][b][0] for b in (green, swir)]
    water = (g > s) & (s < limit) & ~((g == 0) & (s == 0))
    return segments.select("pixel", F.coalesce(water, F.lit(False)).cast("int").alias("water"))


# ---- queries


def _vertices(spark, d):
    a = annual(spark, d)
    v = F.array_sort(F.collect_list(F.struct(F.col("t").alias("year"), F.col("v").alias("value"))))
    return a.groupBy("pixel").agg(v.alias("v"), (F.max("v") / 100).alias("rmse"))


def _events(event, sort_by):
    def q(spark, d):
        e = extract_events(_vertices(spark, d), event, sort_by, min_magnitude=50.0)
        return e.select("pixel", "yod", "magnitude", "duration", "pre_val", "post_val", "rate", r4(F.col("dsnr")).alias("dsnr"))

    return q


def _events_sql(sign: str, score: str) -> str:
    return f"""WITH {ANNUAL}, r AS (SELECT pixel, max(v) / 100 AS rmse FROM annual GROUP BY pixel),
s AS (SELECT pixel, t AS yod, lead(t) OVER w - t AS dur, {sign} (lead(v) OVER w - v) AS mag, v AS pre, lead(v) OVER w AS post, rmse FROM annual JOIN r USING (pixel) WINDOW w AS (PARTITION BY pixel ORDER BY t)),
k AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY {score} DESC, yod) AS rn FROM s WHERE dur IS NOT NULL AND mag >= 50)
SELECT r.pixel, CAST(coalesce(yod, 0) AS INTEGER) AS yod, coalesce(mag, 0.0) AS magnitude, CAST(coalesce(dur, 0) AS INTEGER) AS duration, coalesce(pre, 0.0) AS pre_val, coalesce(post, 0.0) AS post_val, coalesce(mag / dur, 0.0) AS rate, {sql4('coalesce(mag / k.rmse, 0.0)')} AS dsnr
FROM r LEFT JOIN k ON k.pixel = r.pixel AND rn = 1"""


def _segments(spark, d):
    """Two segments and two bands for each supplier, made of its key and balance."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel"), (F.col("s_suppkey") % 7 * 100.0).alias("b"))
    seg = lambda a, z, k: F.struct(F.lit(a).alias("t_start"), F.lit(z).alias("t_end"), F.array(*[F.array((F.col("b") + 10.0 * band + k), F.lit(0.001), *[F.lit(float(h + band)) for h in range(6)]) for band in range(2)]).alias("coefs"))
    return s.select("pixel", F.array(seg(730000, 731000, 1.0), seg(731100, 733000, 700.0)).alias("segs"))


def q_predict(spark, d):
    s = _segments(spark, d).select("pixel", F.posexplode(F.get("segs", F.lit(0))["coefs"]).alias("band", "c"))
    return s.select("pixel", "band", r4(predict(F.col("c"), F.lit(730500.0))).alias("value"))


def _synthetic(day):
    def q(spark, d):
        return synthetic(_segments(spark, d), day).select("pixel", "band", r4(F.col("value")).alias("value"))

    return q


def q_water(spark, d):
    return water_mask(_segments(spark, d), 1, 0, 500.0)


def _predict_sql(day: int, k: float) -> str:
    t = day + 366
    h = " + ".join(f"({2 * j - 2} + band) * cos({j} * {OMEGA!r} * {t}.0) + ({2 * j - 1} + band) * sin({j} * {OMEGA!r} * {t}.0)" for j in (1, 2, 3))
    return f"SELECT s_suppkey AS pixel, CAST(band AS INTEGER) AS band, {sql4(f's_suppkey % 7 * 100.0 + 10.0 * band + {k} + 0.001 * {t} + {h}')} AS value FROM supplier, (VALUES (0), (1)) x(band)"


_SCORES = {"greatest": "mag", "newest": "yod", "fastest": "mag / dur", "longest": "dur", "dsnr": "mag / rmse"}
QUERIES = {f"events_{k}": (_events("loss", k), _events_sql("-", s)) for k, s in _SCORES.items()} | {
    "events_gain": (_events("gain", "greatest"), _events_sql("", "mag")),
    "ccdc_predict": (q_predict, _predict_sql(730500, 1.0)),
    "synthetic_image": (_synthetic(732000), _predict_sql(732000, 700.0)),
    "synthetic_image_gap": (_synthetic(731050), _predict_sql(731050, 1.0)),
    "water_mask": (q_water, "SELECT s_suppkey AS pixel, CAST((s_suppkey % 7 * 100.0 + 11 > s_suppkey % 7 * 100.0 + 1) AND s_suppkey % 7 * 100.0 + 1 < 500 AS INTEGER) AS water FROM supplier"),
}
