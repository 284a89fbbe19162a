"""Compositing and regularisation: medians, medoids, seasons, spines and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cubes import ANNUAL, EVENTS, MONTHLY, SPARSE, annual, irregular, monthly, r4, spine, sql4, table


def median_composite(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Null-skipping median of each pixel, group and band; all null stays null."""
    return obs.groupBy("pixel", *by, "band").agg(F.median("v").alias("v"))


def medoid_composite(obs: DataFrame, by: tuple[str, ...] = (), *, strict: int | None = None) -> DataFrame:
    """(pixel, *by, t, band, v): the observed time nearest to the bands' medians (squared distance over its bands).

    Times with no value can't win; the earliest wins ties. strict: only times with that many bands compete, and a group
    without one gives no row. The bands of a group are gathered once; distances and the choice are made in its row.
    """
    keys = ["pixel", *by]
    meds = Window.partitionBy(*keys, "band")
    w = obs.where("v is not null").withColumn("m", F.median("v").over(meds))
    times = w.groupBy(*keys, "t").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("d"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("band", "v")).alias("o"))
    if strict is not None:
        times = times.where(F.col("n") == strict)
    best = times.groupBy(*keys).agg(F.min_by(F.struct("t", "o"), F.struct("d", "t")).alias("b"))
    return best.select(*keys, F.col("b.t").alias("t"), F.explode("b.o").alias("o")).select(*keys, "t", F.col("o.band").alias("band"), F.col("o.v").alias("v"))


def season(obs: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Rows of the season first..last (month, day), with its year; a season over New Year is named by its first year."""
    md = F.month("t") * 100 + F.dayofmonth("t")
    a, b = first[0] * 100 + first[1], last[0] * 100 + last[1]
    if a <= b:
        return obs.where(md.between(a, b)).withColumn("season_year", F.year("t"))
    return obs.where((md >= a) | (md <= b)).withColumn("season_year", F.year("t") - (md <= b).cast("int"))


def regularise(obs: DataFrame, days: int = 16, method: str = "median") -> DataFrame:
    """(pixel, bin_start, band, v): bins of so many days from the first day of the whole cube; empty bins are null.

    The first and last day are one small aggregate; bins are laid out in the pixel's row by band.
    """
    ends = obs.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    if ends["t0"] is None:
        return obs.select("pixel", F.col("t").alias("bin_start"), "band", "v").limit(0)
    t0, bins = ends["t0"], (ends["t1"] - ends["t0"]).days // days
    b = obs.withColumn("k", F.floor(F.datediff("t", F.lit(t0)) / days).cast("int"))
    if method == "median":
        got = median_composite(b, ("k",))
    elif method == "medoid":
        got = medoid_composite(b, ("k",)).drop("t")
    else:
        raise ValueError(f"unknown method {method!r}")
    full = obs.select("pixel", "band").distinct().select("pixel", "band", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("k"))
    out = full.join(got, ["pixel", "band", "k"], "left")
    return out.select("pixel", F.date_add(F.lit(t0), F.col("k") * days).alias("bin_start"), "band", "v")


def regularise_calendar(obs: DataFrame, unit: str = "month", method: str = "median") -> DataFrame:
    """As regularise, with calendar months or years as bins (occupied ones only)."""
    b = obs.withColumn("bin_start", F.trunc("t", unit))
    return median_composite(b, ("bin_start",)) if method == "median" else medoid_composite(b, ("bin_start",)).drop("t")


def yearly_medoid(obs: DataFrame, bands: int) -> DataFrame:
    """One strict medoid a calendar year, dated to the first of July."""
    got = medoid_composite(obs.withColumn("year", F.year("t")), ("year",), strict=bands)
    return got.select("pixel", F.make_date("year", F.lit(7), F.lit(1)).alias("t"), "band", "v")


def annual_composites(obs: DataFrame, first: int, last: int, *, season_days: tuple[tuple[int, int], tuple[int, int]] = ((6, 1), (9, 30)), method: str = "median", scenes: DataFrame | None = None) -> DataFrame:
    """(pixel, year, band, v): one composite a year of the clear observations of the season, for every year from first to
    last; a year without any is null.

    obs: pixel, t date, band, v, and if they are there clear (false: masked) and scene, which scenes (scene, band, scale,
    offset) rescale. The order is mask, scale, season, reduction, years. Raises if no observation is left at all, which
    one aggregate tells.
    """
    from ..functions.optics import rescale

    o = obs.where("clear") if "clear" in obs.columns else obs
    o = rescale(o, scenes) if scenes is not None else o
    o = season(o.where("v is not null"), *season_days).where(F.col("season_year").between(first, last))
    if o.isEmpty():
        raise ValueError("no clear observation in the seasons")
    if method == "median":
        got = median_composite(o, ("season_year",))
    elif method == "medoid":
        got = medoid_composite(o, ("season_year",)).drop("t")
    else:
        raise ValueError(f"unknown method {method!r}")
    full = obs.select("pixel", "band").distinct().select("pixel", "band", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("season_year"))
    return full.join(got, ["pixel", "band", "season_year"], "left").select("pixel", F.col("season_year").alias("year"), "band", "v")


# ---- queries


def q_median(spark, d):
    return median_composite(irregular(spark, d).withColumn("year", F.year("t")), ("year",)).select("pixel", "year", "band", r4(F.col("v")).alias("v"))


def q_medoid(spark, d):
    return medoid_composite(irregular(spark, d).withColumn("week", F.weekofyear("t")), ("week",)).select("pixel", "week", "t", "band", "v")


def q_strict(spark, d):
    return medoid_composite(irregular(spark, d), strict=3).select("pixel", "t", "band", "v")


def q_yearly(spark, d):
    return yearly_medoid(irregular(spark, d).where("band <> 'view'"), 3).select("pixel", "t", "band", "v")


def q_spine(spark, d):
    return spine(annual(spark, d, "l_partkey"), 1995, 2001).select("pixel", F.col("t").alias("year"), F.col("v").alias("value"))


def q_season(spark, d):
    m = monthly(spark, d).withColumn("t", F.make_date(1995 + F.floor(F.col("t") / 12).cast("int"), (F.col("t") % 12 + 1).cast("int"), F.lit(1)))
    return season(m, (12, 1), (2, 28)).groupBy("pixel", "season_year").agg(F.median("v").alias("value"))


def q_bins(spark, d):
    return regularise(irregular(spark, d), 16).select("pixel", "bin_start", "band", r4(F.col("v")).alias("v"))


def q_bins_medoid(spark, d):
    return regularise(irregular(spark, d), 16, "medoid").select("pixel", "bin_start", "band", "v")


def _medoid_sql(key: str, strict: str = "") -> str:
    g = f", {key}" if key else ""
    return f"""m AS (SELECT *, median(v) OVER (PARTITION BY pixel{g}, band) AS md FROM o),
s AS (SELECT pixel{g}, t, sum((v - md) * (v - md)) AS dist, count(*) AS n FROM m GROUP BY pixel{g}, t),
w AS (SELECT *, row_number() OVER (PARTITION BY pixel{g} ORDER BY dist, t) AS rn FROM s {strict}),
best AS (SELECT o.* FROM o JOIN w ON w.pixel = o.pixel AND w.t = o.t AND rn = 1{f" AND w.{key} = o.{key}" if key else ""})"""


def _scenes(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.to_date("l_shipdate").alias("t"), F.col("l_returnflag").alias("band"), "l_quantity")
    o = o.groupBy("pixel", "t", "band").agg(F.max("l_quantity").alias("v"))
    return o.withColumn("clear", F.dayofmonth("t") % 7 != 0).withColumn("scene", F.dayofmonth("t") % 2)


def _composites(method):
    def q(spark, d):
        scale = spark.createDataFrame([(0, b, 0.5, 1.0) for b in "ANR"] + [(1, b, 2.0, -3.0) for b in "AR"], "scene int, band string, scale double, offset double")
        return annual_composites(_scenes(spark, d), 1994, 2002, method=method, scenes=scale).select("pixel", "year", "band", r4(F.col("v")).alias("v"))

    return q


def q_calendar(spark, d):
    return regularise_calendar(_scenes(spark, d).where("clear"), "quarter").select("pixel", "bin_start", "band", "v")


_SCENES = """ob AS (SELECT l_suppkey AS pixel, CAST(l_shipdate AS DATE) AS t, l_returnflag AS band, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
cl AS (SELECT pixel, CAST(year(t) AS INTEGER) AS year, t, band, CASE WHEN day(t) % 2 = 0 THEN v * 0.5 + 1.0 WHEN band = 'N' THEN v ELSE v * 2.0 - 3.0 END AS v FROM ob WHERE day(t) % 7 <> 0 AND month(t) BETWEEN 6 AND 9)"""
_YEARS = f"""SELECT p.pixel, y.year, p.band, {sql4("g.v")} AS v FROM (SELECT DISTINCT pixel, band FROM ob) p CROSS JOIN (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS year) y LEFT JOIN g ON g.pixel = p.pixel AND g.band = p.band AND g.year = y.year"""
_BINS = "o AS (SELECT *, CAST(date_diff('day', (SELECT min(t) FROM ev), t) // 16 AS INTEGER) AS k FROM ev)"
_FULL = "f AS (SELECT DISTINCT pixel, band, b.k FROM ev, (SELECT CAST(unnest(range(CAST((SELECT date_diff('day', min(t), max(t)) // 16 FROM ev) AS BIGINT) + 1)) AS INTEGER) AS k) b)"
_START = "CAST((SELECT min(t) FROM ev) + to_days(16 * f.k) AS DATE) AS bin_start"
QUERIES = {
    "composite_median": (q_median, f"WITH {EVENTS} SELECT pixel, CAST(year(t) AS INTEGER) AS year, band, {sql4('median(v)')} AS v FROM ev GROUP BY pixel, year(t), band"),
    "composite_medoid": (q_medoid, f"WITH {EVENTS}, o AS (SELECT *, CAST(weekofyear(t) AS INTEGER) AS week FROM ev), {_medoid_sql('week')} SELECT pixel, week, t, band, v FROM best"),
    "medoid_strict": (q_strict, f"WITH {EVENTS}, o AS (SELECT * FROM ev), {_medoid_sql('', 'WHERE n = 3')} SELECT pixel, t, band, v FROM best"),
    "medoid_yearly": (q_yearly, f"WITH {EVENTS}, o AS (SELECT *, year(t) AS y FROM ev WHERE band <> 'view'), {_medoid_sql('y', 'WHERE n = 3')} SELECT pixel, make_date(y, 7, 1) AS t, band, v FROM best"),
    "annual_composite_median": (_composites("median"), f"WITH {_SCENES}, g AS (SELECT pixel, year, band, median(v) AS v FROM cl GROUP BY ALL) {_YEARS}"),
    "annual_composite_medoid": (_composites("medoid"), f"WITH {_SCENES}, o AS (SELECT * FROM cl), {_medoid_sql('year')}, g AS (SELECT pixel, year, band, v FROM best) {_YEARS}"),
    "regularize_quarters": (q_calendar, f"WITH {_SCENES} SELECT pixel, CAST(date_trunc('quarter', t) AS DATE) AS bin_start, band, median(v) AS v FROM ob WHERE day(t) % 7 <> 0 GROUP BY ALL"),
    "annual_spine": (q_spine, f"WITH {SPARSE}, y AS (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year), p AS (SELECT DISTINCT pixel FROM sparse) SELECT p.pixel, year, v AS value FROM p CROSS JOIN y LEFT JOIN sparse ON sparse.pixel = p.pixel AND t = year"),
    "season_wrap": (q_season, f"WITH {MONTHLY} SELECT pixel, CAST(1995 + t // 12 - CASE WHEN t % 12 < 2 THEN 1 ELSE 0 END AS INTEGER) AS season_year, median(v) AS value FROM monthly WHERE t % 12 IN (11, 0, 1) GROUP BY ALL"),
    "regularize_16d_median": (q_bins, f"WITH {EVENTS}, {_BINS}, {_FULL}, g AS (SELECT pixel, band, k, median(v) AS v FROM o GROUP BY ALL) SELECT f.pixel, {_START}, f.band, {sql4('g.v')} AS v FROM f LEFT JOIN g USING (pixel, band, k)"),
    "regularize_16d_medoid": (q_bins_medoid, f"WITH {EVENTS}, {_BINS}, {_FULL}, {_medoid_sql('k')} SELECT f.pixel, {_START}, f.band, best.v FROM f LEFT JOIN best USING (pixel, band, k)"),
}
