"""Cubes as tables.

obs     : pixel bigint, t (int step or date), [band string,] v double - one row for each observation, null = missing
series  : pixel bigint, ts array<int>, vs array<double> - one row a pixel, aligned and in time order
raster  : y int, x int, v double

The constructors below read the shared tables as cubes; `to_series` is the one shuffle that a per-pixel operator needs
(none, if the series table is stored bucketed by pixel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First month of the monthly cube and first year of the yearly ones.
YEAR0 = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(v: Column, nodata: float | None = None) -> Column:
    """NaN and nodata become null, the one missing value of all operators."""
    bad = F.isnan(v) if nodata is None else F.isnan(v) | (v == F.lit(nodata))
    return F.when(~bad, v)


def annual(spark: SparkSession, sf_dir: str, pixel: str = "l_suppkey") -> DataFrame:
    """obs (pixel, t year, v): yearly sums of quantities."""
    d = table(spark, sf_dir, "lineitem").select(F.col(pixel).alias("pixel"), F.year("l_shipdate").alias("t"), "l_quantity")
    return d.groupBy("pixel", "t").agg(F.sum("l_quantity").alias("v"))


def monthly(spark: SparkSession, sf_dir: str, pixel: str = "l_suppkey") -> DataFrame:
    """obs (pixel, t months since January of YEAR0, v)."""
    m = (F.year("l_shipdate") - YEAR0) * 12 + F.month("l_shipdate") - 1
    d = table(spark, sf_dir, "lineitem").select(F.col(pixel).alias("pixel"), m.alias("t"), "l_quantity")
    return d.groupBy("pixel", "t").agg(F.sum("l_quantity").alias("v"))


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs (pixel, t date, band, v): the largest value of a user, day and kind of event."""
    d = table(spark, sf_dir, "events").where("value is not null")
    d = d.select(F.col("user_id").alias("pixel"), F.to_date("ts").alias("t"), F.col("event_type").alias("band"), "value")
    return d.groupBy("pixel", "t", "band").agg(F.max("value").alias("v"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster of 50 columns: part sizes."""
    d = table(spark, sf_dir, "part")
    return d.select((F.floor(F.col("p_partkey") / 50)).cast("int").alias("y"), (F.col("p_partkey") % 50).cast("int").alias("x"), F.col("p_size").cast("double").alias("v"))


def spine(obs: DataFrame, first: int, last: int) -> DataFrame:
    """Every pixel at every step from first to last; steps without an observation are null. The steps are made in the
    pixel's row, so the only shuffle is the one that gathers the pixel."""
    s = obs.groupBy("pixel").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    return s.select("pixel", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t"), "m").select("pixel", "t", F.try_element_at("m", F.col("t")).alias("v"))


def once(value: Column, f) -> Column:
    """f(value), with the value worked out once: a name that f uses many times, or in a lambda, would otherwise be put in
    place of each use by the optimiser."""
    return F.get(F.transform(F.array(value), f), 0)


def to_series(obs: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """series of the pixels; with first and last, on the regular grid between them, gaps null. The grid is filled in one
    pass over the sorted observations: each brings the nulls before it. Of observations of one step, the least is taken."""
    # a fixed number of partitions: by bytes, the many pixels of a costly kernel would be gathered into a few tasks
    obs = obs.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pixel")
    s = F.array_sort(F.collect_list(F.struct("t", "v")))
    if first is None:
        s = obs.groupBy("pixel").agg(s.alias("s"))
        return s.select("pixel", F.transform("s", lambda x: x["t"]).alias("ts"), F.transform("s", lambda x: x["v"]).alias("vs"))
    kind = obs.schema["v"].dataType
    gaps = lambda n: F.array_repeat(F.lit(None).cast(kind), F.greatest(n, F.lit(0)).cast("int"))

    def filled(a: Column) -> Column:
        def part(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(a, k - 1)["t"], F.lit(first - 1))
            return F.when(x["t"] > before, F.concat(gaps(x["t"] - before - 1), F.array(x["v"]))).otherwise(gaps(F.lit(0)))

        return F.concat(F.flatten(F.transform(a, part)), gaps(F.lit(last) - F.coalesce(F.get(a, F.size(a) - 1)["t"], F.lit(first - 1))))

    inside = F.when(F.col("t").between(first, last), F.struct("t", "v"))
    s = obs.groupBy("pixel").agg(F.array_sort(F.collect_list(inside)).alias("s"))
    return s.select("pixel", F.sequence(F.lit(first), F.lit(last)).alias("ts"), once(F.col("s"), filled).alias("vs"))


def r4(c: Column) -> Column:
    """Rounded to four places in a way that every engine shares."""
    return F.floor(c * 10000.0 + 0.5) / 10000.0


#: The same cubes in SQL, for the oracles.
ANNUAL = "annual AS (SELECT l_suppkey AS pixel, CAST(year(l_shipdate) AS INTEGER) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
SPARSE = "sparse AS (SELECT l_partkey AS pixel, CAST(year(l_shipdate) AS INTEGER) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
MONTHLY = f"monthly AS (SELECT l_suppkey AS pixel, CAST((year(l_shipdate) - {YEAR0}) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
EVENTS = "ev AS (SELECT user_id AS pixel, CAST(ts AS DATE) AS t, event_type AS band, max(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)"
RASTER = "ras AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS y, CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_size AS DOUBLE) AS v FROM part)"


def sql4(e: str) -> str:
    return f"floor(({e}) * 10000.0 + 0.5) / 10000.0"
