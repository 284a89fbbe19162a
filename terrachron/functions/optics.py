"""Quality words, cloud masks, spectral indices, harmonisation and rescaling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cubes import EVENTS, irregular, r4, sql4, table


def bits(x: Column, first: int, last: int) -> Column:
    """The bits first..last (inclusive) of an integer."""
    return F.shiftright(x, first).bitwiseAND((1 << (last - first + 1)) - 1)


def modis_summary(q: Column, best: float = 1.0, mid: float = 0.5, low: float = 0.2) -> Column:
    """Weight of a MODIS summary-QA value: 0 best, 1 mid, 2 and 3 low; others 0."""
    return F.when(q == 0, best).when(q == 1, mid).when(q.isin(2, 3), low).otherwise(0.0)


def modis_state(q: Column, best: float = 1.0, mid: float = 0.5, low: float = 0.2) -> Column:
    """Weight of a MODIS state-QA word: cloud bits 0-1, aerosol 6-7, snow 12. Bad overrides good; the rest is mid."""
    cloud, aerosol, snow = bits(q, 0, 1), bits(q, 6, 7), bits(q, 12, 12)
    return F.when((cloud == 1) | (aerosol == 3) | (snow == 1), low).when((cloud == 0) & (aerosol <= 1) & (snow == 0), best).otherwise(mid)


def sentinel_scl(q: Column, best: float = 1.0, mid: float = 0.5, low: float = 0.2) -> Column:
    """Weight of a scene-class value: 4, 5, 6, 7, 10 best, 8 mid, others low."""
    return F.when(q.isin(4, 5, 6, 7, 10), best).when(q == 8, mid).otherwise(low)


def clear_landsat(q: Column) -> Column:
    return F.coalesce(q, F.lit(0)).bitwiseAND(64) != 0


def clear_scl(q: Column) -> Column:
    return F.coalesce(q, F.lit(0)).isin(4, 5, 6, 7, 11)


def clear_shadow_bits(q: Column) -> Column:
    """Neither bit 3 nor bit 4."""
    return F.coalesce(q, F.lit(0)).bitwiseAND(24) == 0


def qa_band(collection: str) -> str:
    """The QA band of a collection, by its name."""
    c = collection.lower()
    if "sentinel" in c or "s2" in c:
        return "scl"
    if "landsat" in c or "l8" in c:
        return "qa_pixel"
    raise ValueError(f"no QA band known for {collection!r}")


def apply_mask(obs: DataFrame, band: str, clear) -> DataFrame:
    """obs without the QA band; values of a pixel and time whose QA is not clear are null. The QA value is gathered with
    the pixel's other bands, so the mask is one aggregation and no self-join."""
    g = obs.groupBy("pixel", "t").agg(
        F.max(F.when(F.col("band") == band, F.col("v"))).cast("int").alias("qa"),
        F.collect_list(F.when(F.col("band") != band, F.struct("band", "v"))).alias("o"),
    )
    e = g.select("pixel", "t", clear(F.col("qa")).alias("clear"), F.explode("o").alias("o"))
    return e.select("pixel", "t", F.col("o.band").alias("band"), F.when(F.col("clear"), F.col("o.v")).alias("v"))


def _nd(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def indices(blue: Column, green: Column, red: Column, nir: Column, swir2: Column) -> dict[str, Column]:
    """Spectral indices; a zero denominator gives null."""
    ndvi = _nd(nir, red)
    return {
        "ndvi": ndvi,
        "nbr": _nd(nir, swir2),
        "ndwi": _nd(green, nir),
        "kndvi": F.tanh(ndvi * ndvi),
        "evi": F.try_divide(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0),
    }


#: Slope and intercept of each band, OLI to ETM+ (Roy and others 2016, reduced major axis).
ROY_2016 = {
    "blue": (0.8474, 0.0003),
    "green": (0.8483, 0.0088),
    "red": (0.9047, 0.0061),
    "nir": (0.8462, 0.0412),
    "swir1": (0.8937, 0.0254),
    "swir2": (0.9071, 0.0172),
}
#: ETM+ band names by OLI names.
ETM_TO_OLI = {"B1": "B2", "B2": "B3", "B3": "B4", "B4": "B5", "B5": "B6", "B7": "B7"}


def harmonise(obs: DataFrame, coefficients: dict[str, tuple[float, float]]) -> DataFrame:
    """v * slope + intercept of the row's band; bands without coefficients stay. A handful of bands is an expression."""
    slope, shift = F.lit(1.0), F.lit(0.0)
    for band, (a, b) in coefficients.items():
        slope, shift = F.when(F.col("band") == band, a).otherwise(slope), F.when(F.col("band") == band, b).otherwise(shift)
    return obs.withColumn("v", F.col("v") * slope + shift)


def rename_bands(obs: DataFrame, names: dict[str, str] = ETM_TO_OLI) -> DataFrame:
    out = F.col("band")
    for a, b in names.items():
        out = F.when(F.col("band") == a, b).otherwise(out)
    return obs.withColumn("band", out)


def rescale(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """obs with a scene id, scenes (scene, band, scale, offset): v * scale + offset; joined by scene, never by time, as
    two scenes may share a time. Spark broadcasts scenes if they are small."""
    s = scenes.select("scene", "band", "scale", "offset")
    out = obs.join(s, ["scene", "band"], "left")
    return out.withColumn("v", F.col("v") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))).drop("scale", "offset")


# ---- queries


def _words(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 65536).cast("int").alias("q"))


_WORDS = "w AS (SELECT event_id, CAST(event_id * 37 % 65536 AS INTEGER) AS q FROM events)"


def _weight(f, mod: int):
    def q(spark, d):
        return _words(spark, d).select("event_id", f(F.col("q") % mod).alias("weight"))

    return q


def _flag(f, mod: int = 65536):
    def q(spark, d):
        return _words(spark, d).select("event_id", f(F.col("q") % mod).alias("clear"))

    return q


def q_mask(spark, d):
    out = apply_mask(irregular(spark, d), "error", lambda q: clear_landsat(q * 8))
    return out.select("pixel", "t", "band", "v")


def _wide(spark, d):
    o = irregular(spark, d)
    b = {"blue": "click", "green": "error", "red": "purchase", "nir": "signup", "swir2": "view"}
    return o.groupBy("pixel", "t").agg(*[F.max(F.when(F.col("band") == k, F.col("v"))).alias(n) for n, k in b.items()])


def q_indices(spark, d):
    w = _wide(spark, d)
    ix = indices(*[F.col(c) for c in ("blue", "green", "red", "nir", "swir2")])
    return w.select("pixel", "t", *[r4(c).alias(n) for n, c in ix.items()])


def q_harmonise(spark, d):
    bands = dict(zip(("click", "error", "purchase", "signup", "view"), list(ROY_2016.values())[:5]))
    return harmonise(irregular(spark, d), bands).select("pixel", "t", "band", r4(F.col("v")).alias("v"))


def q_rescale(spark, d):
    o = irregular(spark, d).withColumn("scene", F.dayofmonth("t") % 3)
    scenes = spark.createDataFrame([(s, b, 0.5 + s, float(s)) for s in range(2) for b in ("click", "view")], "scene int, band string, scale double, offset double")
    return rescale(o, scenes).select("pixel", "t", "band", r4(F.col("v")).alias("v"))


def q_bits(spark, d):
    return _words(spark, d).select("event_id", bits(F.col("q"), 6, 9).alias("value"))


def q_rename(spark, d):
    o = table(spark, d, "events").select("event_id", F.concat(F.lit("B"), (F.col("event_id") % 9).cast("string")).alias("band"))
    return rename_bands(o).select("event_id", "band")


def q_qa(spark, d):
    """Each scene's mask by the QA band of its collection."""
    name = {"scl": "Sentinel-2 L2A", "qa_pixel": "landsat-c2-l2"}
    rules = {"scl": lambda q: clear_scl(q % 12), "qa_pixel": clear_landsat}
    clear = F.when(F.col("event_id") % 2 == 0, rules[qa_band(name["scl"])](F.col("q"))).otherwise(rules[qa_band(name["qa_pixel"])](F.col("q")))
    return _words(spark, d).select("event_id", clear.alias("clear"))


_COEF = "CASE band " + " ".join(f"WHEN '{b}' THEN v * {a[0]} + {a[1]}" for b, a in zip(("click", "error", "purchase", "signup", "view"), ROY_2016.values())) + " END"
QUERIES = {
    "qc_modis_summary": (_weight(modis_summary, 5), f"WITH {_WORDS} SELECT event_id, CAST(CASE WHEN q % 5 = 0 THEN 1.0 WHEN q % 5 = 1 THEN 0.5 WHEN q % 5 IN (2, 3) THEN 0.2 ELSE 0.0 END AS DOUBLE) AS weight FROM w"),
    "qc_modis_state": (
        _weight(modis_state, 65536),
        f"WITH {_WORDS}, b AS (SELECT event_id, q & 3 AS c, (q >> 6) & 3 AS a, (q >> 12) & 1 AS s FROM w) SELECT event_id, CAST(CASE WHEN c = 1 OR a = 3 OR s = 1 THEN 0.2 WHEN c = 0 AND a <= 1 AND s = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight FROM b",
    ),
    "qc_s2_scl": (_weight(sentinel_scl, 12), f"WITH {_WORDS} SELECT event_id, CAST(CASE WHEN q % 12 IN (4, 5, 6, 7, 10) THEN 1.0 WHEN q % 12 = 8 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS weight FROM w"),
    "qc_bits": (q_bits, f"WITH {_WORDS} SELECT event_id, (q >> 6) & 15 AS value FROM w"),
    "qa_by_collection": (q_qa, f"WITH {_WORDS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN q % 12 IN (4, 5, 6, 7, 11) ELSE (q & 64) <> 0 END AS clear FROM w"),
    "band_names": (q_rename, "SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'B2' WHEN 2 THEN 'B3' WHEN 3 THEN 'B4' WHEN 4 THEN 'B5' WHEN 5 THEN 'B6' ELSE 'B' || (event_id % 9) END AS band FROM events"),
    "mask_clear_landsat": (_flag(clear_landsat), f"WITH {_WORDS} SELECT event_id, (q & 64) <> 0 AS clear FROM w"),
    "mask_clear_scl": (_flag(clear_scl, 12), f"WITH {_WORDS} SELECT event_id, q % 12 IN (4, 5, 6, 7, 11) AS clear FROM w"),
    "mask_shadow_bits": (_flag(clear_shadow_bits), f"WITH {_WORDS} SELECT event_id, (q & 8) = 0 AND (q & 16) = 0 AS clear FROM w"),
    "mask_apply": (
        q_mask,
        f"WITH {EVENTS}, q AS (SELECT pixel, t, CAST(floor(v) AS INTEGER) * 8 AS q FROM ev WHERE band = 'error') SELECT ev.pixel, ev.t, band, CASE WHEN (coalesce(q.q, 0) & 64) <> 0 THEN v END AS v FROM ev LEFT JOIN q USING (pixel, t) WHERE band <> 'error'",
    ),
    "indices": (
        q_indices,
        f"""WITH {EVENTS}, w AS (SELECT pixel, t, max(v) FILTER (band = 'click') AS b, max(v) FILTER (band = 'error') AS g, max(v) FILTER (band = 'purchase') AS r, max(v) FILTER (band = 'signup') AS n, max(v) FILTER (band = 'view') AS s FROM ev GROUP BY ALL)
SELECT pixel, t, {sql4("(n - r) / nullif(n + r, 0)")} AS ndvi, {sql4("(n - s) / nullif(n + s, 0)")} AS nbr, {sql4("(g - n) / nullif(g + n, 0)")} AS ndwi,
 {sql4("tanh(((n - r) / nullif(n + r, 0)) * ((n - r) / nullif(n + r, 0)))")} AS kndvi, {sql4("2.5 * (n - r) / nullif(n + 6.0 * r - 7.5 * b + 1.0, 0)")} AS evi FROM w""",
    ),
    "harmonize": (q_harmonise, f"WITH {EVENTS} SELECT pixel, t, band, {sql4(_COEF)} AS v FROM ev"),
    "rescale_scene": (
        q_rescale,
        f"WITH {EVENTS}, s AS (SELECT * FROM (VALUES (0, 'click', 0.5, 0.0), (0, 'view', 0.5, 0.0), (1, 'click', 1.5, 1.0), (1, 'view', 1.5, 1.0)) x(scene, b, scale, off)) SELECT pixel, t, band, {sql4('v * coalesce(scale, 1.0) + coalesce(off, 0.0)')} AS v FROM ev LEFT JOIN s ON s.scene = day(t) % 3 AND s.b = band",
    ),
}
