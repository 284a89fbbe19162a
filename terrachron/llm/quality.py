"""Quality rules: base statistics of whole texts, and robust multivariate outliers by language and source.

DataFrame functions only. Centre and scatter are minimum-covariance-determinant estimates for each language and source:
from two starts (medians with median deviations; means with the classical scatter) concentration steps keep the nearest
share of the rows and estimate anew, which never raises the determinant, until no group's moves; the start that ends
with the lesser determinant is taken. The estimates of each language and of all rows are made likewise, and a group's
estimate is drawn toward its language's, and that toward all rows', as if SHRINK of the wider group's rows had been added
to its own: the weight changes smoothly with the group's size, and a group of one row is judged by its language.

Order statistics come from histograms of distances, counted before they are shuffled, so a source with a third of all
rows costs no more in one task than any other. Rows whose Mahalanobis distance passes a chi-square quantile are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, stored
from .pii import let

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the wider group that count beside a group's own.
SHRINK = 50.0
#: Share of the rows that the concentration steps keep, and the chi-square quantile of the cut.
KEEP, QUANTILE = 0.75, 0.99999
#: The steps end when no group's logarithm of the determinant changes by more than this; distances are binned, so it may
#: move to and fro a little, and after STEPS it is left where it is.
STILL, STEPS = 0.01, 20
#: Transformed statistics, and the least standard deviation that each is given, so that a statistic that is nearly
#: always zero doesn't reject whatever is not.
DIMS = ("x0", "x1", "x2", "x3")
FLOOR = (0.08, 0.35, 0.35, 0.45)


def base_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); null texts are empty.

    Repeated three-word windows are found within the row: window hashes are sorted with their places, equal
    neighbours give the repeated places, and the words that these windows cover are counted as a union of intervals.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`").alias(c) for c in (key, *keep)]
    names = [key, *keep]
    q = [F.col(f"`{c}`") for c in names]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*own, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"), lines.alias("_l"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    b = a.select(
        *q,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    three = F.when(
        F.size("_h") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))),
    )
    base = [*q, F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines")]
    c = b.select(*base, three.alias("_g"))
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    d = c.select(*base, F.when(repeats, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    places = F.array_sort(
        F.transform(
            F.filter(F.col("_s"), lambda x, j: F.coalesce((x["h"] == F.get("_s", j - 1)["h"]), F.lit(False)) | F.coalesce((x["h"] == F.get("_s", j + 1)["h"]), F.lit(False))),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(3), i - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    e = d.select(*base, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return e.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _chi2_cdf(x: float, k: int) -> float:
    """k even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return low


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c, k: F.log1p(k * F.col(c) / n)
    return {"x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x1": rate("n_symbols", 20.0), "x2": rate("n_dup_lines", 20.0), "x3": rate("n_repeat_words", 10.0)}


def _named(rows: DataFrame) -> DataFrame:
    """Adds the groups that a row belongs to: g2 (its language and source), g1 (its language); all rows are group 0."""
    one = lambda *c: F.xxhash64(F.lit(len(c)), *[x for n in c for x in (F.isnull(n), F.coalesce(F.col(n).cast("string"), F.lit("")))])
    return rows.withColumn("g2", one("lang", "source")).withColumn("g1", one("lang"))


def _up_to(bins: Column, share: float) -> Column:
    """Of sorted (bin, n, ..), the least bin up to which share of the rows lie. A row's statistics are logarithms, so a
    group has some thousands of bins at most and its histogram fits in a row."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    def step(s: Column, x: Column, total: Column) -> Column:
        c = s["c"] + x["n"]
        return F.struct(c.alias("c"), F.when(s["bin"].isNull() & (c >= share * total), x["bin"]).otherwise(s["bin"]).alias("bin"))

    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("bin"))
    return let(total, lambda t: F.aggregate(bins, start, lambda s, x: step(s, x, t), lambda s: s["bin"]))


def _order_statistic(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """counts: (*by, bin, n). The least bin up to which share of the group's rows lie."""
    held = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("a"))
    return held.select(*by, let(F.col("a"), lambda a: _up_to(a, share)).alias("bin"))


def _long(rows: DataFrame, value, fine: float) -> DataFrame:
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.floor(value(j) * fine).cast("int").alias("bin")) for j in range(len(DIMS))])
    return rows.select("g", F.explode(each).alias("e")).groupBy("g", "e.j", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def _wide(frame: DataFrame, name: str, fine: float) -> DataFrame:
    return frame.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, (F.col("bin") + 0.5) / fine)).alias(f"{name}{j}") for j in range(len(DIMS))])


def _cholesky(params: DataFrame) -> DataFrame:
    """From means m and covariances c (with the floors added) to the lower factor l, column by column."""
    d = len(DIMS)
    for j in range(d):
        s = F.col(f"c{j}{j}")
        for k in range(j):
            s = s - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{j}{j}", F.sqrt(F.greatest(s, F.lit(FLOOR[j] ** 2 / 4))))
        for i in range(j + 1, d):
            s = F.col(f"c{j}{i}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", s / F.col(f"l{j}{j}"))
    return params


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m, by forward substitution in l."""
    z: list[Column] = []
    for i, x in enumerate(DIMS):
        s = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * z[k]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _bin(d: Column) -> Column:
    return F.floor(F.log1p(d) * 64).cast("int")


_M = [f"m{j}" for j in range(len(DIMS))]
_C = [f"c{j}{i}" for i in range(len(DIMS)) for j in range(i + 1)]
_L = [f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)]


def _sums() -> list[Column]:
    d = range(len(DIMS))
    first = [F.sum(DIMS[j]).alias(f"s{j}") for j in d]
    return [F.count(F.lit(1)).alias("n"), *first, *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i in d for j in range(i, len(DIMS))]]


_SUMS = [*[f"s{j}" for j in range(len(DIMS))], *[f"p{i}{j}" for i in range(len(DIMS)) for j in range(i, len(DIMS))]]


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """Adds m and c to sums: means, and scatter times the factor with the floors added."""
    for j in range(len(DIMS)):
        sums = sums.withColumn(f"m{j}", F.col(f"s{j}") / F.col("n"))
    for i in range(len(DIMS)):
        for j in range(i, len(DIMS)):
            cov = factor * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            sums = sums.withColumn(f"c{i}{j}", F.greatest(cov, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else cov)
    return sums


def _nearest(rows: DataFrame, params: DataFrame) -> DataFrame:
    """(g, start, n, sums) of the KEEP share of each group's rows that lie nearest to its estimate: sums by bin of the
    distance, counted before they are shuffled; then the bins of a group in a row."""
    far = rows.join(params, "g").select("g", "start", *DIMS, _bin(_distance()).alias("bin"))
    held = far.groupBy("g", "start", "bin").agg(*_sums()).groupBy("g", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "n", *_SUMS))).alias("a"))
    near = held.select("g", "start", let(F.col("a"), lambda a: let(_up_to(a, KEEP), lambda most: F.filter(a, lambda x: x["bin"] <= most))).alias("a"))
    total = lambda c, zero: F.aggregate("a", zero, lambda s, x: s + x[c]).alias(c)
    return near.select("g", "start", total("n", F.lit(0).cast("long")), *[total(c, F.lit(0.0)) for c in _SUMS])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """rows: g and x0..; one row for each group: centre m and scatter c."""
    d = range(len(DIMS))
    fine = 100.0
    med = stored(_wide(_order_statistic(_long(rows, lambda j: F.col(DIMS[j]), fine), ["g", "j"], 0.5), "m", fine), "quality-med")
    mad = _wide(_order_statistic(_long(rows.join(med, "g"), lambda j: F.abs(F.col(DIMS[j]) - F.col(f"m{j}")), fine), ["g", "j"], 0.5), "s", fine)
    start = med.join(mad, "g").withColumn("start", F.lit(0))
    for i in d:
        for j in range(i + 1):
            start = start.withColumn(f"c{j}{i}", F.pow(F.greatest(F.lit(FLOOR[i]), 1.4826 * F.col(f"s{i}")), 2) if i == j else F.lit(0.0))
    names = ["g", "start", *_M, *_C]
    both = start.select(*names).unionByName(_moments(rows.groupBy("g").agg(*_sums()), 1.0).withColumn("start", F.lit(1)).select(*names))
    params = stored(_cholesky(both).select(*names, *_L), "quality-start")
    cut = chi2_quantile(KEEP, len(DIMS))
    factor = KEEP / _chi2_cdf(cut, len(DIMS) + 2)
    size = sum((F.log(F.col(f"l{j}{j}")) for j in d[1:]), F.log(F.col("l00"))) * 2
    for step in range(STEPS):
        new = stored(_cholesky(_moments(_nearest(rows, params), factor)).select(*names, *_L), "quality-params")
        moved = new.withColumn("now", size).join(params.select("g", "start", size.alias("then")), ["g", "start"])
        params = new
        # the first step also scales the scatter, so only later ones are compared
        if step and (moved.agg(F.max(F.abs(F.col("now") - F.col("then")))).first()[0] or 0.0) <= STILL:
            break
    least = params.groupBy("g").agg(F.min_by(F.struct(*_M, *_C), F.struct(size, F.col("start"))).alias("p"))
    return stored(least.select("g", "p.*"), "quality-best")


def _drawn_toward(own: DataFrame, wide: DataFrame) -> DataFrame:
    """own: (.., g, up, n, m, c); wide: (up, m, c) of the wider groups. The means and scatters of own with SHRINK rows of
    the wider group."""
    w = wide.select("up", *[F.col(c).alias(f"w{c}") for c in (*_M, *_C)])
    mixed = [((F.col(c) * F.col("n") + F.col(f"w{c}") * SHRINK) / (F.col("n") + SHRINK)).alias(c) for c in (*_M, *_C)]
    keep = [c for c in own.columns if c not in (*_M, *_C, "up")]
    return own.join(w, "up").select(*keep, *mixed)


def group_estimates(rows: DataFrame) -> DataFrame:
    """rows: g2, g1 and x0..; for each g2 its centre m and lower factor l, drawn toward its language's and all rows'."""
    level = F.explode(F.array("g2", "g1", F.lit(0).cast("long"))).alias("g")
    est = robust_estimates(stored(rows.select(level, *DIMS), "quality-rows"))
    sizes = stored(rows.groupBy("g2", "g1").agg(F.count(F.lit(1)).alias("n")), "quality-sizes")
    whole = est.where("g = 0").withColumnRenamed("g", "up")
    langs = sizes.groupBy("g1").agg(F.sum("n").alias("n")).withColumnRenamed("g1", "g").join(est, "g").withColumn("up", F.lit(0).cast("long"))
    langs = _drawn_toward(langs, whole).withColumnRenamed("g", "up")
    own = sizes.select(F.col("g2").alias("g"), F.col("g1").alias("up"), "n").join(est, "g")
    return stored(_cholesky(_drawn_toward(own, langs)).select(F.col("g").alias("g2"), *_M, *_L), "quality-groups")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics, base_failed, distance, kept). Rows that fail the base rules teach nothing and are never kept;
    null languages and sources are groups of their own; repeated rows count as often as they stand; an empty table
    gives an empty result."""
    stats = stored(base_statistics(docs, key, text, ("lang", "source")), "quality-stats")
    grouped = _named(stats.select("*", *[c.alias(n) for n, c in _vector().items()]))
    params = group_estimates(grouped.where("not base_failed"))
    limit = chi2_quantile(QUANTILE, len(DIMS))
    out = grouped.join(params, "g2", "left").withColumn("distance", F.sqrt(_distance()))
    near = F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
