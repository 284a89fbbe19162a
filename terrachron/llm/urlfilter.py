"""URL filters: rules on host and path, and boosted trees on lexical features where no rule fits.

The rules' verdicts are the labels: the trees are trained on the URLs that a rule decides, and judge the others by
length, depth, share of digits, entropy of the characters, parameter counts and how often hosts of the same suffix
were blocked, where that is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, read_table, stored

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs that the trees are trained on, drawn by a hash of the row's key and URL. The suffixes' statistics are
#: over all labelled URLs.
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_marks", "suffix_rate", "suffix_seen")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end.
    A null URL or one without :// has neither."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, F.lit("://"))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(urls: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, or null) and ruled (its verdict). The rules are a short list,
    given by the caller; they become one expression."""
    host, path = host_and_path(F.col(f"`{url}`"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def suffix_of(host: str) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """The features that need no statistics, and the host's suffix (its last two labels)."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    n = F.length(u).cast("double")
    # entropy: characters sorted, so that each run of equal ones is a count
    counts = F.aggregate(
        F.array_sort(F.split(u, "")),
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(
            x == a["c"], F.struct(a["c"].alias("c"), (a["k"] + 1.0).alias("k"), a["s"].alias("s"))
        ).otherwise(F.struct(x.alias("c"), F.lit(1.0).alias("k"), (a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(F.greatest(a["k"], F.lit(1.0)))).otherwise(0.0)).alias("s"))),
        lambda a: a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(F.greatest(a["k"], F.lit(1.0)))).otherwise(0.0),
    )
    digits = F.length(F.regexp_replace(u, "[^0-9]", "")).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return (
        rows.withColumn("length", n)
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("depth", (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"))
        .withColumn("digit_ratio", F.when(n > 0, digits / F.greatest(n, F.lit(1.0))).otherwise(0.0))
        .withColumn("entropy", F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - counts / F.greatest(n, F.lit(1.0))).otherwise(0.0))
        .withColumn("n_params", F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")))
        .withColumn("n_labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("n_marks", F.length(F.regexp_replace(u, r"[^\-_%~=.]", "")).cast("double"))
        .withColumn("suffix", suffix_of("host"))
    )


def judge(urls: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, host, path, rule, verdict). Where no rule fits, the trees decide; with one class of labels, that class;
    with no labels at all, allow. Null and malformed URLs are judged by the trees like others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    base = with_rules(pick(urls, key, url), url, rules)
    named = base.where("ruled is not null")
    by = {r["ruled"]: r["n"] for r in named.groupBy("ruled").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [F.col(f"`{key}`"), F.col("host"), F.col("path"), F.col("rule")]
    if len(by) < 2:
        return base.select(*out, F.coalesce("ruled", F.lit(next(iter(by), "allow"))).alias("verdict"))
    n = sum(by.values())
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{url}`"), F.lit(5)), F.lit(1 << 20)) / (1 << 20) < min(1.0, rows / n)
    label = (F.col("ruled") == "block").cast("double")
    # block rate of each suffix over all labelled rows: as many as there are suffixes, so never broadcast
    rate = stored(named.select(suffix_of("host").alias("suffix"), label.alias("label")).groupBy("suffix").agg(F.sum("label").alias("b"), F.count(F.lit(1)).cast("double").alias("m")), "url-suffix")
    prior = by["block"] / n

    def full(df: DataFrame, own: bool) -> DataFrame:
        got = df.join(rate.hint("merge"), "suffix", "left")
        b, m = F.coalesce("b", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
        if own:
            # a row's own label isn't part of its statistics, and every second suffix is learned from as one that no label
            # is known of: else the trees would look at nothing but the suffix, and guess where it is new
            known = F.pmod(F.xxhash64("suffix", F.lit(23)), F.lit(2)) == 0
            b, m = F.when(known, b - F.col("label")).otherwise(0.0), F.when(known, m - 1).otherwise(0.0)
        return got.withColumn("suffix_rate", (b + 4 * prior) / (m + 4)).withColumn("suffix_seen", F.log1p(F.greatest(m, F.lit(0.0))))

    learn = stored(full(lexical(named.where(draw), url).withColumn("label", label), True).select(*FEATURES, "label"), "url-learn")
    size, blocked = (float(x or 0) for x in learn.agg(F.count(F.lit(1)), F.sum("label")).first())
    if not 0 < blocked < size:
        return base.select(*out, F.coalesce("ruled", F.lit("block" if blocked else "allow")).alias("verdict"))
    parts = 4
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learn).select("features", "label").coalesce(parts)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=17, stepSize=0.2).fit(train)
    told = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full(lexical(base, url), False)))
    return told.select(*out, F.coalesce("ruled", F.when(F.col("prediction") >= 0.5, "block").otherwise("allow")).alias("verdict"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
