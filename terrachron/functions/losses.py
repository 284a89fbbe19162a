"""Losses of change-detection networks as aggregates over tables of logits, features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cubes import r4, sql4, table


def focal(rows: DataFrame, alpha: float = 0.25, gamma: float = 2.0, reduction: str = "mean") -> DataFrame:
    """rows: z array of logits, y class index. alpha (1 - p)^gamma cross-entropy."""
    top = F.array_max("z")
    lse = top + F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    ce = lse - F.get("z", F.col("y"))
    loss = alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    return rows.select(loss.alias("l")).agg((F.avg("l") if reduction == "mean" else F.sum("l")).alias("loss"))


def tversky(rows: DataFrame, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> DataFrame:
    """rows: z (two logits), y 0 or 1. alpha weighs false positives, beta false negatives."""
    p = 1 / (1 + F.exp(F.get("z", F.lit(0)) - F.get("z", F.lit(1))))
    y = F.col("y").cast("double")
    tp, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
    return rows.agg((1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)).alias("loss"))


def contrastive(rows: DataFrame, margin: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """rows: a and b feature arrays, y 1 for changed. Distance squared if unchanged, else what lacks to the margin squared."""
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y + eps) * (x - y + eps)), F.lit(0.0), lambda s, x: s + x))
    y = F.col("y").cast("double")
    short = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return rows.agg(F.avg((1 - y) * d * d + y * short * short).alias("loss"))


def _rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.select(F.slice("v", 1, 2).alias("z"), (F.col("label") % 2).alias("y"), F.slice("v", 1, 8).alias("a"), F.slice("v", 9, 8).alias("b"))


def _q(f):
    return lambda spark, d: f(_rows(spark, d)).select(r4(F.col("loss")).alias("loss"))


_R = "WITH r AS (SELECT CAST(embedding AS DOUBLE[]) AS v, label % 2 AS y FROM embeddings)"
QUERIES = {
    "focal_loss": (_q(focal), _R + f", c AS (SELECT ln(exp(v[1]) + exp(v[2])) - v[y + 1] AS ce FROM r) SELECT {sql4('avg(0.25 * (1 - exp(-ce)) * (1 - exp(-ce)) * ce)')} AS loss FROM c"),
    "tversky_loss": (_q(tversky), _R + f", p AS (SELECT exp(v[2]) / (exp(v[1]) + exp(v[2])) AS p, CAST(y AS DOUBLE) AS y FROM r), s AS (SELECT sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn FROM p) SELECT {sql4('1 - (tp + 1) / (tp + 0.3 * fp + 0.7 * fn + 1)')} AS loss FROM s"),
    "contrastive_loss": (
        _q(contrastive),
        _R + f", d AS (SELECT CAST(y AS DOUBLE) AS y, sqrt(list_sum(list_transform(range(1, 9), lambda i: (v[i] - v[i + 8] + 1e-6) * (v[i] - v[i + 8] + 1e-6)))) AS d FROM r) SELECT {sql4('avg((1 - y) * d * d + y * greatest(2 - d, 0) * greatest(2 - d, 0))')} AS loss FROM d",
    ),
}
