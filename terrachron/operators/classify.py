"""Classification of segment features by random forest, and inference of small temporal networks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import run_kernel
from ..sources.cubes import r4, table, to_series


def train_forest(rows: DataFrame, features: str = "f", label: str = "label", *, trees: int = 100, depth: int = 10, seed: int = 42):
    """A random forest over an array column of features; the trees are grown on the cluster."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def classify(rows: DataFrame, model, features: str = "f", nodata: int = 0) -> DataFrame:
    """Adds prediction (int); nodata where the first two features are both 0 or missing."""
    from pyspark.ml.functions import array_to_vector

    live = F.coalesce(F.get(features, F.lit(0)), F.lit(0.0)).__ne__(0) | F.coalesce(F.get(features, F.lit(1)), F.lit(0.0)).__ne__(0)
    clean = F.transform(features, lambda v: F.coalesce(v, F.lit(0.0)))
    out = model.transform(rows.withColumn("features", array_to_vector(clean)))
    drop = [c for c in ("features", "rawPrediction", "probability") if c not in rows.columns]
    return out.drop(*drop).withColumn("prediction", F.when(live, F.col("prediction").cast("int")).otherwise(nodata))


class TempCNN:
    """Inference of a temporal convolutional network (Pelletier and others 2019): three convolutions with batch norm and
    ReLU, a dense layer, a linear layer. Weights come as arrays; `random` makes some for tests."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def random(cls, bands: int, steps: int, classes: int, *, hidden: int = 16, kernel: int = 5, dense: int = 32, seed: int = 0) -> TempCNN:
        g = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for i, c in enumerate((bands, hidden, hidden)):
            w |= {f"conv{i}": g.normal(0, 1 / math.sqrt(c * kernel), (hidden, c, kernel)), f"scale{i}": np.ones(hidden), f"shift{i}": np.zeros(hidden)}
        w |= {"dense": g.normal(0, 1 / math.sqrt(hidden * steps), (dense, hidden * steps)), "dense_b": np.zeros(dense), "out": g.normal(0, 1 / math.sqrt(dense), (classes, dense)), "out_b": np.zeros(classes)}
        return cls(w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Logits of x (pixels, bands, steps)."""
        for i in range(3):
            k = self.w[f"conv{i}"]
            pad = k.shape[2] // 2
            view = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad))), k.shape[2], axis=2)
            x = np.einsum("nctk,ock->not", view, k)
            x = np.maximum(x * self.w[f"scale{i}"][:, None] + self.w[f"shift{i}"][:, None], 0)
        h = np.maximum(x.reshape(len(x), -1) @ self.w["dense"].T + self.w["dense_b"], 0)
        return h @ self.w["out"].T + self.w["out_b"]


def _group_norm(x: np.ndarray, groups: int, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """x (pixels, steps, channels): each group of channels to mean 0 and variance 1 over its channels and all steps."""
    n, t, c = x.shape
    g = x.reshape(n, t, groups, c // groups)
    g = (g - g.mean(axis=(1, 3), keepdims=True)) / np.sqrt(g.var(axis=(1, 3), keepdims=True) + eps)
    return g.reshape(n, t, c) * scale + shift


class LightAttention:
    """Inference of a lightweight temporal attention encoder (Garnot and Landrieu 2020): a linear embedding and group
    norms, sinusoidal codes of the days that all heads share, a learned master query a head against keys of the steps, a
    weighted mean of each head's own channels, a layer with batch norm and ReLU, and a linear layer. Weights come as
    arrays; `random` makes some for tests."""

    def __init__(self, weights: dict[str, np.ndarray], tau: float = 1000.0):
        self.w, self.tau = weights, tau

    @classmethod
    def random(cls, bands: int, classes: int, *, heads: int = 16, width: int = 128, dim: int = 8, hidden: int = 128, seed: int = 0) -> LightAttention:
        g = np.random.default_rng(seed)
        normal = lambda *shape: g.normal(0, 1 / math.sqrt(shape[-1]), shape)
        one, zero = np.ones, np.zeros
        return cls({
            "embed": normal(width, bands), "embed_b": zero(width), "in_scale": one(width), "in_shift": zero(width),
            "keys": normal(heads * dim, width), "keys_b": zero(heads * dim), "query": g.normal(0, 1, (heads, dim)),
            "mlp": normal(hidden, width), "mlp_b": zero(hidden), "bn_scale": one(hidden), "bn_shift": zero(hidden), "out_scale": one(hidden), "out_shift": zero(hidden),
            "out": normal(classes, hidden), "out_b": zero(classes),
        })

    def attention(self, x: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pixels, heads, steps) weights of the steps, and the embedded steps."""
        w = self.w
        heads, dim = w["query"].shape
        e = _group_norm(x @ w["embed"].T + w["embed_b"], heads, w["in_scale"], w["in_shift"])
        own = e.shape[2] // heads
        i = np.arange(own)
        code = days[:, :, None] / self.tau ** (2 * (i // 2) / own)
        e = e + np.tile(np.where(i % 2 == 0, np.sin(code), np.cos(code)), (1, 1, heads))
        k = (e @ w["keys"].T + w["keys_b"]).reshape(*e.shape[:2], heads, dim)
        a = np.einsum("nthd,hd->nht", k, w["query"]) / math.sqrt(dim)
        a = np.exp(a - a.max(axis=2, keepdims=True))
        return a / a.sum(axis=2, keepdims=True), e

    def __call__(self, x: np.ndarray, days: np.ndarray) -> np.ndarray:
        """Logits of x (pixels, steps, bands) at days (pixels, steps)."""
        w = self.w
        a, e = self.attention(x, days)
        parts = e.reshape(*e.shape[:2], a.shape[1], -1)
        h = np.einsum("nht,nthc->nhc", a, parts).reshape(len(x), -1)
        h = np.maximum((h @ w["mlp"].T + w["mlp_b"]) * w["bn_scale"] + w["bn_shift"], 0)
        h = _group_norm(h[:, None], a.shape[1], w["out_scale"], w["out_shift"])[:, 0]
        return h @ w["out"].T + w["out_b"]


#: Pixels times steps that a network works on at once: its layers hold some arrays of so many cells a channel.
CELLS = 8192


def infer(series: DataFrame, model, bands: tuple[str, ...] = ("vs",)) -> DataFrame:
    """(pixel, class, logits) of series by a network; bands are the array columns, all as long as ts; nulls are 0. A
    batch goes through the network in parts of CELLS, so memory does not follow the batch."""

    def part(ts, vs, *more):
        v = np.stack([vs, *[np.array([[np.nan if x is None else x for x in r] for r in c], float).reshape(vs.shape) for c in more]], axis=1)
        v = np.nan_to_num(v)
        return model(v) if isinstance(model, TempCNN) else model(v.transpose(0, 2, 1), ts.astype(float))

    def kernel(ts, vs, *more):
        n = max(1, CELLS // max(1, ts.shape[1]))
        z = np.concatenate([part(*[a[i : i + n] for a in (ts, vs, *more)]) for i in range(0, len(ts), n)])
        return {"class": z.argmax(axis=1).astype(np.int32), "logits": z}

    return run_kernel(series.withColumnRenamed(bands[0], "vs"), kernel, "class int, logits array<double>", extra=bands[1:])


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"), "label")
    return e


def q_forest(spark, d):
    e = _vectors(spark, d)
    model = train_forest(e.where("vec_id % 2 = 0"), trees=20, depth=5)
    return classify(e, model).select("vec_id", "label", "prediction")


def q_mask(spark, d):
    """Where a forest that knows one class only predicts anything."""
    e = _vectors(spark, d).withColumn("f", F.transform("f", lambda v, i: F.when((i < 2) & (F.col("vec_id") % (i + 3) == 0), 0.0).otherwise(v)))
    known = e.where("vec_id % 4 < 2").withColumn("label", (F.col("vec_id") % 2).cast("int"))
    got = classify(e, train_forest(known, trees=3, depth=2), nodata=-1)
    return got.select("vec_id", (F.col("prediction") >= 0).alias("classified"))


def _series(spark, d):
    """Each vector as a series of its 64 values."""
    return _vectors(spark, d).select(F.col("vec_id").alias("pixel"), F.sequence(F.lit(0), F.size("f") - 1).alias("ts"), F.col("f").alias("vs"))


def q_tempcnn(spark, d):
    return infer(_series(spark, d), TempCNN.random(1, 64, 5)).select("pixel", "class", r4(F.array_max("logits")).alias("top"))


def q_attention(spark, d):
    two = _series(spark, d).withColumn("w", F.reverse("vs"))
    return infer(two, LightAttention.random(2, 5), ("vs", "w")).select("pixel", "class", r4(F.array_max("logits")).alias("top"))


QUERIES = {"rf_classify": (q_forest, None), "rf_mask": (q_mask, "SELECT vec_id, NOT ((vec_id % 3 = 0 OR embedding[1] = 0) AND (vec_id % 4 = 0 OR embedding[2] = 0)) AS classified FROM embeddings"), "tempcnn": (q_tempcnn, None), "light_attention": (q_attention, None)}
