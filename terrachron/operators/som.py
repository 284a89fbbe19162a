"""Self-organising maps (Kohonen 1990) by broadcast and iterate.

A pass of batch training sends the small codebook to the tasks, finds each sample's best unit and sums samples by unit
(pre-aggregated on the map side); the neighbourhood is then a product of a K by K matrix with those sums, which equals
the weighted means over all samples. Nothing but K sums comes to the driver, however many samples there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cubes import r4, sql4, table


def learning_rate(kind: str, lr: float, t: float, n: float) -> float:
    if kind == "inverse_decay_to_zero":
        return lr * (n / 100) / (n / 100 + t)
    if kind == "linear_decay_to_zero":
        return lr * (1 - t / n)
    return lr / (1 + t / (n / 2))


def spread(kind: str, sigma: float, t: float, n: float) -> float:
    if kind == "inverse_decay_to_one":
        return sigma / (1 + t * (sigma - 1) / n)
    if kind == "linear_decay_to_one":
        return sigma + t * (1 - sigma) / n
    return sigma / (1 + t / (n / 2))


class SOM:
    """x by y units of vectors of a length; flat index i * y + j."""

    def __init__(self, x: int, y: int, length: int, *, sigma: float = 1.0, lr: float = 0.5, decay: str = "asymptotic_decay", sigma_decay: str = "asymptotic_decay", neighborhood: str = "gaussian", topology: str = "rectangular", seed: int = 42):
        if neighborhood not in ("gaussian", "mexican_hat", "bubble", "triangle"):
            raise ValueError(f"unknown neighborhood {neighborhood!r}")
        if topology not in ("rectangular", "hexagonal"):
            raise ValueError(f"unknown topology {topology!r}")
        self.x, self.y, self.sigma, self.lr = x, y, sigma, lr
        self.decay, self.sigma_decay, self.kind = decay, sigma_decay, neighborhood
        self.rng = np.random.default_rng(seed)
        w = self.rng.uniform(-1, 1, (x * y, length))
        self.weights = w / np.linalg.norm(w, axis=1, keepdims=True)
        i, j = np.divmod(np.arange(x * y), y)
        self.i, self.j, self.xx, self.yy = i, j, i.astype(float), j.astype(float)
        if topology == "hexagonal":
            self.xx = self.xx - 0.5 * (j % 2 == (y % 2 == 0))
            self.yy = self.yy * np.sqrt(3) / 2

    def neighbourhood(self, sigma: float) -> np.ndarray:
        """h[k, c]: weight on unit k of a sample whose best unit is c."""
        if self.kind in ("gaussian", "mexican_hat"):
            p = (self.xx[:, None] - self.xx) ** 2 + (self.yy[:, None] - self.yy) ** 2
            g = np.exp(-p / (2 * sigma**2))
            return g if self.kind == "gaussian" else g * (1 - p / sigma**2)
        di, dj = np.abs(self.i[:, None] - self.i), np.abs(self.j[:, None] - self.j)
        if self.kind == "bubble":
            return ((di < sigma) & (dj < sigma)).astype(float)
        return np.maximum(sigma - di, 0) * np.maximum(sigma - dj, 0)

    # -- columns

    def distances(self, v: Column) -> Column:
        """Array of squared distances of a vector column to all units."""
        unit = lambda w: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(a)) for a in w]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
        return F.array(*[unit(w) for w in self.weights])

    def best(self, v: Column) -> Column:
        """Flat index of the nearest unit; the first wins ties."""
        return F.array_min(F.transform(self.distances(v), lambda d, k: F.struct(d.alias("d"), k.alias("k"))))["k"]

    def predict(self, samples: DataFrame, vector: str = "v") -> DataFrame:
        """Adds unit. Vectors with a null are an error, as a distance to them has no meaning."""
        return samples.withColumn("unit", self.best(F.col(vector)))

    def quantization_error(self, samples: DataFrame, vector: str = "v") -> DataFrame:
        return samples.select(F.sqrt(F.array_min(self.distances(F.col(vector)))).alias("d")).agg(F.avg("d").alias("error"))

    def quantize(self, samples: DataFrame, vector: str = "v") -> DataFrame:
        units = F.array(*[F.array(*[F.lit(float(a)) for a in w]) for w in self.weights])
        return self.predict(samples, vector).withColumn("code", F.get(units, F.col("unit")))

    # -- training

    def _sums(self, samples: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the samples of each unit. Partial sums are made in the tasks by unit."""
        import pyarrow as pa

        w, n = self.weights, len(self.weights)

        def part(it):
            total, count = np.zeros_like(w), np.zeros(n)
            for b in it:
                a = b.column(0)
                if not len(a):
                    continue
                x = np.asarray(a.flatten().cast(pa.float64())).reshape(len(a), -1)
                u = np.argmin(((x * x).sum(1)[:, None] - 2 * x @ w.T) + (w * w).sum(1), axis=1)
                np.add.at(total, u, x)
                count += np.bincount(u, minlength=n)
            live = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live].tolist(), pa.list_(pa.float64())), pa.array(count[live])], names=["u", "s", "n"])

        p = samples.select(vector).mapInArrow(part, "u bigint, s array<double>, n double")
        each = p.select("u", "n", F.posexplode("s").alias("d", "s")).groupBy("u", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        total, count = np.zeros_like(w), np.zeros(n)
        for r in each:
            total[r["u"], r["d"]], count[r["u"]] = r["s"], r["n"]
        return total, count

    def step(self, samples: DataFrame, t: int, passes: int, vector: str = "v") -> None:
        """One batch pass; units that no sample reaches stay as they are."""
        total, count = self._sums(samples, vector)
        h = self.neighbourhood(spread(self.sigma_decay, self.sigma, t, passes))
        num, den = h @ total, h @ count
        lr = learning_rate(self.decay, self.lr, t, passes)
        live = den != 0
        self.weights[live] = (1 - lr) * self.weights[live] + lr * num[live] / den[live][:, None]

    def train_batch(self, samples: DataFrame, passes: int, vector: str = "v") -> SOM:
        for t in range(passes):
            self.step(samples, t, passes, vector)
        return self

    def train_online(self, data: np.ndarray, iterations: int, *, shuffle: bool = False) -> SOM:
        """Sequential by definition: one sample after the other, on the driver, for samples that fit there."""
        order = np.arange(iterations) % len(data)
        if shuffle:
            self.rng.shuffle(order)
        for t, s in enumerate(order):
            c = int(np.argmin(((self.weights - data[s]) ** 2).sum(axis=1)))
            h = self.neighbourhood(spread(self.sigma_decay, self.sigma, t, iterations))[:, c]
            self.weights += (learning_rate(self.decay, self.lr, t, iterations) * h)[:, None] * (data[s] - self.weights)
        return self

    def random_init(self, data: np.ndarray) -> SOM:
        self.weights = np.array(data[self.rng.integers(0, len(data), len(self.weights))], float)
        return self

    def pca_init(self, samples: DataFrame, vector: str = "v") -> SOM:
        """Units on a grid over the first two principal directions; the covariance is aggregated by Spark."""
        n = self.weights.shape[1]
        g = samples.select(F.posexplode(vector).alias("a", "va"), F.col(vector).alias("w")).select("a", "va", F.posexplode("w").alias("b", "vb"))
        m = g.groupBy("a", "b").agg(F.avg(F.col("va") * F.col("vb")).alias("p"), F.avg("va").alias("ma"), F.avg("vb").alias("mb")).collect()
        cov = np.zeros((n, n))
        for r in m:
            cov[r["a"], r["b"]] = r["p"] - r["ma"] * r["mb"]
        _, vec = np.linalg.eigh(cov)
        u, v = np.linspace(-1, 1, self.x)[self.i], np.linspace(-1, 1, self.y)[self.j]
        self.weights = u[:, None] * vec[:, -1] + v[:, None] * vec[:, -2]
        return self


def filter_noisy(samples: DataFrame, som: SOM, vector: str = "v", label: str = "label") -> DataFrame:
    """Adds unit, majority (the unit's most frequent label, the smallest wins ties) and keep: label equals majority."""
    p = som.predict(samples, vector)
    c = p.groupBy("unit", label).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("unit").agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), label)).alias("majority"))
    return p.join(top, "unit").withColumn("keep", F.col(label) == F.col("majority"))


# ---- queries: the first nine vectors are a 3 by 3 codebook


def _som(spark, d) -> tuple[SOM, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    first = e.where("vec_id < 9").orderBy("vec_id").collect()
    som = SOM(3, 3, len(first[0]["v"]))
    som.weights = np.array([r["v"] for r in first])
    return som, e


def q_predict(spark, d):
    som, e = _som(spark, d)
    return som.predict(e).select("vec_id", F.col("unit").alias("bmu"))


def q_step(spark, d):
    som, e = _som(spark, d)
    som.step(e, 0, 10)
    rows = [(k, i, float(w)) for k, v in enumerate(som.weights) for i, w in enumerate(v)]
    return spark.createDataFrame(rows, "unit int, dim int, w double").withColumn("w", r4(F.col("w")))


def q_error(spark, d):
    som, e = _som(spark, d)
    return som.quantization_error(e).select(r4(F.col("error")).alias("error"))


def q_noisy(spark, d):
    som, e = _som(spark, d)
    return filter_noisy(e, som).select("vec_id", "majority", "keep")


_D = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), k AS (SELECT CAST(vec_id AS INTEGER) AS k, v FROM e WHERE vec_id < 9),
d AS (SELECT e.vec_id, e.label, e.v, k.k, list_sum(list_transform(list_zip(e.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, k),
b AS (SELECT vec_id, label, v, k AS bmu, d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
QUERIES = {
    "som_predict": (q_predict, _D + " SELECT vec_id, bmu FROM b"),
    "som_batch_step": (
        q_step,
        _D
        + f""", x AS (SELECT bmu, unnest(range(64)) AS dim, unnest(v) AS x FROM b), s AS (SELECT bmu, dim, sum(x) AS s FROM x GROUP BY ALL), c AS (SELECT bmu, count(*) AS n FROM b GROUP BY bmu),
h AS (SELECT a.k AS unit, s.bmu, exp(-((a.k // 3 - s.bmu // 3) ** 2 + (a.k % 3 - s.bmu % 3) ** 2) / 2.0) AS h FROM k a, c s),
m AS (SELECT unit, dim, sum(h * s) AS num FROM h JOIN s USING (bmu) GROUP BY ALL), z AS (SELECT unit, sum(h * n) AS den FROM h JOIN c USING (bmu) GROUP BY unit)
SELECT CAST(unit AS INTEGER) AS unit, CAST(dim AS INTEGER) AS dim, {sql4('0.5 * k.v[dim + 1] + 0.5 * num / den')} AS w FROM m JOIN z USING (unit) JOIN k ON k.k = unit""",
    ),
    "som_quantization_error": (q_error, _D + f" SELECT {sql4('avg(sqrt(d))')} AS error FROM b"),
    "som_filter_noisy": (q_noisy, _D + ", m AS (SELECT bmu, label, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT bmu, label AS majority FROM m QUALIFY row_number() OVER (PARTITION BY bmu ORDER BY n DESC, label) = 1) SELECT vec_id, majority, label = majority AS keep FROM b JOIN t USING (bmu)"),
}
