"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id, ordinal), so equal texts lie together and yet any two rows differ. A sample
drawn with chances in proportion to size gives quantiles of the bytes; they cut the key space in many fine ranges, whose
exact sums are then known. Ranges that turn out overfull (a poor draw, or one text that many rows have) are subdivided by
samples of their own until none is. Shards are runs of ranges of near equal bytes.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, read_table, shared_dir, stored

#: Size-weighted draws for each fine range.
DRAWS = 8
#: Fine ranges for each shard, and rows of a fine range: there are as many ranges as the greater needs.
RANGES_PER_SHARD, ROWS_PER_RANGE = 64, 1_000_000
#: A range is overfull beyond this many times the mean.
OVERFULL = 2.0
#: A cut moves to the edge of a group of equal texts if that is within this share of a shard.
SNAP = 0.01
#: Stands for a null id, which sorts first.
NO_ID = -(1 << 62)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, h): UTF-8 bytes plus 8, unsigned CRC-32, and the place of the text in key order. A null
    text counts as empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{key}`").alias(key),
        (F.octet_length(t).cast("long") + 8).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
    )


def ordinals(rows: DataFrame, key: str) -> DataFrame:
    """Adds u: 0, or for rows that repeat an id and a text numbers that tell them apart. The rows are written ones, so
    the numbers do not change once they are written too."""
    repeated = rows.groupBy(F.col(key).alias("_k"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k", "_h")
    repeated = stored(repeated, "shard-repeats")
    if repeated.isEmpty():
        return rows.withColumn("u", F.lit(0).cast("long"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h"))
    found = rows.withColumn("_i", F.monotonically_increasing_id()).join(repeated, same, "left")
    return stored(found.select(*rows.columns, F.when(F.col("_h").isNotNull(), F.col("_i") + 1).otherwise(0).alias("u")), "shard-rows")


def _drawn(rows: DataFrame, key: str, chance: Column, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.col(key), F.col("h"), F.col("u"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(u < chance)


def _quantiles(points: list[tuple], pieces: int) -> list[tuple]:
    """Keys that part equally weighted sorted points in pieces."""
    n = len(points)
    return sorted({points[min(n - 1, round(i * n / pieces))] for i in range(1, pieces)}) if n else []


def places(cuts: np.ndarray, keys: list[np.ndarray], first: int = 0) -> np.ndarray:
    """How many cuts (rows of a sorted array) are at or below each key: a search by the first column, and among cuts that
    share it by the next, only for the keys that meet them."""
    c = cuts[:, first]
    low, high = np.searchsorted(c, keys[first], "left"), np.searchsorted(c, keys[first], "right")
    if first == cuts.shape[1] - 1:
        return high
    out = high.copy()
    some = np.flatnonzero(low != high)
    for at in np.unique(low[some]):
        own = some[low[some] == at]
        out[own] = at + places(cuts[at : high[own[0]]], [k[own] for k in keys], first + 1)
    return out


def _with_range(rows: DataFrame, key: str, cuts: list[tuple]) -> DataFrame:
    """rng: how many cuts are at or below the row's (h, key, u). The cuts are bounded by the number of ranges."""
    held = rows.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64).reshape(-1, 3))

    def find(it):
        import pandas as pd

        for cols in it:
            yield pd.Series(places(held.value, [c.to_numpy(np.int64) for c in cols]).astype(np.int32))

    f = F.pandas_udf(find, T.IntegerType(), F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn("rng", f(F.col("h"), F.coalesce(F.col(key), F.lit(NO_ID)), F.col("u")))


def splitters(rows: DataFrame, shards: int, key: str, *, rows_per_range: int = ROWS_PER_RANGE) -> tuple[list[tuple], list[dict]]:
    """Cuts (h, id, ordinal) in order, and for each range between them its rows and bytes."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not total:
        return [], []
    pieces = max(shards * RANGES_PER_SHARD, -(-n // rows_per_range))
    mean = total / pieces
    point = [F.col("h"), F.coalesce(F.col(key), F.lit(NO_ID)).alias("k"), F.col("u")]
    first = _drawn(rows, key, F.col("size") * float(DRAWS * pieces) / float(total), 1).select(*point)
    cuts = _quantiles(sorted(map(tuple, first.collect())), pieces)
    seed = 1
    while True:
        placed = _with_range(rows, key, cuts)
        have = {r["rng"]: (r["n"], r["b"]) for r in placed.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
        full = {r: b for r, (m, b) in have.items() if b > OVERFULL * mean and m > 1}
        if not full:
            return cuts, [{"n": have.get(i, (0, 0))[0], "b": have.get(i, (0, 0))[1]} for i in range(len(cuts) + 1)]
        # no two rows have one key, so every range of two rows or more can be cut; a draw that cuts none is drawn anew
        seed += 1
        chance = F.element_at(F.create_map(*[F.lit(x) for r, b in full.items() for x in (r, 4.0 * DRAWS * max(1.0, b / mean) / b)]), F.col("rng"))
        drawn = _drawn(placed.where(F.col("rng").isin(list(full))), key, F.col("size") * chance, seed).select("rng", *point).collect()
        points: dict[int, list] = {}
        for r, *p in drawn:
            points.setdefault(r, []).append(tuple(p))
        more = {c for r, p in points.items() for c in _quantiles(sorted(p), min(len(p), 2 * int(full[r] / mean) + 2))}
        if seed > 60:
            raise RuntimeError("ranges stay overfull")
        # one huge row, alone at the end of its range, is no reason to go on
        if not more - set(cuts) and seed > 8 and all(have[r][0] <= 2 for r in full):
            return cuts, [{"n": have.get(i, (0, 0))[0], "b": have.get(i, (0, 0))[1]} for i in range(len(cuts) + 1)]
        cuts = sorted(set(cuts) | more)


def assign(cuts: list[tuple], ranges: list[dict], shards: int) -> list[int]:
    """The shard of each range: runs that end nearest to each equal share; a cut between texts is preferred to one
    within a group of equal texts if it is within SNAP of a shard."""
    total = sum(r["b"] for r in ranges)
    ends, at = [], 0
    for r in ranges:
        at += r["b"]
        ends.append(at)
    inside = [i < len(cuts) and i > 0 and cuts[i][0] == cuts[i - 1][0] for i in range(len(ranges))]
    slack = SNAP * total / shards
    bounds, last = [], -1
    for s in range(1, shards):
        goal = total * s / shards
        i = min(bisect.bisect_left(ends, goal), len(ends) - 1)
        reach = min(abs(ends[j] - goal) for j in (max(i - 1, 0), i)) + slack
        low, high = bisect.bisect_left(ends, goal - reach), bisect.bisect_right(ends, goal + reach)
        near = range(max(last + 1, low), max(high, last + 2))
        last = min((j for j in near if j < len(ends)), key=lambda j: (abs(ends[j] - goal) + (slack if inside[j] else 0), j), default=len(ends) - 1)
        bounds.append(last)
    out, shard = [], 0
    for i in range(len(ranges)):
        while shard < len(bounds) and i > bounds[shard]:
            shard += 1
        out.append(shard)
    return out


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, rng, shard, slot): every row in a shard of near equal bytes, slots gapless from 0.

    A slot is the offset of the row's range in its shard plus its place within the range, so no task sorts more than
    one range. Repeated rows (equal id and text) are told apart by an ordinal that is given when the keys are written,
    so they can be parted like others and take different slots in any order. Null ids sort first; null texts are empty
    texts; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = ordinals(stored(keyed(docs, key, text), "shard-keys"), key)
    cuts, ranges = splitters(rows, shards, key)
    if not ranges:
        return rows.select(key, "size", "text_crc32", *[F.lit(0).cast(t).alias(c) for c, t in (("rng", "int"), ("shard", "int"), ("slot", "long"))])
    owner = assign(cuts, ranges, shards)
    offset, seen = [], {}
    for r, s in zip(ranges, owner):
        offset.append(seen.get(s, 0))
        seen[s] = offset[-1] + r["n"]
    placed = _with_range(rows, key, cuts)
    plan = spark.createDataFrame([(i, s, o) for i, (s, o) in enumerate(zip(owner, offset))], "rng int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("rng").orderBy("h", F.col(key).asc_nulls_first(), "u"))
    placed = placed.withColumn("place", place).join(plan, "rng")  # a row a range: Spark broadcasts it if it is small
    return placed.select(key, "size", "text_crc32", "rng", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str | None = None, key: str = "doc_id") -> str:
    """Write the documents (unique ids) in folders `_shard=n`, in slot order within each range; returns the path."""
    path = path or shared_dir(docs.sparkSession, "shards")
    where = placed.select(F.col(key).alias("_k"), F.col("rng").alias("_rng"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = docs.join(where, F.col(f"`{key}`").eqNullSafe(F.col("_k"))).drop("_k")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = out.repartitionByRange(parts, "_rng").sortWithinPartitions("_rng", "_slot").drop("_rng", "_slot")
    ordered.write.partitionBy("_shard").parquet(path)
    return path


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_rows(pick(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
