"""Helpers that the corpus operators share: scratch tables, input columns, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names; a local one only where that is unset. All paths
    of an application are in one folder, which may be deleted when it has ended."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="terrachron-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/terrachron-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What the session had before arrow_rows, by application.
_BATCHES: dict[str, dict[str, str | None]] = {}
_SIZES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def arrow_rows(df: DataFrame, records: int = 1000, size: int = 8 << 20) -> DataFrame:
    """Bound the Arrow batches of the session's Python operators: whole texts are wide rows, and a worker holds a batch
    at a time. Spark reads these settings when a plan runs, so they stay until `restore`. Returns df."""
    spark = df.sparkSession
    if int(spark.conf.get(_SIZES[0])) > records:
        _BATCHES.setdefault(spark.sparkContext.applicationId, {k: spark.conf.get(k, None) for k in _SIZES})
        spark.conf.set(_SIZES[0], str(records))
        spark.conf.set(_SIZES[1], str(size))
    return df


def restore(spark: SparkSession) -> None:
    """Give the session the batch sizes that it had before any corpus operator."""
    for k, v in _BATCHES.pop(spark.sparkContext.applicationId, {}).items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), "UTF-8")) % n


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a, b (long). Returns (node, root), root being the least node reachable; nodes without an
    edge do not appear. Each round is two aggregations and joins and a written table, so a hub is pre-aggregated
    and its join can be split; nothing is gathered on the driver but a checksum.
    """
    e = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        now = tuple(
            e.agg(
                F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
            ).first()
        )
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("v"))
    return (
        roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
        .groupBy("node")
        .agg(F.min("root").alias("root"))
    )
