"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (a local one only where none is set)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="terrachron-"))
    return df.checkpoint()


def connected(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) of edges (a, b): labels spread to neighbours and jump to their label's label until none changes; if
    they still do after max_rounds, an error is raised.

    Jumping halves the distance to the least node, so a long snake takes logarithmically many rounds.
    """
    both = _cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = _cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "m").alias("new"))
        # the root learns what its members saw, then everyone takes its root's label
        told = low.groupBy("root").agg(F.min("new").alias("new")).select(F.col("root").alias("node"), F.col("new").alias("told"))
        own = low.select("node", "root", "new").join(told, "node", "left").select("node", "root", F.least("new", "told").alias("new"))
        own = own.withColumn("new", F.coalesce("new", "root"))
        jump = own.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = _cut(own.join(jump, "new", "left").select("node", "root", F.least("new", "far").alias("new")))
        if nxt.where("new <> root").isEmpty():
            return labels
        labels = nxt.select("node", F.col("new").alias("root"))
    raise RuntimeError(f"components are not complete after {max_rounds} rounds")
