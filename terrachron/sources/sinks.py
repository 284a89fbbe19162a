"""Writing cubes: tiled Parquet, date sidecars, segment outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scenes import date_sidecar


def write_tiles(cells: DataFrame, path: str, size: int = 512) -> None:
    """Cells (y, x, ..) in a folder a tile, each tile written by one task."""
    t = lambda c: F.floor(F.col(c) / size).cast("int")
    out = cells.withColumn("tile_y", t("y")).withColumn("tile_x", t("x"))
    out.repartition("tile_y", "tile_x").sortWithinPartitions("tile_y", "tile_x", "y", "x").write.partitionBy("tile_y", "tile_x").parquet(path)


def write_sidecar(obs: DataFrame, path: str) -> None:
    """The cube's dates as CSV."""
    date_sidecar(obs).orderBy("date").coalesce(1).write.option("header", True).csv(path)  # one row a date


def outlines(labels: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = -1.0) -> DataFrame:
    """(segment, wkt): each segment as a multipolygon of its runs within rows, in map coordinates."""
    from pyspark.sql import Window

    w = Window.partitionBy("segment", "y").orderBy("x")
    run = labels.where("segment >= 0").withColumn("g", F.col("x") - F.row_number().over(w))
    runs = run.groupBy("segment", "y", "g").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    px = lambda c: (F.lit(x0) + c * dx).cast("string")
    py = lambda c: (F.lit(y0) + c * dy).cast("string")
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    ring = F.concat_ws(", ", *[F.concat_ws(" ", px(p), py(q)) for p, q in ((a, y), (b, y), (b, y + 1), (a, y + 1), (a, y))])
    poly = runs.select("segment", "y", "a", F.concat(F.lit("(("), ring, F.lit("))")).alias("p"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("y", "a", "p"))), lambda s: s["p"])
    return poly.groupBy("segment").agg(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")).alias("wkt"))
