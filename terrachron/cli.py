"""Command line: `python -m terrachron.cli <command> in.parquet out.parquet [options]` over series or raster tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrachron", description="Per-pixel time-series analysis on Parquet tables.")
    s = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, **options):
        c = s.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
        for k, v in options.items():
            if isinstance(v, bool):
                c.add_argument(f"--{k.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=v)
            else:
                c.add_argument(f"--{k.replace('_', '-')}", type=type(v), default=v)
        return c

    add("landtrendr", "trajectories and their main event", max_segments=6, pval_threshold=0.05, recovery_threshold=0.25, spike_threshold=0.9, best_model_proportion=0.75, vertex_count_overshoot=3, min_observations_needed=6, event="loss", sort_by="greatest", min_magnitude=0.0, min_duration=1, pre_val=0.0, output_scale=1.0, save_vertices=True)
    add("ccdc", "segments of harmonic models", consecutive=6, chi2_prob=0.99, dates="", first_day=0, every=16)
    grid = {"start_time": 0.0, "frequency": 12, "order": 3}
    add("bfast-monitor", "breaks in a monitoring period", **grid, monitor_start=0.0, h=0.25, period=10, alpha=0.05, min_valid=10)
    add("bfast-lite", "optimal partition", **grid, h=0.15, max_breaks=5, min_valid=20)
    add("bfast", "breaks in trend and season", **grid, h=0.15, max_breaks_trend=5, max_breaks_season=5, max_iter=10, level=0.05, min_valid=20)
    add("mann-kendall", "trend tests", method="hamed_rao", alpha=0.05, lag=-1, period=1, min_valid=4)
    add("mmu-filter", "drop small patches of a raster", mmu_pixels=11, nodata=0.0)
    return p


def plan(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    o = {k: v for k, v in vars(a).items() if k not in ("command", "input", "output")}
    if a.command == "landtrendr":
        from .operators.events import extract_events
        from .operators.trajectory import Options, segment

        event, by, scale, vertices = o.pop("event"), o.pop("sort_by"), o.pop("output_scale"), o.pop("save_vertices")
        least = {k: o.pop(k) for k in ("min_magnitude", "min_duration", "pre_val")}
        v = segment(df, Options(**o, modifier=-1.0 if event == "loss" else 1.0))
        events = extract_events(v, event, by, **least)
        for c in ("magnitude", "pre_val", "post_val", "rate"):
            events = events.withColumn(c, F.col(c) * scale)
        return (v if vertices else v.select("pixel")).join(events, "pixel")
    if a.command == "ccdc":
        from .operators.harmonic import Settings, ccdc

        dates, first, every = o.pop("dates"), o.pop("first_day"), o.pop("every")
        if dates:  # a text file with an ordinal day a line; other lines are left out
            days = [int(x) for (x,) in df.sparkSession.read.text(dates).collect() if x.strip().isdigit()]
            df = df.withColumn("ts", F.array(*[F.lit(d) for d in days]))
        elif first:
            df = df.withColumn("ts", F.transform(F.get("bands", 0), lambda _, i: (F.lit(first) + i * every).cast("int")))
        return ccdc(df, Settings(**o))
    if a.command == "mann-kendall":
        from .operators.trend import mann_kendall

        lag = o.pop("lag")
        return mann_kendall(df, **o, lag=None if lag < 0 else lag)
    if a.command == "mmu-filter":
        from .operators.spatial import minimum_mapping_unit

        return minimum_mapping_unit(df, o["mmu_pixels"], o["nodata"])
    from .operators import breaks

    f = {"bfast-monitor": breaks.monitor, "bfast-lite": breaks.lite, "bfast": breaks.classic}[a.command]
    return f(df, **o)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("terrachron").getOrCreate()
    plan(spark.read.parquet(a.input), a).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
