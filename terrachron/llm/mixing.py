"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised. As a falls from 1 to 0 the weights go from the
shares to uniform, the entropy rises and small sources are repeated more; a is bisected to the target. The weights are
then budgets of tokens: a source gives whole passes while its budget lasts and of the last pass the blocks that come
first in a keyed permutation, down to the document at which the budget is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, read_table, stored, text_or_empty

#: Exponents tried at once in a pass over the sources; PASSES narrow the bracket to GRID ** -PASSES.
GRID, PASSES = 32, 4
#: Blocks of a source, at least, and documents of a block of the largest source; a budget is met within one block.
BLOCKS, DOCS_PER_BLOCK = 1024, 4096
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    """Words of the text; a null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_table(rows: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens): pre-aggregated, so a hot source is one row a task."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def exponent(sources: DataFrame, *, budget: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The least exponent in 0 to 1 that keeps every source to `repeats` passes, or the one that gives the entropy
    (nats), if that is given. Each pass tries a grid of exponents in one aggregation; the sources never come to the
    driver. A target that no exponent meets raises a ValueError: an entropy above that of equal weights or below that of
    the shares themselves, or fewer passes than the shares need (budget over all tokens). Without tokens it is 1.
    """
    live = sources.where("n_tokens > 0").select("n_tokens")
    total = float(live.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return 1.0
    p = F.col("n_tokens") / F.lit(total)
    low, high = 0.0, 1.0
    for step in range(PASSES):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        cols = []
        for i, a in enumerate(grid):
            pa = F.pow(p, F.lit(a))
            # passes of a source: budget * p^a / Z / tokens, at most at the least or the greatest source
            cols += [F.sum(pa).alias(f"z{i}"), F.sum(pa * F.log(p) * a).alias(f"e{i}"), F.max(pa / F.col("n_tokens")).alias(f"r{i}")]
        got = live.agg(*cols).first()
        reached = [math.log(got[f"z{i}"]) - got[f"e{i}"] / got[f"z{i}"] for i in range(GRID + 1)]
        if step == 0 and entropy is not None and not reached[-1] - 1e-9 <= entropy <= reached[0] + 1e-9:
            raise ValueError(f"an entropy of {entropy} is out of reach: the sources allow {reached[-1]:.6g} to {reached[0]:.6g} nats")
        if entropy is not None:
            good = [x <= entropy for x in reached]
        elif repeats is not None:
            good = [budget * got[f"r{i}"] / got[f"z{i}"] <= repeats * (1 + 1e-12) for i in range(GRID + 1)]
            if step == 0 and not good[-1]:
                raise ValueError(f"{repeats} passes give no more than {repeats * total:.6g} tokens of the {budget:.6g} wanted")
        else:
            return 1.0
        # both conditions hold from some exponent upwards
        first = next((i for i, g in enumerate(good) if g), GRID)
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, budget_share: float = 1.0, entropy: float | None = None, repeats: float | None = 4.0, seed: int = 1) -> DataFrame:
    """(key, source, n_tokens, epoch, block, place): the documents of the mixture, repeated ones once an epoch.

    Null sources are one source. Documents without a token belong to their block and cost nothing. place orders the
    mixture: blocks of all sources by a keyed hash, documents within a block by another; ties (repeated rows) share
    one place. There are as many blocks as the largest source needs to have DOCS_PER_BLOCK documents in each, and no
    window is larger than one block or the blocks of one source; rows with a null id are spread over the blocks by
    their place in the table. An empty table gives no row; targets out of reach raise (see `exponent`).
    """
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("source"), tokens(text).alias("n_tokens"), F.when(F.col(f"`{key}`").isNull(), F.monotonically_increasing_id()).alias("_u"))
    rows = stored(rows, "mix-rows")
    most = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    count = max(BLOCKS, -(-most // DOCS_PER_BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.col("_u"), F.lit(seed)), F.lit(count)).cast("int"))
    blocks = stored(rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mix-blocks")
    sources = stored(blocks.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mix-sources")
    total = float(sources.agg(F.sum("n_tokens")).first()[0] or 0)
    budget = budget_share * total
    a = exponent(sources, budget=budget, entropy=entropy, repeats=repeats)
    z = sources.where("n_tokens > 0").agg(F.sum(F.pow(F.col("n_tokens") / F.lit(total or 1.0), F.lit(a)))).first()[0] or 1.0
    share = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(total or 1.0), F.lit(a)) / F.lit(z)).otherwise(0.0)
    passes = F.when(F.col("n_tokens") > 0, share * budget / F.col("n_tokens")).otherwise(0.0)
    # a relative 1e-9 above or below a whole number of passes is rounding
    plan = stored(
        sources.select(F.col("source").alias("s"), (share * budget).alias("want"), F.floor(passes + 1e-9).cast("int").alias("full"), F.col("n_tokens").alias("all")),
        "mix-plan",
    )
    rest = F.greatest(F.lit(0.0), F.col("want") - F.col("full") * F.col("all"))
    order = F.xxhash64("source", "block", "full", F.lit(seed + 1))
    w = Window.partitionBy("source").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, 0)  # a row a block
    cut = (
        blocks.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("o", order)
        .withColumn("upto", F.sum("n_tokens").over(w))
        .select("source", "block", "full", rest.alias("rest"), (F.col("upto") - F.col("n_tokens")).alias("before"), "upto")
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "full", (F.col("upto") <= F.col("rest") + 1e-6).alias("whole"), (F.col("rest") - F.col("before")).alias("left"))
    )
    cut = stored(cut, "mix-cut")
    same = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("block") == F.col("b"))
    at = rows.join(cut, same)
    passes = at.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    last = at.where(F.col("whole") & (F.col("left") > 0)).withColumn("epoch", F.col("full"))
    # the one block of each source in which the budget runs out: documents in keyed order while it lasts
    d = Window.partitionBy("s", "b").orderBy(F.xxhash64(F.col(key), F.lit(seed + 2)), F.col(key), F.col("_u")).rowsBetween(Window.unboundedPreceding, 0)
    partly = at.where(~F.col("whole") & (F.col("left") > 0)).withColumn("upto", F.sum("n_tokens").over(d)).where(F.col("upto") - F.col("n_tokens") < F.col("left")).drop("upto").withColumn("epoch", F.col("full"))
    names = [key, "source", "n_tokens", "epoch", "block"]
    out = passes.select(*names).unionByName(last.select(*names)).unionByName(partly.select(*names))
    place = F.struct(F.xxhash64("source", "block", "epoch", F.lit(seed + 3)), F.xxhash64(F.col(key), F.col("epoch"), F.lit(seed + 4)))
    return out.withColumn("place", F.concat(F.hex(place.getField("col1")), F.lit(":"), F.hex(place.getField("col2"))))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), budget_share=1.0, repeats=4.0)
