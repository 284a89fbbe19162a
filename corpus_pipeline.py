"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

run() applies the stages to documents, each on all that the one before kept. Rows may have null or repeated ids; such
rows go through every stage by a key of their own (`row_key`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.llm import decontam, langid, mixing, sharding, simhash
from terrachron.llm.common import arrow_rows, stored

#: Mixing keeps this share of the tokens and repeats none: small sources stay whole, large ones are thinned.
BUDGET_SHARE = 0.9
SHARDS = 24


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores in front until no column of docs has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def row_key(docs: DataFrame) -> Column:
    """The id; without one, a negative number made of the text."""
    return F.coalesce(F.col("doc_id"), -F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62)) - 2)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts with no letter. The others' lang is filled with the
    prediction where it is null; if no row has a lang, nothing is learned and it stays null. Repeated rows stay; an
    empty table stays empty; other columns pass unread."""
    model = langid.learn(docs)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(text).to_pylist()
            parts = [texts[s : s + 500] for s in range(0, len(texts), 500)]
            pred = [p for part in parts for p in model.predict(part)[0]]
            good = [p != "und" for p in pred] if model.langs else [bool(x) for part in parts for x in langid.lettered(part)]
            named = [(p if model.langs else None) if g is None else g for g, p in zip(batch.column(lang).to_pylist(), pred)]
            cols = batch.columns
            cols[lang] = pa.array(named, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array(good, pa.bool_()))

    return arrow_rows(docs).mapInArrow(keep, docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates the row with the least key; of rows that repeat a key and its text,
    one. A null text counts as empty, and empty texts are equal; an empty table stays empty; other columns may have any
    name."""
    k, r, c, n = fresh(docs, "_key", "_row", "_c", "_n")
    keyed = docs.withColumn(k, row_key(docs)).withColumn(r, F.xxhash64(k, F.coalesce("text", F.lit(""))))
    found = simhash.near_duplicates(keyed.select(F.col(r).alias("_row"), "text"), "_row", "text").groupBy("_row").agg(F.min("component_id").alias(c))
    rows = keyed.groupBy(r).agg(F.min(k).alias(k), F.count(F.lit(1)).alias(n))
    least = rows.join(found.withColumnRenamed("_row", r).hint("merge"), r).groupBy(c).agg(F.min(F.struct(k, r, n)).alias("f"))
    first = stored(least.select(F.col("f").getField(r).alias(r), F.col("f").getField(n).alias(n)), "dedup-first")
    kept = keyed.join(first.hint("merge"), r)  # the kept rows grow with the corpus: never broadcast
    own = [F.col(f"`{x}`") for x in docs.columns]
    once, again = kept.where(F.col(n) == 1).select(*own), kept.where(F.col(n) > 1)
    if again.select(r).isEmpty():
        return once
    columns = [F.first(x).alias(name) for x, name in zip(own, docs.columns)]
    return once.unionByName(again.groupBy(r).agg(*columns).drop(r))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; repeated rows are dropped or kept
    alike; an empty table or benchmark drops nothing; other columns pass unread."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a mixture of BUDGET_SHARE of the tokens, none taken twice. Null sources are one source;
    null texts have no token and cost nothing; rows that share an id are kept or dropped together; an empty table stays
    empty; other columns may have any name."""
    (k,) = fresh(docs, "_key")
    keyed = docs.withColumn(k, row_key(docs))
    chosen = mixing.mix(keyed.select(F.col(k).alias("_key"), "source", "text"), "_key", budget_share=BUDGET_SHARE, repeats=1.0)
    taken = chosen.select(F.col("_key").alias(k)).distinct()
    return keyed.join(taken.hint("merge"), k, "left_semi").select(*[F.col(f"`{x}`") for x in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document: doc_id, size, text_crc32, shard, slot. Null ids and texts, repeated rows and empty tables
    as in sharding.shard_rows; other columns are not read."""
    return sharding.shard_rows(docs.select("doc_id", "text"), SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]
#: Learned models, similarity links and sampled boundaries aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
