import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_keep_and_drop(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = {g: ["".join(rng.choice(s, 3)) for _ in range(900)] for g, s in (("aa", ["ba", "du", "ki", "mo", "te"]), ("bb", ["xor", "yel", "zim", "wun", "qua"]))}
    item = " ".join(rng.choice(vocab["aa"], 40))
    rows = []
    for i in range(200):
        g = "aa" if i % 3 else "bb"
        t = " ".join(rng.choice(vocab[g], 150))
        rows.append((i, t, g if i % 11 else None, f"s{i % 3}", len(t)))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", rows[i][4]) for i in range(10)]  # copies
    edited = rows[20][1].split()
    edited[70] = "edit"
    rows.append((300, " ".join(edited), "aa", "s1", 1))
    rows += [(400, None, "aa", "s0", None), (401, " 12 ", "aa", "s0", 4), (402, "", None, None, 0)]
    leak = rows[33][1] + " " + item + " " + rows[34][1]
    rows += [(500, leak, "aa", "s0", 1), (None, "unlabelled " + rows[40][1][::-1], None, None, 1), (199, rows[199][1], "aa", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    a = P.language(spark, docs, str(tmp_path))
    assert a.schema == docs.schema
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in a.collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in (400, 401, 402))
    b = P.near_dedup(spark, a, str(tmp_path))
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in b.collect())
    assert ids == sorted([*range(200), 500, -1])
    c = P.decontaminate(spark, b, str(tmp_path))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in c.collect()) == sorted([*range(200), -1])
    d = P.mix_sources(spark, c, str(tmp_path))
    n = d.count()
    assert d.columns == docs.columns and 0.8 * 201 < n <= 201 and d.exceptAll(c.select(d.columns)).count() == 0
    e = P.shard(spark, d, str(tmp_path))
    assert e.count() == n and e.agg(F.max("shard")).first()[0] == P.SHARDS - 1
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in e.collect()}


def test_repeated_ids_keep_their_texts(spark, tmp_path):
    rng = np.random.default_rng(4)
    t = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5)]
    rows = [(1, t[0]), (1, t[1]), (1, t[1]), (2, t[1]), (3, t[2]), (None, t[3]), (None, t[4]), (0, t[2])]
    docs = spark.createDataFrame([(i, x, "aa", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert len(got) == 5 and set(got) == {(1, t[0]), (1, t[1]), (0, t[2]), (None, t[3]), (None, t[4])}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_no_languages(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"u{chr(97 + x % 26)}{chr(97 + x // 26)}e" for x in rng.integers(0, 600, 80)) for _ in range(30)]
    names = ("_key", "_row", "_c", "_n", "_u", "n", "block", "place", "h", "u", "rng", "id", "k")
    rows = [(i, t, None, "s", 1, *[1000 * j + i for j in range(len(names))]) for i, t in enumerate([*texts, texts[0], " 1 "])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.schema == spark.read.parquet(str(tmp_path / "documents.parquet")).schema, name
            got = docs.collect()
            assert len(got) == (31 if k == 0 else 30) if k < 3 else len(got) >= 25, name
            assert all(r["lang"] is None and all(r[n] == 1000 * j + r["doc_id"] for j, n in enumerate(names)) for r in got), name
    assert docs.count() >= 25
