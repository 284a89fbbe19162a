"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

from terrachron.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def between(low, high, *names):
    return lambda r: all(r[n] is None or low <= r[n] <= high for n in names)


#: What every row of a query without SQL must meet.
MEETS = {
    "snic": between(-1, 1 << 62, "segment"),
    "bfast_monitor_o1": lambda r: r["valid"] in (0, 1) and (not r["has_break"] or r["valid"]),
    "ccdc": lambda r: r["t_start"] <= r["t_end"] and (r["t_break"] == 0 or r["t_break"] > r["t_end"]) and 0 <= r["change_prob"] <= 1 and len(r["coefs"]) == 6 and min(r["rmse"]) >= 0,
    "tmask": lambda r: r["clear"] in (True, False),
    "landtrendr": lambda r: r["n_vertices"] == len(r["years"]) and r["years"] == sorted(set(r["years"])) and r["rmse"] >= 0,
    "phenology_beck": lambda r: r["der_sos"] <= r["pop"] <= r["der_eos"] and r["trs2_sos"] <= r["pop"] <= r["trs2_eos"] and r["rmse"] >= 0 and (r["r2"] is None or r["r2"] <= 1),
    "phenology_ag": lambda r: r["der_sos"] <= r["pop"] <= r["der_eos"] and r["trs5_sos"] <= r["pop"] <= r["trs5_eos"] and r["rmse"] >= 0,
    "tempcnn": between(0, 4, "class"),
    "light_attention": between(0, 4, "class"),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_repeats_and_meets_its_terms(spark, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    assert got and len(set(df.columns)) == len(df.columns)
    assert all(MEETS.get(name, lambda r: True)(r) for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, registry.queries()[name](spark, SF).collect()))


@pytest.mark.parametrize("name", ["mk_hamed_rao", "composite_medoid", "bfast_lite", "landtrendr", "regularize_16d_median"])
def test_result_does_not_depend_on_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(repr, registry.queries()[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]
