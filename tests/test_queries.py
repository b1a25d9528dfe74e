"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import registry

registry.load_all()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6f}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    out = registry.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    got = [tuple(r[c] for c in cols) for r in out.collect()]
    sql = duck.sql(registry.ORACLES[name])
    at = [sql.columns.index(c) for c in cols]
    assert sorted(sql.columns) == cols
    assert plain(got) == plain([tuple(r[i] for i in at) for r in sql.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["covmat_curve", "batch_metrics", "seeded_shuffle", "pack_chunk"])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_partition_count_does_not_matter(spark, name, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = plain(registry.QUERIES[name](spark, SF).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert plain(registry.QUERIES[name](spark, SF).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
