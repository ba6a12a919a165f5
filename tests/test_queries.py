"""Every query with SQL against DuckDB on the smallest tables, and all others for their rows."""

import os

import duckdb
import pytest

from stratacell.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = con.sql(catalog.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_labels_beyond_four_letters(spark, tmp_path):
    """As many customers as larger tables have: what the SQL gives past zzzz, in one byte, two and three."""
    keys = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 899999, 18278 + 17576 * 31, 18278 + 17576 * 158, 18278 + 17576 * 159 + 5, 18278 + 17576 * 3000 + 77, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.QUERIES["labels_and_numbers"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = c.sql(catalog.SQL["labels_and_numbers"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("scale", [1.7, 0.0])
def test_gower_pairs_are_spread(spark, tmp_path, monkeypatch, scale):
    """Entities without a balance, and both ways of the join, with few pairs a task."""
    data = [(k, k % 3 if k != 5 else None, None if k == 4 else k * scale) for k in range(40)]
    spark.createDataFrame(data, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = c.sql(catalog.SQL["gower_pairs"])
    want = rows(want.columns, want.fetchall())
    monkeypatch.setattr("stratacell.plans.relations.TASK_PAIRS", 200, raising=False)
    for most in (1_000_000, 0):
        monkeypatch.setattr("stratacell.plans.relations.BROADCAST_ENTITIES", most, raising=False)
        got = catalog.QUERIES["gower_pairs"](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 8
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
