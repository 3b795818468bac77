"""Registered queries against their SQL twins."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from maskwright import catalogue

SF_DIR = os.environ.get("MASKWRIGHT_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF_DIR}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    if not os.path.isdir(__spark_entry__.SMOKE_DIR):
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["resolve_overlaps", "findings_by_type_source"])
def test_types_without_a_twin(spark, tmp_path, name):
    """Larger tables have text that rules without a twin find: digits like telephone numbers, dates, addresses on the web."""
    texts = ["token 0641917ea4 55", "on 2024-01-02 see http://x.org/y or mail5@b.org", "+81-90-1234-5678 and 10.0.0.1", "555-9331 4913187196670932 53.121.55.90", "heit"]
    spark.createDataFrame([(i, x, "src0", "en") for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    result = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", ["merge_sort_findings"])
def test_ids_below_zero(spark, tmp_path, name):
    """Odd ids below zero have a remainder of -1."""
    texts = ["heit 10.0.0.1", "mail5@b.org", "55 heit", "eit"]
    spark.createDataFrame([(i - 3, x, "src0", "en") for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    result = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
