import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["q02_normalize_dates", "q05_reject_reasons", "q10_status_ledger", "q15_membership_asof", "q25_factor_panel"])
def test_query_counts_match(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = connection.sql(f"select count(*) from ({entry.oracle_sql()[name]})").fetchall()[0][0]
    assert entry.queries()[name](spark, SF).count() == want


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
