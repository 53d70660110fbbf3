"""Every registered query of the library against its DuckDB SQL."""

import pytest

from sluice.plans.queries import QUERIES, SQL

from .compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_ingestion_time_is_set(spark, sf_dir):
    assert QUERIES["ingested_at"](spark, sf_dir).filter("ingested_at is null").isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "o_totalprice", "day", "segment"]
    assert set(e.oracle_sql()) <= set(e.queries())
