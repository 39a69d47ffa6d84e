"""Every query of the catalogue against its DuckDB statement."""

import pytest

from meterlake.plans import catalog
from meterlake.session import shared_dir
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_a_statement():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "ts", "event_type", "value"]
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_report_reaches_the_scan(spark):
    plan = catalog.QUERIES["q02_api_report"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(event_type" in plan and "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["q46_stream_rpm", "q47_stream_dedupe"])
def test_streams_write_to_the_shared_folder(spark, name):
    files = catalog.QUERIES[name](spark, DATA).inputFiles()
    shared = shared_dir(spark).split(":")[-1].lstrip("/")
    assert files and all(shared in f and f.endswith(".parquet") for f in files)
