"""Notices whose number has more digits than the six of the short form."""

import datetime as dt

import pytest

from tendermill import registry

DAY = dt.datetime(1996, 3, 4)


@pytest.fixture
def folder(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("orders", [(i, 7, "O", 10.0, DAY, "1-URGENT") for i in (5, 123456, 1234560, 1234561, 12345678)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    put("customer", [(7, "C", 1, 0.0, "M")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("nation", [(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int")
    return str(tmp_path)


def test_control_number_keeps_all_digits(spark, folder):
    rows = registry.queries()["src_12_control_number"](spark, folder).collect()
    assert sorted((r["id"], r["cnpj"], r["ano"], r["seq"]) for r in rows) == [(i, "00000000000007", 1996, i) for i in (5, 123456, 1234560, 1234561, 12345678)]


def test_ingest_tells_long_numbers_apart(spark, folder):
    rows = registry.queries()["str_01_ingest"](spark, folder).collect()
    assert sorted((r["id"], r["id_externo"][15:]) for r in rows) == [(5, "1-000005/1996"), (123456, "1-123456/1996"), (1234560, "1-123456/1996"), (1234561, "1-123456/1996"), (12345678, "1-123456/1996")]
