"""Typed loading: twelve tables, sources that lack columns, have others, or have them of the wrong type."""

import pytest
from pyspark.sql import functions as F

from tendermill.sources import schemas

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_twelve_tables(spark):
    assert len(schemas.TABLES) == 12
    for name in schemas.TABLES:
        schema = schemas.schema_of(name)
        frame = spark.createDataFrame([], schema)
        assert [(f.name, f.dataType) for f in schemas.typed(frame, name).schema.fields] == [(f.name, f.dataType) for f in schema.fields]
    with pytest.raises(KeyError, match="no table"):
        schemas.schema_of("nada")


def items(spark):
    return spark.range(20).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 3).alias("edital_id"), F.lit("x").alias("descricao"), F.lit(1.5).cast("float").alias("quantidade"), F.lit(True).alias("a.b"))


def test_missing_and_extra_columns(spark, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/itens_edital")
    got = schemas.load(spark, str(tmp_path), "itens_edital")
    assert got.columns == schemas.schema_of("itens_edital").names
    assert dict(got.dtypes)["id"] == "bigint" and got.filter("ncm is null and quantidade = 1.5").count() == 20
    plan = got.filter("edital_id = 1").select("descricao")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(edital_id), EqualTo(edital_id,1)]" in plan and "ReadSchema: struct<edital_id:bigint,descricao:string>" in plan


def test_all_problems_are_named(spark, tmp_path):
    items(spark).drop("descricao").withColumn("quantidade", F.lit("1,5")).withColumn("edital_id", F.lit(1.0)).write.parquet(f"{tmp_path}/itens_edital")
    with pytest.raises(schemas.SchemaError) as e:
        schemas.load(spark, str(tmp_path), "itens_edital")
    assert e.value.problems == ["edital_id is double, not bigint", "descricao is missing", "quantidade is string, not double"]


def test_databases_are_read_in_ranges(spark):
    url = "jdbc:derby:memory:tenders;create=true"
    items(spark).drop("a.b").write.mode("overwrite").jdbc(url, "itens_edital", properties=DERBY)
    got = schemas.load_jdbc(spark, url, "itens_edital", DERBY, partitions=4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in got.collect()) == list(range(20))
    assert "PushedFilters: [*IsNotNull(EDITAL_ID), *EqualTo(EDITAL_ID,1)]" in got.filter("edital_id = 1")._jdf.queryExecution().toString().replace("edital_id", "EDITAL_ID")
    spark.createDataFrame([("a", "b")], "chave string, valor string").write.mode("overwrite").jdbc(url, "configuracoes", properties=DERBY)
    assert [tuple(r) for r in schemas.load_jdbc(spark, url, "configuracoes", DERBY).collect()] == [("a", "b")]
    items(spark).drop("a.b").limit(0).write.mode("overwrite").jdbc(url, "itens_edital", properties=DERBY)
    assert schemas.load_jdbc(spark, url, "itens_edital", DERBY).count() == 0
