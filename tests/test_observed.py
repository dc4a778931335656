"""Figures that a write takes of its own rows, and of batches as they end."""

import time

import pytest
from pyspark.sql import functions as F

from tendermill.operators import tables
from tendermill.streaming import streams

ROWS = "fonte string, nivel string, novo boolean, k int"


def run(spark):
    rows = [("a", "forte", True, 1), ("a", None, True, 2), ("a", "forte", None, 3), ("b", "fraca", False, 4), ("b", "fraca", False, 4)]
    return spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame([("c", "x" * 900), ("a", "z"), ("a", "y")], "fonte string, erro string")


def test_a_log_in_one_scan(spark, tmp_path):
    batch, errors = run(spark)
    scans = spark.sparkContext.accumulator(0)

    def seen(pdfs):
        for pdf in pdfs:
            scans.add(len(pdf))
            yield pdf

    got = tables.write_with_log(batch.mapInPandas(seen, batch.schema), str(tmp_path / "o"), ["a", "b", "c", "d", "a"], errors)
    show = lambda df: sorted(tuple(r) for r in df.select("fonte", "vistos", "novos", "fortes", "erro").collect())
    assert show(got) == show(tables.run_log_by_source(batch, errors)) == [("a", 3, 2, 1, "y"), ("b", 2, 0, 0, None), ("c", 0, 0, 0, "x" * 500)]
    assert scans.value == 5 and spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_rows_of_unknown_sources_and_no_rows(spark, tmp_path):
    batch, errors = run(spark)
    with pytest.raises(ValueError, match="not named"):
        tables.write_with_log(batch, str(tmp_path / "o"), ["a"], errors)
    with pytest.raises(ValueError, match="not named"):
        tables.write_with_log(batch.withColumn("fonte", F.when(F.col("k") > 1, F.col("fonte"))), str(tmp_path / "p"), ["a", "b"], errors)
    with pytest.raises(ValueError, match="at most"):
        tables.write_with_log(batch, str(tmp_path / "q"), [str(i) for i in range(201)], errors)
    assert tables.write_with_log(batch.filter("k > 9"), str(tmp_path / "r"), ["a"], errors.filter("fonte is null")).count() == 0


def test_progress_of_a_recompute(spark, tmp_path):
    """A row for each batch from the write itself, and a listener that hears of each batch and of the end."""
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    source, listener = streams.read_files(spark, str(tmp_path / "in"), "id long", 1), streams.BatchProgress()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    spark.streams.addListener(listener)
    try:
        query = streams.resumable_recompute(source, lambda b: b.filter("id % 2 = 0"), out, str(tmp_path / "c"), log)
        query.awaitTermination()
        for _ in range(100):
            if query.id in listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.ended == {query.id: None}
    assert sum(rows for _, _, rows, _ in listener.batches) >= 30 and {b for _, b, _, _ in listener.batches} == {0, 1, 2}
    by_log = {r["lote"]: r["n"] for r in streams.recompute_progress(spark, out, log).collect()}
    assert by_log == {r["lote"]: r["n"] for r in streams.recompute_progress(spark, out).collect()} and sum(by_log.values()) == 15
    assert streams.recompute_progress(spark, out, str(tmp_path / "none")).count() == 0
