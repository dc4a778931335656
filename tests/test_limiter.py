"""The attempt limiter against one plain walk of all attempts, as a batch and as a running stream."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tendermill.streaming import streams

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = dt.datetime(2024, 1, 1)
SCHEMA = "chave long, ts timestamp, limpa boolean"


def attempts(n, keys, seed, step=40):
    draw, now, out = random.Random(seed), START, []
    for _ in range(n):
        now += dt.timedelta(seconds=draw.choice([0, 1, 5, step]))
        out.append((draw.choice(keys), now, draw.random() < 0.05))
    return out


def plain(rows, limit, window):
    """The definition, key by key, without segments."""
    out = []
    for key in {r[0] for r in rows}:
        alive = []
        for _, ts, clear in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if clear:
                alive = []
                continue
            alive = [a for a in alive if (ts - a).total_seconds() < window]
            ok = len(alive) < limit
            out.append((key, ts, ok, 0 if ok else int(window - (ts - alive[0]).total_seconds()) + 1))
            alive += [ts] if ok else []
    return sorted(out)


@pytest.mark.parametrize(("n", "keys", "limit", "window"), [(0, [1], 3, 60), (400, [1, 2, 3], 3, 60), (1500, [7] * 20 + [1, 2], 2, 30), (300, [5], 1, 4)])
def test_batch_equals_the_plain_walk(spark, n, keys, limit, window):
    rows = attempts(n, keys, n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in streams.attempt_limiter(frame, limit, window).collect())
    assert got == plain(rows, limit, window)


def test_a_hot_key_is_walked_in_many_tasks(spark):
    rows = attempts(2000, [7], 1)
    parts = streams.segments(spark.createDataFrame(rows, SCHEMA), 30)
    sizes = [r["n"] for r in parts.groupBy("trecho").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000 and len(sizes) > 100 and max(sizes) < 200


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.unset(PROVIDER)


def run(spark, folder, limit, window, spare=86_400):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = streams.attempt_limiter_stream(source, limit, window, spare).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start(str(folder / "out"))
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).select("chave", "ts", "admitido", "espera").collect())


def test_stream_over_batches_and_a_restart(spark, rocks, tmp_path):
    rows = attempts(240, [1, 2, 3], 9)
    for k in range(3):
        spark.createDataFrame(rows[k * 60 : (k + 1) * 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    run(spark, tmp_path, 3, 60)
    spark.createDataFrame(rows[180:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, 3, 60) == plain(rows, 3, 60)


def test_state_expires(spark, rocks, tmp_path):
    first, second = [(1, START, False)], [(1, START + dt.timedelta(seconds=1), False)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r[2] for r in run(spark, tmp_path, 1, 2, spare=0)] == [True]
    time.sleep(3)  # longer than the state lives, by the clock
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r[2] for r in run(spark, tmp_path, 1, 2, spare=0)] == [True, True]


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        streams.attempt_limiter_stream(spark.createDataFrame([], SCHEMA), 1, 1)
