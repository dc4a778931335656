"""What the corpus operators share: shared-folder tables, words, and bindings inside expressions."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..runtime import scratch

#: White space between words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\f\r"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return scratch(spark, name)


_guard = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """While any thread is inside, a job's shuffle files go when it ends, not when the driver happens to collect garbage."""
    key = spark.sparkContext.applicationId
    with _guard:
        n, before = _writers.get(key, (0, spark.conf.get(_CLEANUP, "false")))
        _writers[key] = (n + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _guard:
            n, before = _writers.pop(key)
            if n > 1:
                _writers[key] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and it outlives lost executors."""
    return _write(df, fresh_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what lies under a path of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables of one operator's run in the shared folder and the warehouse; all but those kept go when the ``with`` block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._named = spark, [], []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self._paths.append(path)
        return _write(df, path)

    def bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """``df`` dealt out by ``keys`` once; later joins on all of them find it in place."""
        buckets = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        table, path = f"{name}_{uuid.uuid4().hex}", fresh_path(self.spark, name)
        self._named.append(table)
        self._paths.append(path)  # in the shared folder, as the warehouse may lie on one machine
        with _shuffle_files_go(self.spark):
            df.repartition(buckets, *keys).write.option("compression", "zstd").bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for t in self._named:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        for p in self._paths:
            delete(self.spark, p)
        self._paths, self._named = [], []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a name, so that it is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def quoted(name: str) -> str:
    """A column's name as a reference that holds for any name, also one with dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def map_rows(df: DataFrame, run: Callable, added: list[StructField]) -> DataFrame:
    """``df.mapInArrow(run)`` that adds columns behind all others, which may have any names: ``run`` sees them by their place."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *added])).toDF(*df.columns, *[a.name for a in added])
