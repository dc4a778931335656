"""Ships this package to the executors, whose Python workers need it for Arrow functions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, whoever reads it, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """``df`` dealt out by ``keys`` once and written as a table in the shared folder; joins on the keys find it in place. If it is ``dealt`` out by them already, it is written as it lies."""
    spark = df.sparkSession
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
