"""Registry tables on storage: one folder per save, ``run=1``, ``run=2`` and so on.

A save never touches what it may be reading: it writes the next folder, which counts once its
job has committed (``_SUCCESS``).  Earlier versions stay, as frames may still read them, until
``clear``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class RegistryError(RuntimeError):
    pass


def _place(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _runs(spark: SparkSession, path: str) -> dict[int, bool]:
    """Numbers of the saved versions and whether each is complete."""
    store, place = _place(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    numbers = [int(m[1]) for name in names if (m := re.fullmatch(r"run=(\d+)", name))]
    return {n: store.exists(_place(spark, f"{path}/run={n}/_SUCCESS")[1]) for n in numbers}


def _remove(spark: SparkSession, path: str, numbers) -> None:
    for n in numbers:
        store, place = _place(spark, f"{path}/run={n}")
        store.delete(place, True)


def _complete(spark: SparkSession, path: str) -> list[int]:
    return sorted(n for n, done in _runs(spark, path).items() if done)


def save(registry: DataFrame, path: str) -> None:
    spark = registry.sparkSession
    registry.write.parquet(f"{path}/run={1 + max(_runs(spark, path), default=0)}")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_complete(spark, path))


def load(spark: SparkSession, path: str) -> DataFrame:
    found = _complete(spark, path)
    if not found:
        raise RegistryError(f"no registry at {path}")
    return spark.read.parquet(f"{path}/run={found[-1]}")


def clear(spark: SparkSession, path: str) -> None:
    """Forget a registry: tokens made with it can no longer be restored."""
    if exists(spark, path):
        old = list(_runs(spark, path))
        save(spark.createDataFrame([], load(spark, path).schema), path)
        _remove(spark, path, old)
