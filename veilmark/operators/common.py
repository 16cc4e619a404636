"""Shared physical helpers: cutting lineage and measuring sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of one partition up to which they are not dealt anew.
SPREAD_ROWS = 10_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this application below ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave it unset: executors of a cluster do not
    see each other's temporary folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise *df* in the shared checkpoint folder and forget its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """Write *df* as a table in the shared checkpoint folder and read it back.

    Unlike :func:`cut`, whose result keeps the size estimate of the plan it came from, the new plan knows
    the true size.  Loops need this: estimates that multiply with every join grow without bound.  The table
    is columnar, so later steps read the columns they need.
    """
    spark = df.sparkSession
    if not all(_storable(f.dataType) for f in df.schema):
        return cut(df)
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _storable(kind: T.DataType) -> bool:
    """Whether a table file can hold the type."""
    if isinstance(kind, T.StructType):
        return len(kind) > 0 and all(_storable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def spread(df: DataFrame, keep: bool = False) -> DataFrame:
    """*df* with its rows dealt over tasks if a few partitions hold most of them.

    A small file with many rows, or one of a single row group, is read by one task, and costly work on
    its rows would stay there.  Rows whose largest partition is within twice its fair share stay where they
    are, as do those of many files.  With *keep* the dealt rows are written, for a caller that reads them more than once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 2 * cores:
        return df
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n, most = row["n"] or 0, row["most"] or 0
    if most <= SPREAD_ROWS or most * cores <= 2 * n:
        return df
    dealt = df.repartition(max(2 * cores, -(-n // (16 * SPREAD_ROWS))))
    return stage(dealt) if keep else dealt


def measure(df: DataFrame, *columns: str) -> tuple[int, int]:
    """(rows, bytes) of *df*, counting the given string columns plus a row overhead."""
    size: Column = F.lit(48)
    for name in columns:
        size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def small(df: DataFrame, n_bytes: int, bound: int) -> DataFrame:
    """Mark *df* for broadcast if its measured size is within *bound*."""
    return F.broadcast(df) if n_bytes <= bound else df


HOT_SHARE = 1000


def join_on_value(rows: DataFrame, lookup: DataFrame, lookup_bytes: int, bound: int) -> DataFrame:
    """Inner join on ``value`` of many rows with a *lookup* of unique values.

    A small lookup is broadcast.  Otherwise values that make up at least a thousandth of
    the rows, of which there can be a thousand at most, meet their lookup rows in a
    broadcast join and only the others are shuffled, so no partition fills up with one
    value.
    """
    if lookup_bytes <= bound:
        return rows.join(F.broadcast(lookup), "value")
    counts = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = counts.filter(F.col("rows") * HOT_SHARE >= max(total, 1)).select("value")
    known = lookup.join(F.broadcast(hot), "value", "left_semi")
    common = rows.join(F.broadcast(known), "value")
    rest = rows.join(F.broadcast(hot), "value", "left_anti").join(lookup, "value")
    return common.unionByName(rest)
