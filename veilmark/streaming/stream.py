"""The text job on a stream: each micro-batch continues the stored registry.

The registry is stored by batch and by hash buckets of its values.  A batch first finds its own values
and then reads the buckets they fall into, so it does not grow with the registry; the highest
numbers per type, which is all that new tokens need, are kept in a table of a few rows per batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilmark.config import Settings
from veilmark.operators import events as E
from veilmark.operators import registry as REG
from veilmark.plans.jobs import pseudonymise_text


def registry_ddl(df: DataFrame, order_by: Sequence[str]) -> str:
    """Schema of the stored registry for the given order columns."""
    order = E.order_type(df, list(order_by)).simpleString()
    seq = f"struct<phase:int,src:bigint,ord:{order},col:int,rank:int,sub:int>"
    return (
        "value string, etype string, token string, kind string, n bigint, restorable boolean, "
        f"active boolean, batch int, seq {seq}, run bigint, bucket int"
    )


TOPS = "etype string, top bigint, batch int, run bigint"


def bucket_of(value: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def wanted_buckets(events: DataFrame, buckets: int) -> list[int]:
    """The buckets of all values that *events* may enter or refer to: at most *buckets* numbers."""
    whole = events.select(F.explode(F.array("value", "anchor")).alias("value")).filter("value IS NOT NULL")
    values = whole.unionByName(REG.name_parts(events).select("value"))
    return sorted(r["b"] for r in values.select(bucket_of("value", buckets).alias("b")).distinct().collect())


def pseudonymise_stream(
    stream: DataFrame,
    text_col: str,
    key: Sequence[str],
    registry_path: str,
    output_path: str,
    checkpoint_path: str,
    settings: Settings | None = None,
    *,
    order_by: Sequence[str] | None = None,
    trigger: dict | None = None,
    buckets: int = 256,
) -> StreamingQuery:
    """Start the stream.  Tokens stay stable over time.

    Output and registry rows go to a folder per batch (``run=<id>``), registry rows further to one per
    bucket; *buckets* must not change later.  A batch sees the registry of earlier batches only and
    overwrites its own folders, so repeating a batch after a failure gives the same tokens.
    """
    settings = settings or Settings()
    order = list(order_by or key)
    ddl = registry_ddl(stream, order)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = F.col("run") < batch_id

        def known(events: DataFrame) -> REG.Previous:
            stored = spark.read.schema(ddl).parquet(registry_path).filter(earlier)
            rows = stored.filter(F.col("bucket").isin(wanted_buckets(events, buckets))).drop("run", "bucket")
            tops = spark.read.schema(TOPS).parquet(f"{registry_path}-tops").filter(earlier)
            return REG.Previous(rows, tops.groupBy("etype").agg(F.max("top").alias("top")), batch_id - 1)

        result = pseudonymise_text(batch, text_col, key, settings, order_by=order, previous=known if batch_id > 0 else None)
        added = result.added.withColumn("bucket", bucket_of("value", buckets))
        # Rows of a bucket are written by one task, so a batch adds one file per bucket at most.
        added.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{registry_path}/run={batch_id}")
        tops = REG.tops(result.added).withColumn("batch", F.lit(batch_id))
        tops.coalesce(1).write.mode("overwrite").parquet(f"{registry_path}-tops/run={batch_id}")
        result.df.write.mode("overwrite").parquet(f"{output_path}/run={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
