"""The workflow kept up to date from streams.

Results go to delta folders, one per micro-batch and named after its id. A batch that is run again after a failure
overwrites its own folder, so replays change nothing. The current state is the base plus, per key, the latest delta;
publishing a compacted base (sources.sinks.publish) keeps the number of deltas small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.operators.merge import latest_per_key, merge


def read_table_stream(spark, folder: str, file_glob: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(df: DataFrame, root: str, sink: Callable[[DataFrame, int], None], mode: str = "append"):
    """Process everything that is there, then stop. A failed batch raises."""
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint")
        .foreachBatch(sink).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def delta_sink(root: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def read_deltas(spark, root: str, before: int | None = None) -> DataFrame | None:
    """All deltas with their batch number, optionally only those before a batch; None if there are none."""
    if before == 0:
        return None
    try:
        df = spark.read.parquet(root).withColumn("batch", F.col("batch").cast("bigint"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a damaged or closed folder is not an empty one
            raise
        return None
    return df if before is None else df.where(F.col("batch") < before)


# --------------------------------------------------------------------------------------------- counts and latest values

def count_stream(stream: DataFrame, *columns: str) -> DataFrame:
    return stream.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def newest_delta(spark, root: str) -> DataFrame:
    """The last complete-mode result, which replaces all earlier ones."""
    deltas = read_deltas(spark, root)
    newest = deltas.agg(F.max("batch").alias("b")).scalar()
    return deltas.where(F.col("batch") == newest).drop("batch")


def latest_stream(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value with the greatest order per key, as an updating aggregate."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("events"))


def latest_of_deltas(spark, root: str, key: list[str]) -> DataFrame:
    deltas = read_deltas(spark, root)
    return latest_per_key(deltas, key, ["batch"]).drop("batch")


# --------------------------------------------------------------------------------------------- idempotent upsert

def upsert_sink(root: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keep the last row per key of each micro-batch as its delta."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def upserted(base: DataFrame, root: str, keys: list[str], update: list[str] | None = None) -> DataFrame:
    deltas = read_deltas(base.sparkSession, root)
    if deltas is None:
        return base
    return merge(base, deltas, keys, update=update, order=["batch"]).select(*base.columns)
