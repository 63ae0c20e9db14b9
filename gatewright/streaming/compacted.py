"""Upserts from a stream into a keyed state that is compacted, so that what a reader opens does not grow with the number of batches.

    root/delta/batch=<id>      last row per key of one micro-batch, overwritten when the batch is run again
    root/base/version=<v>/_bucket=<b>   rows of the buckets that compaction v rewrote; keys are dealt into buckets by hash
    root/manifest/version=<v>  one row: the last batch within the base, and of each bucket the version that holds it

Every `every` batches the deltas are merged into the buckets whose keys they touch; other buckets are not read or written. A version
counts once its manifest is complete, and that is written last, so readers see all of a version or the one before. A batch that the base
already holds changes nothing when it is run again. remove_superseded() deletes what the newest versions no longer name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.operators.merge import latest_per_key, merge
from gatewright.sources.buckets import MANIFEST as _MANIFEST
from gatewright.sources.buckets import Manifest, newest, remove_old_versions
from gatewright.sources.buckets import numbers as _numbers
from gatewright.sources.buckets import remove as _remove

def _deltas(spark: SparkSession, root: str, schema, manifest: Manifest) -> DataFrame | None:
    """Rows of the batches that the base does not hold yet, with their batch number."""
    ids = [i for i in _numbers(spark, f"{root}/delta", "batch=") if i > manifest.upto]
    if not ids:
        return None
    rows = spark.read.schema(schema).option("basePath", f"{root}/delta").parquet(*[f"{root}/delta/batch={i}" for i in ids])
    return rows.withColumnRenamed("batch", "_batch").withColumn("_batch", F.col("_batch").cast("bigint"))


def _base(spark: SparkSession, root: str, schema, manifest: Manifest, wanted: set[int] | None = None) -> DataFrame | None:
    """Rows of the base, or of the wanted buckets only; their batch number is below that of all deltas."""
    paths = manifest.folders(root, wanted)
    return spark.read.schema(schema).parquet(*paths).withColumn("_batch", F.lit(-1).cast("bigint")) if paths else None


def _together(base: DataFrame | None, deltas: DataFrame | None, keys: list[str]) -> DataFrame | None:
    if deltas is None:
        return base and base.drop("_batch")  # one row per key already
    rows = deltas if base is None else base.unionByName(deltas)
    return latest_per_key(rows, keys, ["_batch"]).drop("_batch")


def compact(spark: SparkSession, root: str, keys: list[str], schema, buckets: int) -> Manifest:
    """Merges the open deltas into the buckets they touch and publishes the new version; without open deltas nothing happens.

    What reaches the driver are bucket numbers, at most `buckets`.
    """
    old = newest(spark, root, buckets)
    deltas = _deltas(spark, root, schema, old)
    if deltas is None:
        return old
    upto = max(_numbers(spark, f"{root}/delta", "batch="))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(old.buckets)).cast("int")
    touched = {r[0] for r in deltas.select(bucket).distinct().collect()}
    version = old.version + 1
    if touched:
        rows = _together(_base(spark, root, schema, old, touched), deltas, keys).withColumn("_bucket", bucket)
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/base/version={version}")
    held = old.held | dict.fromkeys(touched, version)
    row = spark.createDataFrame([(version, upto, old.buckets, held)], _MANIFEST)
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return Manifest(old.buckets, version, upto, held)


def compacting_sink(root: str, keys: list[str], order: list[str], every: int = 16, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row per key, by `order`, of each batch as a delta; every `every` open deltas are compacted.

    buckets: a compaction task holds one bucket, so choose it by the size the state will have; it stays as the first version has it.
    Null keys are keys like others. Batches without rows leave an empty delta.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = newest(spark, root, buckets)
        if batch_id <= known.upto:
            return  # run again after a failure; the base holds it
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{root}/delta/batch={batch_id}")
        if len([i for i in _numbers(spark, f"{root}/delta", "batch=") if i > known.upto]) >= every:
            compact(spark, root, keys, batch.schema, buckets)

    return write


def current(spark: SparkSession, root: str, keys: list[str], schema, buckets: int = 64) -> DataFrame:
    """One row per key: the base of the newest version and the deltas after it."""
    manifest = newest(spark, root, buckets)
    rows = _together(_base(spark, root, schema, manifest), _deltas(spark, root, schema, manifest), keys)
    return spark.createDataFrame([], schema) if rows is None else rows


def upserted(base: DataFrame, root: str, keys: list[str], schema, update: list[str] | None = None) -> DataFrame:
    """A stored table with the current rows of the stream merged into it."""
    return merge(base, current(base.sparkSession, root, keys, schema), keys, update=update).select(*base.columns)


def remove_superseded(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes deltas, base folders and manifests that none of the newest `keep` versions names (at least one is kept).

    Readers that opened one of these versions are not disturbed; older readers have to begin again.
    """
    kept = remove_old_versions(spark, root, keep)
    if not kept:
        return
    for i in _numbers(spark, f"{root}/delta", "batch=", complete=False):
        if i <= kept[0].upto:
            _remove(spark, f"{root}/delta/batch={i}")
