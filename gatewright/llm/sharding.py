"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records uniformly into buckets of bounded bytes, by a seeded hash; Spark's shuffle files are the external
storage. Pass 2 draws a Fisher-Yates permutation of each bucket, seeded by the bucket, and writes the records. The buckets one
after another are a uniform permutation of all records; cutting it into equal runs gives shards whose counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.common import set_aside, stored

#: Buckets up to this number are offset by a broadcast of one small row each; beyond it by a shuffled join.
BROADCAST_BUCKETS = 100_000


def _fisher_yates(seed: int):
    def shuffle(key, bucket):
        bucket = bucket.take(pc.sort_indices(bucket["_row"]))  # arrival order is not stable, the row's number is
        order = np.random.default_rng([seed, key[0].as_py()]).permutation(bucket.num_rows)
        return bucket.take(pa.array(order)).append_column("_at", pa.array(np.arange(bucket.num_rows, dtype="int64")))

    return shuffle


def shuffle_into_shards(records: DataFrame, n_shards: int, seed: int, text: str = "text", bucket_bytes: int = 24 << 20) -> DataFrame:
    """All records and columns, with `shard` (from 0) and `slot` (gapless from 0 in its shard), in a uniformly random order.

    A record is scattered by its own row number in the input, not by a key: equal rows, null keys and hot keys spread like all
    others. Equal seeds give equal shards for the same files and split settings. Input columns named shard or slot come back
    as shard_input, slot_input. Empty input gives no rows; with fewer records than shards the last shards are empty.
    """
    records = set_aside(records, ["shard", "slot", "_row", "_bucket", "_at"])
    total = records.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    row = records.withColumn("_row", F.monotonically_increasing_id())
    scattered = row.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(buckets)))
    schema = T.StructType([*scattered.schema.fields, T.StructField("_at", T.LongType())])
    # buckets are bounded in bytes by their number; the hash deals them out evenly
    written = stored(scattered.groupBy("_bucket").applyInArrow(_fisher_yates(seed), schema), "shards")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("_bucket").count()
    starts = sizes.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    n = written.count()
    least, more = divmod(n, n_shards)
    place, wide = F.col("_start") + F.col("_at"), more * (least + 1)
    first = F.floor(place / (least + 1))
    rest = F.floor((place - wide) / max(least, 1)) + more
    shard = F.when(place < wide, first).otherwise(rest)
    begin = F.when(F.col("shard") < more, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - more) * least)
    placed = written.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, "_bucket")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (place - begin).cast("long")).drop("_row", "_bucket", "_at", "_start")
