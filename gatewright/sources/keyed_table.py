"""A table stored in hash buckets of its key, whose merges and deletes rewrite only the buckets that hold touched keys.

A change reads the buckets its keys fall into and writes them anew under the next version; the files of all others stay as they are
and are named again by the new manifest. Readers see all of a version or the one before, and can open older ones. One writer at a
time; a change that fails, or whose executors are lost for good, leaves the table as it was and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatewright.operators.merge import insert_if_absent, latest_per_key, merge
from gatewright.session import cut_lineage
from gatewright.sources import buckets as b

ROWS_PER_BUCKET = 500_000


@dataclass(frozen=True)
class KeyedTable:
    """keys: the columns of the unique key. Rows with a NULL in it match nothing, and are dealt by all their columns.

    buckets: how many the first version gets (default: one for 500,000 rows of it); a task writes one bucket, later versions keep the number.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    schema: StructType | str
    buckets: int | None = None
    _columns: list[str] = field(init=False)

    def __post_init__(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        object.__setattr__(self, "schema", schema)
        object.__setattr__(self, "_columns", schema.names)
        if "_bucket" in schema.names:
            raise ValueError("a keyed table cannot have a column _bucket")

    def manifest(self, version: int | None = None) -> b.Manifest:
        if version is not None:
            return b.read_manifest(self.spark, self.root, version)
        return b.newest(self.spark, self.root, self.buckets or 0)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest or the given version; without any version there are none."""
        return self._rows(self.manifest(version))

    def create(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """The first version. order: as for upsert. A table that is there already is an error."""
        if self.manifest().version >= 0:
            raise ValueError(f"there is a table at {self.root}")
        rows = rows.select(*self._columns, *[c for c in order or [] if c not in self._columns])
        first = self._last_rows(rows, order).select(*self._columns)
        n = self.buckets or max(1, -(-first.count() // ROWS_PER_BUCKET))
        return self._publish(b.Manifest(n), set(), first)

    def upsert(self, source: DataFrame, *, update: list[str] | None = None, keep: list[str] | tuple = (), order: list[str] | None = None) -> int:
        """`merge` of the source into the table (see there for update, keep and order); returns the new version."""
        return self._change(self._last_rows(source, order), lambda stored, rows: merge(stored, rows, self.keys, update=update, keep=keep))

    def insert_if_absent(self, source: DataFrame, order: list[str]) -> int:
        """Adds the rows whose key is not there, the first by `order` of several."""
        return self._change(source, lambda stored, rows: insert_if_absent(stored, rows, [self.keys], order))

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows with the given keys."""
        return self._change(keys.select(*self.keys).dropna().distinct(), lambda stored, gone: stored.join(gone, self.keys, "left_anti"))

    def remove_superseded(self, keep: int = 2) -> None:
        """Deletes what none of the newest `keep` versions needs; readers of older versions have to begin again."""
        b.remove_old_versions(self.spark, self.root, keep)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that rows with these keys fall into; at most as many numbers as there are buckets reach the driver."""
        rows = self._typed(rows)
        return {r[0] for r in rows.select(self._bucket(self.manifest().buckets, rows)).distinct().collect()}

    def _last_rows(self, rows: DataFrame, order: list[str] | None) -> DataFrame:
        if not order:
            return rows
        return latest_per_key(rows.dropna(subset=self.keys), self.keys, order).unionByName(rows.where(self._null_key()))

    def _null_key(self) -> Column:
        return reduce(lambda x, y: x | y, [F.col(k).isNull() for k in self.keys])

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Columns of the table in its types, so that an int finds its bigint."""
        return rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self._columns if c in rows.columns])

    def _bucket(self, n: int, rows: DataFrame) -> Column:
        whole = [F.to_json(F.struct(c)) if c in rows.columns else F.lit("{}") for c in self._columns]
        return F.pmod(F.when(self._null_key(), F.xxhash64(*whole)).otherwise(F.xxhash64(*self.keys)), F.lit(n)).cast("int")

    def _rows(self, manifest: b.Manifest, wanted: set[int] | None = None) -> DataFrame:
        folders = manifest.folders(self.root, wanted)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _change(self, source: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        old = self.manifest()
        if old.version < 0:
            raise ValueError(f"there is no table at {self.root}")
        source = cut_lineage(self._typed(source))
        touched = self.touched(source)
        return self._publish(old, touched, change(self._rows(old, touched), source)) if touched else old.version

    def _publish(self, old: b.Manifest, touched: set[int], rows: DataFrame) -> int:
        version = old.version + 1
        base = f"{self.root}/base/version={version}"
        rows = self._typed(rows)
        dealt = rows.withColumn("_bucket", self._bucket(old.buckets, rows))
        dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(base)
        written = b.numbers(self.spark, base, "_bucket=", complete=False)
        if old.version >= 0 and not touched.issuperset(written):
            raise RuntimeError("a change reached rows of buckets it does not rewrite; nothing was published")
        held = {k: v for k, v in old.held.items() if k not in touched} | dict.fromkeys(written, version)
        row = self.spark.createDataFrame([(version, -1, old.buckets, held)], b.MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version
