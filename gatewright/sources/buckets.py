"""Versions of a table that is dealt into hash buckets of its key: which folder holds which bucket, and since which version.

    root/base/version=<v>/_bucket=<b>   rows of the buckets that version v rewrote
    root/manifest/version=<v>           one row; a version counts once this is complete, and it is written last
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFEST = "version bigint, upto bigint, buckets int, held map<int, bigint>"


@dataclass(frozen=True)
class Manifest:
    """What one version consists of; version -1 is the empty state before the first one. upto: the last batch of a stream within it."""

    buckets: int
    version: int = -1
    upto: int = -1
    held: dict[int, int] = field(default_factory=dict)

    def folders(self, root: str, wanted: set[int] | None = None) -> list[str]:
        return [f"{root}/base/version={v}/_bucket={b}" for b, v in sorted(self.held.items()) if wanted is None or b in wanted]


def numbers(spark: SparkSession, folder: str, prefix: str, complete: bool = True) -> list[int]:
    """The numbers of the subfolders `<prefix><number>`, in order; by default only of those whose writing job ended."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    names = [n for n in names if n.startswith(prefix)]
    if complete:
        names = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(prefix)) for n in names)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    row = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}").first()
    return Manifest(row.buckets, row.version, row.upto, dict(row.held))


def newest(spark: SparkSession, root: str, buckets: int) -> Manifest:
    versions = numbers(spark, f"{root}/manifest", "version=")
    return read_manifest(spark, root, versions[-1]) if versions else Manifest(buckets)


def remove_old_versions(spark: SparkSession, root: str, keep: int) -> list[Manifest]:
    """Deletes manifests and base folders that none of the newest `keep` versions names; returns the manifests of these."""
    versions = numbers(spark, f"{root}/manifest", "version=")
    kept = [read_manifest(spark, root, v) for v in versions[-max(1, keep):]]
    if not kept:
        return []
    for v in versions[: -len(kept)]:
        remove(spark, f"{root}/manifest/version={v}")
    named = {(v, b) for m in kept for b, v in m.held.items()}
    for v in [v for v in numbers(spark, f"{root}/base", "version=", complete=False) if v <= kept[-1].version]:
        for b in numbers(spark, f"{root}/base/version={v}", "_bucket=", complete=False):
            if (v, b) not in named:
                remove(spark, f"{root}/base/version={v}/_bucket={b}")
    return kept
