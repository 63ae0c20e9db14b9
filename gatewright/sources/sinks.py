"""Writes: append, and publish of a fully built new state."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a new state next to the old one and return its path.

    A merge reads the old state while the new one is written, so the target is never overwritten in place;
    readers switch to the returned path when the job has succeeded. Writing the same version again fails.
    """
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
