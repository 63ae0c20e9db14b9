"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gatewright")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a scratch folder only for a local master."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="gatewright-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably, so that later stages neither recompute nor depend on a lost executor.

    The rows are written once, by columns, to the checkpoint folder. A checkpoint would work out its last stage twice and keep rows
    uncompressed; it is left for what Parquet has no layout for.
    """
    folder, spark = checkpoint_dir(df.sparkSession), df.sparkSession
    if not _storable(df):
        return df.checkpoint()
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _storable(df: DataFrame) -> bool:
    names = [c.lower() for c in df.columns]
    kinds = " ".join(kind for _, kind in df.dtypes)
    return bool(names) and len(set(names)) == len(names) and not any(x in kinds for x in ("void", "interval", "variant", "struct<>"))
