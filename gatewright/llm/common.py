"""What the operators share: tables in the shared folder, column names, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: later jobs read it and never recompute what lies before."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names_aside(columns: list[str], names: Iterable[str]) -> list[str]:
    """The columns, those that clash with an operator's own output columns as `<name>_input` (again until free)."""
    own = {n.lower() for n in names}
    out, used = [], {c.lower() for c in columns} | own
    for c in columns:
        new = c
        if c.lower() in own:
            while new.lower() in used:
                new += "_input"
            used.add(new.lower())
        out.append(new)
    return out


def set_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Renames the columns that an operator's own output columns would clash with."""
    return df.toDF(*names_aside(df.columns, names))


def put_back(df: DataFrame, columns: list[str], names: Iterable[str]) -> DataFrame:
    """The given columns of what an operator returned, under the names that they had before it set some of them aside."""
    return df.select(*[F.col(f"`{new}`").alias(c) for c, new in zip(columns, names_aside(columns, names))])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand at most so many rows at a time to Python: texts may be long, and a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches cut to a few rows each, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: str):
    """The bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
