"""Parquet tables with declared schemas, schema-tolerant reads and source profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class Tables:
    """Lazy access to the Parquet tables of one folder: `Tables(spark, path).orders`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")


def optional(df: DataFrame, *names: str) -> list[Column]:
    """Text columns by name; a name the source lacks reads as NULL. Decided when the plan is built."""
    have = set(df.columns)
    return [F.col(n).cast("string") if n in have else F.lit(None).cast("string") for n in names]


def with_missing_columns(df: DataFrame, names, type_name: str = "string") -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(type_name) for n in names if n not in df.columns})


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of many relations in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in frames.items()]
    return reduce(DataFrame.unionAll, parts)


def column_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal_position, data_type, row_count) of many relations."""
    parts = []
    for name, df in frames.items():
        described = F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal_position"),
                     F.lit(f.dataType.simpleString()).alias("data_type"))
            for i, f in enumerate(df.schema.fields)
        ])
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(described)))
    return reduce(DataFrame.unionAll, parts)


def missing_names(present: DataFrame, required: DataFrame, column: str = "table_name") -> DataFrame:
    """Names that are required but not present."""
    return required.select(column).join(present.select(column), column, "left_anti")
