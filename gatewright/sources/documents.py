"""JSON request documents in, JSON rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import _col, strip
from gatewright.model import BODY_LIMIT_BYTES


def read_bodies(df: DataFrame, body: str, schema: str, max_bytes: int = BODY_LIMIT_BYTES) -> DataFrame:
    """Parse one JSON object per row into `payload`; `body_error` says why a body was refused.

    An empty body counts as an empty object. Nothing is dropped: refused bodies stay with a NULL payload.
    """
    raw = F.coalesce(_col(body), F.lit(""))
    size = F.octet_length(raw)
    text = F.when(raw == "", F.lit("{}")).otherwise(raw)
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    error = (
        F.when(size > max_bytes, F.lit("request body is too large"))
        .when(parsed.isNull(), F.lit("body is not valid JSON"))
        .when(~kind.startswith("OBJECT"), F.lit("JSON body must be an object"))
    )
    return df.withColumn("body_error", error).withColumn(
        "payload", F.when(F.col("body_error").isNull(), F.from_json(text, schema))
    )


def to_json_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Each row as one JSON text, NULL fields kept."""
    return df.select(*key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def field(body, name: str) -> Column:
    """One field of a JSON text as text."""
    return F.get_json_object(_col(body), f"$.{name}")
