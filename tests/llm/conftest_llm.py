"""Helpers that tests import by name."""

from pyspark.sql import DataFrame


def docs_of(spark, texts, start=0) -> DataFrame:
    rows = [(start + i, t, None, None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
