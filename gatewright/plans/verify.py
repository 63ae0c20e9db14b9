"""Checks of a loaded data set: readiness, counts, quality, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import model
from gatewright.functions.text import blank
from gatewright.operators.rollup import count_by
from gatewright.operators.validate import reference_flag
from gatewright.sources.tables import missing_names, row_counts


def empty_collections(frames: dict[str, DataFrame]) -> DataFrame:
    return row_counts(frames).where("row_count = 0").select("table_name")


def orphan_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    return products.select("data_product_id", "title", "request_id").join(
        requests.select("request_id"), "request_id", "left_anti").select("data_product_id", "title")


def readiness(frames: dict[str, DataFrame], required: DataFrame) -> DataFrame:
    """(problem, table_name): required tables that are missing or empty. No rows means ready."""
    counts = row_counts(frames)
    missing = missing_names(counts, required).withColumn("problem", F.lit("missing"))
    empty = counts.join(required, "table_name", "left_semi").where("row_count = 0").select(
        "table_name", F.lit("empty").alias("problem"))
    return missing.unionByName(empty)


def quality_findings(
    products: DataFrame, stages: DataFrame, statuses: DataFrame, *, key: str, number: str, title: str
) -> DataFrame:
    """Products with a blank number or title or an unknown stage or status; as in SQL, a NULL reference passes."""
    df = products.select(key, number, title, "current_stage_id", "status_id")
    df = reference_flag(df, F.col("current_stage_id"), stages, "stage_id", "_stage_ok")
    df = reference_flag(df, F.col("status_id"), statuses, "status_id", "_status_ok")
    bad_stage = F.col("current_stage_id").isNotNull() & ~F.col("_stage_ok")
    bad_status = F.col("status_id").isNotNull() & ~F.col("_status_ok")
    return df.where(blank(number) | blank(title) | bad_stage | bad_status).select(key, number, title)


def acceptance(frames: dict[str, DataFrame], findings: DataFrame, imported: str) -> DataFrame:
    """(check_name, passed) of the cut-over rule after an import."""
    masters = {n: df for n, df in frames.items() if n.startswith("md_")}
    counts = row_counts({n: df for n, df in frames.items()})
    flags = counts.agg(
        (F.min(F.when(F.col("table_name").isin(list(masters)), F.col("row_count"))) > 0).alias("all master tables have rows"),
        (F.max(F.when(F.col("table_name") == "md_stages", F.col("row_count"))) == len(model.STAGES)).alias("eight stages"),
        (F.max(F.when(F.col("table_name") == "md_stage_requirements", F.col("row_count"))) >= len(model.RULES)).alias("workflow rules present"),
        (F.max(F.when(F.col("table_name") == imported, F.col("row_count"))) > 0).alias("imported rows present"),
    )
    found = findings.agg((F.count(F.lit(1)) == 0).alias("no quality findings"))
    names = [c for c in flags.columns]
    rows = flags.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("passed")) for n in names])))
    return rows.unionByName(found.select(F.lit("no quality findings").alias("check_name"), F.col("no quality findings").alias("passed")))


def stage_status_counts(products: DataFrame) -> DataFrame:
    return count_by(products, "current_stage_id", "status_id", out="products").orderBy("current_stage_id", "status_id")
