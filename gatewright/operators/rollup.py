"""Portfolio counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dashboard_totals(products: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row: total, in_review, blocked, live and, if requests are given, initiatives."""
    totals = products.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status_id").isin("in_review", "in_progress")).alias("in_review"),
        F.count_if(F.col("status_id") == "blocked").alias("blocked"),
        F.count_if(F.col("current_stage_id").isin("publish", "operate")).alias("live"),
    )
    if requests is None:
        return totals
    initiatives = requests.agg(F.count(F.lit(1)).alias("initiatives")).scalar()
    return totals.withColumn("initiatives", initiatives)


def count_by(df: DataFrame, *columns: str, out: str = "count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def count_maps(products: DataFrame) -> DataFrame:
    """(measure, counts map) for stages and statuses, both counted in one pass over the products."""
    pairs = F.inline(F.array(
        F.struct(F.lit("stage").alias("measure"), F.col("current_stage_id").alias("key")),
        F.struct(F.lit("status").alias("measure"), F.col("status_id").alias("key")),
    ))
    counted = products.select(pairs).groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("measure").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("key", F.lit("")), "n")))).alias("counts"))


def stage_rail(products: DataFrame, stages: DataFrame) -> DataFrame:
    """Every stage with its product count and rounded share of all products."""
    counts = products.groupBy(F.col("current_stage_id").alias("stage_id")).agg(F.count(F.lit(1)).alias("n"))
    total = products.agg(F.count(F.lit(1)).alias("total")).scalar()
    n = F.coalesce("n", F.lit(0))
    return stages.join(counts, "stage_id", "left").withColumn("_total", total).select(
        "stage_id", "stage_name", "stage_number", n.alias("products"),
        F.when(F.col("_total") > 0, F.floor(n * 100.0 / F.col("_total") + 0.5)).otherwise(0).cast("bigint")
        .alias("percent"))


def child_counts(children: DataFrame, key: str, out: str = "children") -> DataFrame:
    return children.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def dashboard(products: DataFrame, requests: DataFrame) -> DataFrame:
    """(measure, key, value): totals, counts per stage and per status, and the number of initiatives.

    The products are scanned once and reduced to one row per (stage, status); everything else comes from those.
    """
    cells = products.groupBy("current_stage_id", "status_id").agg(F.count(F.lit(1)).alias("n"))
    n, none = F.col("n"), F.lit("")

    def entry(measure, key, value):
        return F.struct(F.lit(measure).alias("measure"), key.alias("key"), value.alias("value"))

    def only(condition):
        return F.when(condition, n).otherwise(0)

    parts = F.array(
        entry("total", none, n),
        entry("inReview", none, only(F.col("status_id").isin("in_review", "in_progress"))),
        entry("blocked", none, only(F.col("status_id") == "blocked")),
        entry("live", none, only(F.col("current_stage_id").isin("publish", "operate"))),
        entry("stage", F.coalesce("current_stage_id", none), n),
        entry("status", F.coalesce("status_id", none), n),
    )
    counted = cells.select(F.inline(parts)).groupBy("measure", "key").agg(F.sum("value").alias("value"))
    initiatives = requests.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("initiatives").alias("measure"), none.alias("key"), "value")
    return counted.unionByName(initiatives)
