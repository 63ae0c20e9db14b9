"""Change capture: differences between stored and submitted answers, change lines, timeline events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import model
from gatewright.functions.text import strip
from gatewright.operators.labels import log_value, with_label

NO_CHANGES = "Submitted with no field changes."


def first_changes(
    changes: DataFrame, keys: list[str], order: list[str], text: str, out: str,
    listed: int = model.LOG_CHANGES_LISTED,
) -> DataFrame:
    """Per key the first `listed` texts in order, joined by '; ', and how many more there are.

    The rank filter lets Spark keep only the first few rows per key on the map side, and the total is a partial
    count, so a key with very many changes is reduced before it is shuffled.
    """
    from pyspark.sql import Window

    totals = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*order, text)
    head = changes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= listed)
    lines = head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rn", text))).alias("_rows"))
    joined = F.array_join(F.transform("_rows", lambda r: r[text]), "; ")
    more = F.when(F.col("_n") > listed, F.concat(F.lit("; "), (F.col("_n") - listed).cast("string"),
                                                 F.lit(" more field(s) changed"))).otherwise("")
    return lines.join(totals, keys).select(*keys, F.concat(joined, more).alias(out))


def diff_answers(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Answers whose stripped text differs; old and new have `answer_value`. Missing old answers count as ''."""
    before = old.select(*keys, F.col("answer_value").alias("old"))
    joined = new.join(before, keys, "left")
    return joined.where(strip("old") != strip("answer_value")).withColumns(
        {"old": strip("old"), "new": strip("answer_value")}).drop("answer_value")


def shown_label(key: Column, label: Column) -> Column:
    return F.when(key == model.HUB_OWNER_KEY, F.lit("Hub Owner")).otherwise(label)


def shown_master_type(key: Column, master_type: Column) -> Column:
    return F.when(key == model.HUB_OWNER_KEY, F.lit("hubOwners")).otherwise(master_type)


def change_lines(changes: DataFrame, display_labels: DataFrame, out: str = "line") -> DataFrame:
    """'label: old -> new' per change; ids are shown by name, long texts are shortened."""
    key, kind = F.col("requirement_key"), F.col("input_type")
    collection = shown_master_type(key, F.col("master_data_type"))
    df = with_label(changes, display_labels, collection, F.col("old"), "_old_name", ["submission_id"])
    df = with_label(df, display_labels, collection, F.col("new"), "_new_name", ["submission_id"])
    line = F.concat(
        shown_label(key, F.col("label")), F.lit(": "), log_value(kind, F.col("old"), F.col("_old_name")),
        F.lit(" -> "), log_value(kind, F.col("new"), F.col("_new_name")))
    return df.withColumn(out, line).drop("_old_name", "_new_name")


def describe_changes(
    units: DataFrame, changes: DataFrame, keys: list[str], order: list[str], line: str = "line"
) -> DataFrame:
    """One text per unit (submission); units without changes get the fixed text."""
    described = first_changes(changes, keys, order, line, "event_detail")
    return units.join(described, keys, "left").withColumn(
        "event_detail", F.coalesce("event_detail", F.lit(NO_CHANGES)))


def timeline_event(columns: dict[str, Column], created_at: Column, sequence: Column) -> Column:
    """One entry of the event log in its fixed layout, with an id that is the same on every run."""
    filled = {c: columns.get(c, F.lit(None)).cast("string") for c in model.TIMELINE_COLUMNS if c != "timeline_id"}
    filled["created_by"] = F.coalesce(filled["created_by"], F.lit("system"))
    filled["event_detail"] = F.coalesce(filled["event_detail"], F.lit(""))
    filled["created_at"] = created_at.cast("string")
    identity = F.md5(F.concat_ws("|", F.coalesce(filled["data_product_id"], filled["request_id"]),
                                 filled["event_type"], filled["created_at"], sequence.cast("string")))
    return F.struct(identity.alias("timeline_id"), *[filled[c].alias(c) for c in model.TIMELINE_COLUMNS[1:]])


def timeline_events(df: DataFrame, columns: dict[str, Column], created_at: Column, sequence: Column) -> DataFrame:
    """One entry of the event log per row."""
    return df.select(timeline_event(columns, created_at, sequence).alias("_event")).select("_event.*")
