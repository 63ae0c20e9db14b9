"""Token search, column filters and parent/child matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.dates import days_label
from gatewright.functions.text import contains_all, search_blob, search_tokens
from gatewright.operators.hot_keys import join_children


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose fields together contain every word of the query, ignoring case."""
    tokens = search_tokens(query)
    return df.where(contains_all(search_blob(*(columns or df.columns)), tokens)) if tokens else df


def token_hits(df: DataFrame, keys: list[str], blob: Column, tokens: list[str]) -> DataFrame:
    """Per key and token, whether any of its texts has the token.

    Words hold no blanks and texts are joined with blanks, so a word is in the joined text exactly if it is in
    one of the texts. The flags are combined before the shuffle and the joined text is never built.
    """
    texts = df.withColumn("_blob", blob)
    return texts.groupBy(*keys).agg(*[F.max(F.col("_blob").contains(w)).alias(f"_hit{i}") for i, w in enumerate(tokens)])


def search_parents(
    parents: DataFrame, children: DataFrame, key: str, query: str, parent_columns: list[str],
    child_columns: list[str],
) -> DataFrame:
    """Parents whose own fields and all their children's fields together contain every word."""
    tokens = search_tokens(query)
    if not tokens:
        return parents
    hits = token_hits(children, [key], search_blob(*child_columns), tokens)
    own = search_blob(*parent_columns)
    found = F.lit(True)
    for i, w in enumerate(tokens):
        found = found & (own.contains(w) | F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    return parents.join(hits, key, "left").where(found).select(*parents.columns)


def matching_or_all(children: DataFrame, parent_key: str, match: Column) -> DataFrame:
    """The matching children of each parent, or all of them where none matches; children without a parent have no place."""
    marked = children.withColumn("_match", F.coalesce(match, F.lit(False)))
    any_match = marked.groupBy(parent_key).agg(F.max("_match").alias("_any"))
    return join_children(any_match, marked, parent_key).where(F.col("_match") | ~F.col("_any")).select(*children.columns)


def in_stage(df: DataFrame, stage: str, stages: list[tuple], id_column: str, name_column: str) -> DataFrame:
    """Rows of one stage, by its id or by its name ignoring case; no stage given means all."""
    if not stage:
        return df
    name = {s[0]: s[1] for s in stages}.get(stage, "").lower()
    test = F.col(id_column) == stage
    if name:
        test = test | (F.lower(F.coalesce(F.col(name_column), F.lit(""))) == name)
    return df.where(test)


def column_filters(df: DataFrame, filters: dict[str, str], days_columns: tuple = ()) -> DataFrame:
    """Rows whose columns contain the given texts; a blank filter text is ignored."""
    for column, wanted in filters.items():
        wanted = (wanted or "").strip().lower()
        if not wanted:
            continue
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        if column in days_columns:
            value = F.concat_ws(" ", value, days_label(column))
        df = df.where(F.lower(value).contains(wanted))
    return df
