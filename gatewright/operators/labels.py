"""Master-data labels: one long (collection, id, name) relation and lookups into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import log_text, strip
from gatewright.operators.merge import union_all

# fixed values: collection -> (view, id column, name column), and the role of each user collection
COLLECTIONS = {
    "domains": ("domains", "domain_id", "domain_name"),
    "productTypes": ("product_types", "product_type_id", "product_type_name"),
    "expectedOutputs": ("expected_outputs", "expected_output_id", "expected_output_name"),
    "platforms": ("platforms", "platform_id", "platform_name"),
    "priorities": ("priorities", "priority_id", "priority_name"),
    "scopeOptions": ("scopes", "scope_id", "scope_name"),
    "subdomains": ("subdomains", "subdomain_id", "subdomain_name"),
    "sourceSystems": ("source_systems", "source_system_id", "source_system_name"),
    "buildStatuses": ("build_statuses", "build_status_id", "build_status_name"),
}
ROLE_COLLECTIONS = {
    "dataDomainOwners": "data_domain_owner",
    "domainDeliveryLeads": "domain_delivery_lead",
    "hubOwners": "hub_owner",
    "lynxPms": "lynx_pm",
}


def label_table(v) -> DataFrame:
    """(collection, id, name) of the nine reference collections and the four user roles.

    v: an object with the dimension frames as attributes (adapter views or a deployment's own tables).
    A user is a valid reference only under the collection of its role.
    """
    parts = [
        getattr(v, view).select(F.lit(c).alias("collection"), F.col(i).alias("id"), F.col(n).alias("name"))
        for c, (view, i, n) in COLLECTIONS.items()
    ]
    role_of = F.create_map(*[F.lit(x) for pair in ((r, c) for c, r in ROLE_COLLECTIONS.items()) for x in pair])
    users = v.users.select(role_of[F.col("role_key")].alias("collection"), F.col("user_id").alias("id"),
                           F.col("display_name").alias("name")).where("collection IS NOT NULL")
    return union_all([*parts, users])


def display_label_table(v) -> DataFrame:
    """As label_table, for showing values: a user id is shown by name in all four role collections."""
    fixed = label_table(v).where(~F.col("collection").isin(list(ROLE_COLLECTIONS)))
    users = v.users.select(
        F.explode(F.array(*[F.lit(c) for c in ROLE_COLLECTIONS])).alias("collection"),
        F.col("user_id").alias("id"), F.col("display_name").alias("name"))
    return fixed.unionByName(users)


def spread(key: Column, known: Column, df: DataFrame, by: list[str] | None = None) -> Column:
    """A join key for rows of which many have none: those get a key of their own that matches nothing, so they don't meet in one task.

    by: columns that tell rows well enough apart for that (all of them, if none is named or there).
    """
    plain = [c for c in by or [] if c in df.columns] or [c for c, kind in df.dtypes if "map" not in kind]
    return F.when(known & key.isNotNull(), key).otherwise(F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")))


def with_label(df: DataFrame, labels: DataFrame, collection: Column, value: Column, out: str, by: list[str] | None = None) -> DataFrame:
    """Add the name of a polymorphic reference, NULL where there is none. by: as for spread."""
    keyed = df.withColumns({"_collection": F.coalesce(collection, F.lit("")), "_id": spread(value, collection.isNotNull(), df, by)})
    named = labels.select(F.col("collection").alias("_collection"), F.col("id").alias("_id"), F.col("name").alias(out))
    return keyed.join(named, ["_collection", "_id"], "left").drop("_collection", "_id")


def log_value(input_type: Column, value: Column, label: Column) -> Column:
    """How an answer value is written in a change line."""
    v = strip(value)
    return (
        F.when(v == "", "empty")
        .when(input_type == "checkbox", F.when(v == "true", "checked").otherwise("unchecked"))
        .otherwise(log_text(F.coalesce(F.nullif(label, F.lit("")), v)))
    )
