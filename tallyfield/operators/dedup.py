"""Repeated deliveries and repeated submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per_id(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of one row for each id (repeated deliveries are equal in all columns); rows without id stay."""
    picked = rows.select("id", *columns)
    return picked.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(picked.where("id IS NULL"))


def last_write(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row with the highest ``order`` for each combination of ``keys`` (nulls are a value of their own)."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, "_last.*")
    )


def anonymous_keys(rows: DataFrame, group: list[str], user: str = "user_id", order: str = "id") -> DataFrame:
    """Adds ``user_key``: the user's id, or -1, -2, ... for the nameless rows of a group in ``order``."""
    nameless = rows.where(F.col(user).isNull())
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return rows.where(F.col(user).isNotNull()).withColumn("user_key", F.col(user).cast("long")).unionByName(
        nameless.withColumn("user_key", -n.cast("long"))
    )
