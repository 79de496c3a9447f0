"""Metadata tables: append-only versions of records, of which the latest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import col, cols, fresh


def latest(records: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last version of each record, unless it is deleted."""
    (n,) = fresh(records, "n")
    newest = records.withColumn(n, F.row_number().over(Window.partitionBy(col(key)).orderBy(col(version).desc()))).filter(F.col(n) == 1).drop(n)
    return newest.filter("not coalesce(deleted, false)") if "deleted" in newest.columns else newest


def page(df: DataFrame, *, owner: tuple[str, object] | None = None, order_by: str, descending: bool = False, skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of an owner's records, nulls last, ties by all orderable columns named."""
    rows = df.filter(col(owner[0]) == F.lit(owner[1])) if owner else df
    order = col(order_by).desc_nulls_last() if descending else col(order_by).asc_nulls_last()
    others = [c for c in df.columns if c != order_by][:1]
    return rows.orderBy(order, *cols(others)).offset(skip).limit(limit)


def counts(df: DataFrame, owner: str) -> DataFrame:
    return df.groupBy(col(owner)).agg(F.count("*").alias("records"))


def lookup(df: DataFrame, key: str, value, owner: tuple[str, object]) -> DataFrame:
    return df.filter((col(key) == F.lit(value)) & (col(owner[0]) == F.lit(owner[1])))
