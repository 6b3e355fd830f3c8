"""Upserts and deletes as rewrites of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.errors import QueryParsingError


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of its rows of the same keys; of several new rows of a key the largest counts."""
    others = [c for c in table.columns if c not in keys]
    new = rows.select(*table.columns).groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*[F.col(k) if k in keys else F.col(f"__row.{k}").alias(k) for k in table.columns]) if others else rows.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [table[k].eqNullSafe(new[k]) for k in keys])
    return table.join(new, same, "left_anti").unionByName(new)


def delete(table: DataFrame, condition: Column | None) -> DataFrame:
    """``table`` without the rows for which the condition is true; where it is null they stay."""
    if condition is None:
        raise QueryParsingError("a delete needs a filter")
    return table.where(~F.coalesce(condition, F.lit(False)))
