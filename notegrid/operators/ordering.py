"""Orders. Every one ends with the ordinal, so it is total and equals a stable sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.sources.tables import with_ordinal


def category_rank(df: DataFrame, ranks: DataFrame, category: str, rank: str = "rank") -> DataFrame:
    """df with the rank of its category; 0 for an unknown one. ranks: (category, rank), a dimension."""
    return df.join(F.broadcast(ranks), category, "left").withColumn(rank, F.coalesce(F.col(rank), F.lit(0)))


def sort_by_category_then_name(df: DataFrame, ranks: DataFrame, category: str, name: str, ordinal: str) -> DataFrame:
    """df with rank and position, from 0, by category rank, name in the root collation, and ordinal.

    Rows are dealt out by ranges of that order, so a category of very many rows is no single task.
    """
    return with_ordinal(category_rank(df, ranks, category), "rank", F.collate(F.col(name), "UNICODE"), ordinal, name="position")


def first_k(df: DataFrame, k: int, ordinal: str = "ordinal") -> DataFrame:
    if k < 0:
        raise ValueError("k must not be negative")
    return df.orderBy(ordinal).limit(k)


def last_two(values: Column) -> Column:
    return F.slice(values, F.greatest(F.size(values) - 1, F.lit(1)), 2)


def ranked_differences(differences: Column, key: Callable[[Column], Column]) -> Column:
    """An array of structs by key, largest first; equal ones keep their order."""
    indexed = F.transform(differences, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    order = F.array_sort(indexed, lambda a, b: F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).otherwise(F.signum(a["i"] - b["i"]).cast("int")))
    return F.transform(order, lambda s: s["x"])
