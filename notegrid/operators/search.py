"""Search and predicates over descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import normalize_term, search_text


def descriptor_text() -> Column:
    """The search text of a descriptor row."""
    return search_text(F.col("labels.en"), F.col("labels.zhHans"), F.col("aliases.en"), F.col("aliases.zhHans"), F.col("slug"), F.col("id"))


def matches(text: Column, query: str) -> Column:
    """Whether the normalised query is a literal part of a normalised text; a query that normalises to nothing is part of all."""
    return F.contains(text, normalize_term(F.lit(query)))


def filter_descriptors(df: DataFrame, text: Column, query: str = "", category: str = "", category_column: str = "categoryId") -> DataFrame:
    """Rows of the category, if one is given, whose normalised text matches. The category comes first: it reaches the scan."""
    if category:
        df = df.where(F.col(category_column) == category)
    return df.where(matches(text, query)) if query else df


def not_self(a: Column, b: Column) -> Column:
    return a != b


def not_canonical(status: Column) -> Column:
    return status != "canonical"


def similar(difference: Column, most: float = 0.45) -> Column:
    return difference <= most
