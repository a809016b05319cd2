"""Nodes and segments of the field, and the points of procedural marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import procedural_mark


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """df with the number of its rows, one row that is broadcast."""
    return df.join(F.broadcast(df.agg(F.count("*").alias(name))))


def segments(nodes: DataFrame, position: str = "position", total: str = "total") -> DataFrame:
    """Every node with the next one's place, the last with the first's: an equi-join on positions, no global window.

    nodes: position, x, y, and total, the number of nodes.
    """
    after = nodes.select(F.col(position).alias("_p"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return nodes.withColumn("_next", (F.col(position) + 1) % F.col(total)).join(after, F.col("_next") == F.col("_p")).drop("_p", "_next")


def procedural_points(df: DataFrame, seed: Column, points: int = 9) -> DataFrame:
    """points rows for each row: i, x, y, r, opacity of its mark."""
    spread = df.withColumn("_seed", seed).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return spread.withColumn("mark", procedural_mark(F.col("_seed"), F.col("i"), points)).select(*df.columns, "i", "mark.*")
