"""Tables stored in buckets of a key, so that joins on it read what belongs together and move nothing.

Both tables of a reference are cut by the same hash of the same columns into as many buckets. A key that very many rows refer to
would be one bucket: its rows get one of several salts, and the row that they refer to is stored once for each salt, so buckets
stay even and the join is still one of equal columns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.sources.tables import new_path

#: Rows of a bucket on average, rows of one key with the same salt, the part of all rows that these may be, keys that may have salts at most.
BUCKET_ROWS, SALT_ROWS, SALT_PART, SALTED_KEYS = 1_000_000, 250_000, 64, 10_000
KEY, SALT = "_key", "_salt"


@dataclass(frozen=True)
class Stored:
    """Names of a table of references and of the table that they refer to, and their buckets."""

    child: str
    parent: str
    buckets: int


def _write(df: DataFrame, buckets: int) -> str:
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, KEY, SALT)  # by the hash of the buckets: a task writes one file
    dealt.write.bucketBy(buckets, KEY, SALT).sortBy(KEY, SALT).option("path", new_path(df.sparkSession)).format("parquet").saveAsTable(name)
    return name


def store(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, *spread: str) -> Stored:
    """Store the two tables by their keys, which are compared as text.

    spread: columns of child that tell rows of one key apart. Names of columns may be the same in both tables, but none may be
    one of KEY and SALT. Null keys are stored and refer to nothing; keys that repeat in parent stay, each with its rows.
    """
    rows = child.withColumn(KEY, F.col(child_key).cast("string"))
    counts = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("_n"))
    total = child.count()
    most = max(min(SALT_ROWS, -(-total // SALT_PART)), -(-total // SALTED_KEYS), 1)
    # at most SALTED_KEYS keys have as many rows
    hot = F.broadcast(counts.where(F.col("_n") > most).select(KEY, F.ceil(F.col("_n") / most).cast("long").alias("_salts")))
    buckets = max(8, -(-max(total, parent.count()) // BUCKET_ROWS))
    number = F.pmod(F.xxhash64(*spread), F.when(F.col(KEY).isNull(), F.lit(buckets)).otherwise(F.coalesce("_salts", F.lit(1))).cast("long"))
    salted = rows.join(hot, KEY, "left").withColumn(SALT, number).drop("_salts")
    copies = parent.withColumn(KEY, F.col(parent_key).cast("string")).join(hot, KEY, "left")
    copies = copies.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts")
    return Stored(_write(salted, buckets), _write(copies, buckets), buckets)


def tables(spark: SparkSession, names: Stored) -> tuple[DataFrame, DataFrame]:
    """The two tables with KEY and SALT, to be joined on both. A merge join is asked for: nothing is broadcast, however small."""
    return spark.table(names.child), spark.table(names.parent).hint("merge")


def looked_up(spark: SparkSession, names: Stored, columns: dict[str, str], how: str = "left") -> DataFrame:
    """The rows of child with columns of the row that they refer to, under new names."""
    child, parent = tables(spark, names)
    own = parent.select(KEY, SALT, *[F.col(c).alias(n) for c, n in columns.items()])
    return child.join(own, [KEY, SALT], how).drop(KEY, SALT)


def dangling(spark: SparkSession, names: Stored) -> DataFrame:
    """The rows of child whose key is that of no row of parent; null keys are among them."""
    child, parent = tables(spark, names)
    return child.join(parent.select(KEY, SALT), [KEY, SALT], "left_anti").drop(KEY, SALT)


def discard(spark: SparkSession, names: Stored) -> None:
    """Forget the two tables; their files stay, as those of a checkpoint do."""
    for name in (names.child, names.parent):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
