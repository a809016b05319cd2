"""Lookups between the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import range_track
from notegrid.operators.related import related
from notegrid.sources.tables import DIMENSION_IDS


class NotFound(LookupError):
    """No row has the key that was asked for."""


def with_category(df: DataFrame, categories: DataFrame, key: str, category_key: str, columns: dict[str, str]) -> DataFrame:
    """df with columns of its category, a dimension of unique keys; a row whose category is missing fails the query."""
    names = F.broadcast(categories.select(F.col(category_key).alias("_key"), F.lit(True).alias("_there"), *[F.col(c).alias(n) for c, n in columns.items()]))
    joined = df.join(names, df[key] == F.col("_key"), "left")
    fail = F.raise_error(F.concat(F.lit("Missing category "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = {n: F.when(F.col("_there"), F.col(n)).otherwise(fail.cast(joined.schema[n].dataType)) for n in columns.values()}
    return joined.withColumns(checked).drop("_key", "_there")


def by_slug(df: DataFrame, slug: str, column: str = "slug") -> DataFrame:
    """The row of a slug; NotFound if there is none."""
    found = df.where(F.col(column) == slug)
    if not found.limit(1).count():
        raise NotFound(slug)
    return found


def keyed(df: DataFrame, key: str) -> DataFrame:
    """(key, row): every row under its key, for joins by key. Keys are unique, as validation asserts."""
    return df.select(F.col(key).alias("key"), F.struct(*df.columns).alias("row"))


def selected(requests: DataFrame, wanted: Column, df: DataFrame, key: str) -> DataFrame:
    """Rows of df that each request names, in the request's order: duplicates stay, unknown keys go. Adds pos."""
    asked = requests.select("*", F.posexplode(wanted).alias("pos", "_want"))
    return asked.join(df, F.col("_want") == F.col(key)).drop("_want")


def members(df: DataFrame, array: Column, registry: DataFrame, key: str) -> DataFrame:
    """Rows of the registry that each row of df lists, each once; order by the registry's ordinal."""
    listed = df.select("*", F.explode(F.array_distinct(array)).alias("_id"))
    return listed.join(registry, F.col("_id") == registry[key]).drop("_id")


def with_asset(df: DataFrame, assets: DataFrame) -> DataFrame:
    """df with its asset, if it has one, and the motion that applies."""
    own = assets.select(F.col("slug").alias("_slug"), F.struct(*assets.columns).alias("asset"))  # grows with the data: no broadcast by hint
    joined = df.join(own, df["slug"] == F.col("_slug"), "left").drop("_slug")
    return joined.withColumn("motion", F.coalesce(F.col("asset.motionFamily"), F.col("visualProfile.motion")))


def assets_with_descriptors(assets: DataFrame, df: DataFrame) -> DataFrame:
    return assets.join(df.select("slug", F.struct(*df.columns).alias("descriptor")), "slug")


def decoded_or_null(df: DataFrame, categories: DataFrame, key: str, category_key: str, label: str, name: str) -> DataFrame:
    """df with the label of a category key that may be null or unknown, null then."""
    names = F.broadcast(categories.select(F.col(category_key).alias("_key"), F.col(label).alias(name)))
    return df.join(names, df[key] == F.col("_key"), "left").drop("_key")


def specimens(df: DataFrame, asked: DataFrame, categories: DataFrame, sources: DataFrame, k: int = 4) -> DataFrame:
    """The pages of some descriptors of df, one row each: the record with its category, the names of its sources in registry
    order, its k related slugs, nearest first, its six range tracks in the order of dimensions, and its note, if any."""
    profile = F.array(*[F.col(f"sensoryAssociation.{d}.typical") for d in DIMENSION_IDS])
    near = related(df.withColumn("_profile", profile), asked.withColumn("_profile", profile), "ordinal", "_profile", "categoryId", k)
    near = near.join(df.select(F.col("ordinal").alias("key"), F.col("slug").alias("_near")), "key").groupBy(F.col("query").alias("ordinal"))
    near = near.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_near"))), lambda s: s["_near"]).alias("related"))  # k entries at most
    row = with_category(asked, categories, "categoryId", "id", {"shortLabel": "category"})
    names = members(row.select("slug", "sourceIds"), F.col("sourceIds"), sources.select(F.col("id").alias("source_id"), F.col("ordinal").alias("source_ord"), F.col("name")), "source_id")
    listed = names.groupBy("slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("source_ord", "name"))), lambda s: s["name"]).alias("sources"))
    tracks = [F.struct(F.lit(d).alias("dim"), range_track(*[F.col(f"sensoryAssociation.{d}.{p}") for p in ("min", "typical", "max")]).alias("track")) for d in DIMENSION_IDS]
    return row.withColumn("ranges", F.array(*tracks)).join(listed, "slug", "left").join(near, "ordinal", "left")


def specimen(df: DataFrame, slug: str, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """The page of one descriptor; NotFound if there is none of that slug."""
    return specimens(df, by_slug(df, slug), categories, sources)
