"""Result tables in the shape that each view needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import bilingual, decode, field_position, href, join_list, map_encodings, map_point, node_size, ordinal_label
from notegrid.sources.tables import CONFIDENCE_LABELS, EVIDENCE_LABELS, STATUS_LABELS

FIXED_PATHS = ("/", "/atlas", "/methodology")


def english(labels: dict[str, tuple[str, str]]) -> dict[str, str]:
    return {k: v[0] for k, v in labels.items()}


def page_paths(df: DataFrame, slug: str = "slug", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, path): the fixed pages, then one for each row in table order."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(i, p) for i, p in enumerate(FIXED_PATHS)], "ordinal long, path string")
    return fixed.unionByName(df.select((F.col(ordinal) + len(FIXED_PATHS)).cast("long").alias("ordinal"), href(F.col(slug)).alias("path")))


def index_table(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Descriptors with position, from sorting: number, names, category, status, evidence and confidence, and path."""
    names = F.broadcast(categories.select(F.col("id").alias("categoryId"), F.col("labels.en").alias("category")))
    return df.join(names, "categoryId", "left").select(
        "position", ordinal_label(F.col("position")).alias("no"), F.col("labels.zhHans").alias("zh"), F.col("labels.en").alias("en"), "category",
        decode(english(STATUS_LABELS), F.col("descriptorStatus")).alias("status"),
        F.concat(decode(english(EVIDENCE_LABELS), F.col("evidenceStatus")), F.lit(" / "), decode(english(CONFIDENCE_LABELS), F.col("confidence"))).alias("evidence"), href(F.col("slug")).alias("path"),
    )


def typical(dim: str) -> Column:
    return F.col(f"sensoryAssociation.{dim}.typical")


def map_table(df: DataFrame) -> DataFrame:
    """One row for each node of the map, with its encodings and text places."""
    p = df.select("*", map_point(typical("sweetness"), typical("sourness"), typical("aromaProminence")).alias("p"))
    return p.select(
        "position", "slug", ordinal_label(F.col("position")).alias("no"), "p.x", "p.y", "p.radius", map_encodings(F.col("p.radius"), F.col("confidence")).alias("marks"),
        (F.col("p.y") + 0.8).alias("number_y"), (F.col("p.x") + 2.6).alias("text_x"), (F.col("p.y") - 2.6).alias("text_y"), F.upper("labels.en").alias("label"),
    )


def field_table(df: DataFrame, total: int | Column) -> DataFrame:
    """One row for each node of the field."""
    from notegrid.functions import char_seed

    n = F.lit(total) if isinstance(total, int) else total
    at = field_position(char_seed(F.col("id")), F.col("position"), n, typical("sweetness"), typical("sourness"), F.col("categoryId"))
    return df.select("position", "slug", at.alias("at"), node_size(typical("aromaProminence")).alias("size"), bilingual(F.col("labels.zhHans"), F.col("labels.en")).alias("label"))


def source_matrix(sources: DataFrame) -> DataFrame:
    return sources.select("ordinal", "name", "sourceType", "reusePolicy", "licenseStatus", "notes")


def text_list(df: DataFrame) -> DataFrame:
    return df.select("position", bilingual(F.col("labels.zhHans"), F.col("labels.en")).alias("text"), join_list(F.col("aliases.en")).alias("aliases"), join_list(F.col("aliases.zhHans"), "zhHans").alias("aliases_zh"))


def url_write_back(parameters: Column, updates: dict[str, str | None]) -> Column:
    """A map of query parameters with keys set to their new values, or without those whose new value is empty."""
    kept = F.map_filter(parameters, lambda k, _: ~k.isin(*updates)) if updates else parameters
    new = [F.lit(x) for k, v in updates.items() if v for x in (k, v)]
    return F.map_concat(kept, F.create_map(*new)) if new else kept


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
