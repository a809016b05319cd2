"""Schemas of the catalogue's tables and their readers. Order is data: every table has an ordinal from its file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.functions import query_parameter

PAIR = "struct<en:string,zhHans:string>"
RANGE = "struct<min:double,typical:double,max:double>"

#: The six dimensions in their order, with labels and short labels in English and Chinese.
DIMENSIONS = (
    ("sourness", "Sourness association", "酸感关联", "Sour", "酸"),
    ("sweetness", "Sweetness association", "甜感关联", "Sweet", "甜"),
    ("bitterness", "Bitterness association", "苦感关联", "Bitter", "苦"),
    ("aromaProminence", "Aroma prominence", "香气显著度", "Aroma", "香"),
    ("body", "Body association", "厚度关联", "Body", "体"),
    ("roastFermentation", "Roast and fermentation association", "烘烤/发酵关联", "Roast/Ferment", "烘/酵"),
)
DIMENSION_IDS = tuple(d[0] for d in DIMENSIONS)
#: Labels of modalities, statuses, confidences and kinds of evidence.
MODALITY_LABELS = {"orthonasal": ("Orthonasal aroma", "鼻前香气"), "retronasal": ("Retronasal aroma", "鼻后香气"), "taste": ("Taste", "味觉"), "mouthfeel": ("Mouthfeel", "口感")}
STATUS_LABELS = {"canonical": ("Canonical pilot", "核心试验词"), "boundary": ("Boundary", "边界词"), "compound": ("Compound", "复合词"), "unresolved": ("Unresolved", "待验证")}
CONFIDENCE_LABELS = {"low": ("Low", "低"), "medium": ("Medium", "中"), "high": ("High", "高")}
EVIDENCE_LABELS = {
    "reference_supported": ("Reference-supported", "参考框架支持"), "open_data_supported": ("Open-data-supported", "开放数据支持"),
    "project_curated_draft": ("Project-curated draft", "项目整理草案"), "unresolved": ("Unresolved", "待验证"),
}

DESCRIPTOR = (
    f"id string, slug string, labels {PAIR}, aliases struct<en:array<string>,zhHans:array<string>>, categoryId string, descriptorStatus string, sensoryModalities array<string>, summary {PAIR}, "
    f"sensoryAssociation struct<{','.join(f'{d}:{RANGE}' for d in DIMENSION_IDS)}>, confidence string, evidenceStatus string, sourceIds array<string>, "
    f"visualProfile struct<motif:string,density:double,curvature:double,halo:double,motion:string>, editorialNote {PAIR}"
)
CATEGORY = f"id string, slug string, labels {PAIR}, shortLabel {PAIR}, description {PAIR}, colorToken string"
SOURCE = "id string, name string, sourceType string, licenseStatus string, reusePolicy string, attributionRequired boolean, notes string, url string"
ASSET = (
    "slug string, library string, originalIconName string, author string, originalUrl string, localPath string, license string, attributionRequired boolean, modifications string, motionFamily string, "
    "evaluation struct<recognizability:string,styleFit:string,animationFit:string,monochromeFit:string>"
)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType([T.StructField("ordinal", T.LongType()), *T.StructType.fromDDL(ddl).fields])


def raw_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they are, with the declared columns only; ill-typed values become null, for validation to report."""
    return spark.read.schema(schema_of(schema)).option("mode", "PERMISSIVE").json(path)


def marked_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """raw_table with what a reader knows of each line: ``file`` and ``block``, the offset of the split in it, and ``line``, the
    text of a line that is no JSON object; its declared columns are null then. A line whose values are of another type is JSON:
    they are null (but a text takes the JSON of any value), and its ``line`` is too. An empty line is no row, and what follows
    an object on its line is not read."""
    kept = "_line"
    rows = spark.read.schema(schema_of(schema).add(kept, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", kept).json(path)
    json = F.try_parse_json(kept)
    # the reader keeps lines with ill-typed values too; the ordinal keeps a column beside the line's in every plan
    broken = F.col("ordinal").isNull() & F.col(kept).isNotNull() & (json.isNull() | ~F.schema_of_variant(json).startswith("OBJECT"))
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.when(broken, F.col(kept)).alias("line")).drop(kept)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with the declared columns only."""
    return spark.read.schema(schema_of(schema)).parquet(path)


_own_dir: dict[str, str] = {}


def new_path(spark: SparkSession) -> str:
    """A path for a new table in the folder that spark.checkpoint.dir names. Only a local session may name none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{place.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Number rows from 0 by a unique order, without a single-task sort: rows are dealt out by ranges and sorted there; a row's
    number is its number within its range and the sizes of the ranges before, one small row each."""
    keys = {f"_o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    # an id is the task's number and, in its lower 33 bits, the row's number within the task
    placed = stored(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_id", "_part", "_row", "_before")


def dimension_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d[0], (d[1], d[2]), (d[3], d[4])) for i, d in enumerate(DIMENSIONS)], f"dim_ord int, dim_id string, labels {PAIR}, shortLabel {PAIR}")


def label_table(spark: SparkSession, labels: dict[str, tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in labels.items()], f"id string, labels {PAIR}")


def request_state(url):
    """q, category, view and compare of a URL; an unknown view is ``field``."""
    view = query_parameter(url, "view", "field")
    return F.struct(
        query_parameter(url, "q").alias("q"), query_parameter(url, "category").alias("category"),
        F.when(view.isin("field", "index", "map"), view).otherwise("field").alias("view"), query_parameter(url, "compare").alias("compare"),
    )
