"""Validation: rules as columns, findings as rows.

An issue is (table, ordinal, key, place, path, code, message). Rules of one record are independent of each other: a range out of
bounds is also tested for its order. ``validate`` returns every issue; ``check`` raises at the first failing step, in the
order records, uniqueness, references.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from notegrid.functions import strip_js, url_fault
from notegrid.sources.tables import CATEGORY, CONFIDENCE_LABELS, DESCRIPTOR, DIMENSION_IDS, EVIDENCE_LABELS, MODALITY_LABELS, SOURCE, STATUS_LABELS, schema_of, stored

#: Members of the enumerations that have no labels.
MOTIONS = ("breathe", "bloom", "drift", "echo")
SOURCE_TYPES = ("reference_framework", "open_dataset", "project_curation")
REUSE_POLICIES = ("reference_only", "open_reuse", "project_created")


class Invalid(ValueError):
    """Tables that fail validation. issues: all findings of the first failing step, a DataFrame; str() reads them in order, as
    a stream, and joins their messages by line ends."""

    def __init__(self, issues: DataFrame) -> None:
        super().__init__()
        self.issues = issues

    def __str__(self) -> str:
        rows = self.issues.orderBy("ordinal", "place", "path").toLocalIterator()
        return "\n".join(f"{r['table']} {r['key']} {r['path']}: {r['message']}" for r in rows)


@dataclass(frozen=True)
class Rule:
    """Rows where broken is true have an issue at path. broken must not be null."""

    path: str
    code: str
    message: str
    broken: Column


def no(x: Column) -> Column:
    """x, or true where it is null."""
    return F.coalesce(x, F.lit(True))


def text(path: str) -> Rule:
    return Rule(path, "too_small", "must not be empty", no(F.length(strip_js(F.col(path))) == 0))


def member(path: str, of: Sequence[str]) -> Rule:
    return Rule(path, "invalid_enum", "must be one of " + ", ".join(of), no(~F.col(path).isin(*of)))


def within(path: str, low: float, high: float) -> Rule:
    x = F.col(path)
    return Rule(path, "out_of_range", f"must be between {low:g} and {high:g}", no(F.isnan(x) | (x < low) | (x > high)))


def ordered(low: str, high: str, path: str) -> Rule:
    return Rule(path, "out_of_order", f"{low} must not exceed {high}", F.coalesce(F.col(low) > F.col(high), F.lit(False)))


def range_rules(path: str, low: float = 0, high: float = 5) -> list[Rule]:
    parts = [f"{path}.{p}" for p in ("min", "typical", "max")]
    return [*(within(p, low, high) for p in parts), ordered(parts[0], parts[1], parts[0]), ordered(parts[1], parts[2], parts[1])]


def texts(path: str) -> Rule:
    """Elements of an array, which may be empty, must not be."""
    return Rule(path, "too_small", "elements must not be empty", no(F.exists(F.col(path), lambda e: F.coalesce(F.length(strip_js(e)) == 0, F.lit(True)))))


def members(path: str, of: Sequence[str]) -> Rule:
    return Rule(path, "invalid_enum", "elements must be of " + ", ".join(of), no(F.exists(F.col(path), lambda e: F.coalesce(~e.isin(*of), F.lit(True)))))


def filled(path: str) -> Rule:
    return Rule(path, "too_small", "must have an element", no(F.size(F.col(path)) < 1))


def pair(path: str) -> list[Rule]:
    return [text(f"{path}.en"), text(f"{path}.zhHans")]


def optional(path: str, rules: list[Rule]) -> list[Rule]:
    return [Rule(r.path, r.code, r.message, F.col(path).isNotNull() & r.broken) for r in rules]


CATEGORY_RULES = lambda: [text("id"), text("slug"), *pair("labels"), *pair("shortLabel"), *pair("description"), text("colorToken")]
SOURCE_RULES = lambda: [
    text("id"), text("name"), member("sourceType", SOURCE_TYPES), text("licenseStatus"), member("reusePolicy", REUSE_POLICIES),
    Rule("attributionRequired", "invalid_type", "must be true or false", F.col("attributionRequired").isNull()), text("notes"),
    Rule("url", "invalid_url", "must be a URL", url_fault(F.col("url")).isNotNull()),
]


def descriptor_rules(notes_for_boundary: bool = False) -> list[Rule]:
    rules = [text("id"), text("slug"), *pair("labels"), texts("aliases.en"), texts("aliases.zhHans"), text("categoryId"), member("descriptorStatus", tuple(STATUS_LABELS))]
    rules += [filled("sensoryModalities"), members("sensoryModalities", tuple(MODALITY_LABELS)), *pair("summary")]
    for d in DIMENSION_IDS:
        rules += range_rules(f"sensoryAssociation.{d}")
    rules += [member("confidence", tuple(CONFIDENCE_LABELS)), member("evidenceStatus", tuple(EVIDENCE_LABELS)), filled("sourceIds"), texts("sourceIds"), text("visualProfile.motif")]
    rules += [within(f"visualProfile.{p}", 0, 1) for p in ("density", "curvature", "halo")] + [member("visualProfile.motion", MOTIONS), *optional("editorialNote", pair("editorialNote"))]
    if notes_for_boundary:
        rules.append(Rule("editorialNote", "missing_note", "a boundary term needs a note", (F.col("descriptorStatus") == "boundary") & F.col("editorialNote").isNull()))
    return rules


def record_issues(df: DataFrame, table: str, rules: Sequence[Rule], key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """One row for every rule that a row breaks, place being the rule's number; one pass over df."""
    found = F.filter(
        F.array(*[F.when(r.broken, F.struct(F.lit(i).alias("n"), F.lit(r.path).alias("path"), F.lit(r.code).alias("code"), F.lit(r.message).alias("message"))) for i, r in enumerate(rules)]), lambda x: x.isNotNull()
    )
    issues = df.select(F.lit(table).alias("table"), F.col(ordinal).cast("long").alias("ordinal"), F.col(key).cast("string").alias("key"), F.explode(found).alias("i"))
    return issues.select("table", "ordinal", "key", F.col("i.n").alias("place"), "i.path", "i.code", "i.message")


def line_issues(marked: DataFrame, table: str) -> DataFrame:
    """One row for every line that is no JSON: its path is the file's, its message the line's text; it has no ordinal or key."""
    bad = marked.where("line is not null")
    return bad.select(F.lit(table).alias("table"), "ordinal", F.lit(None).cast("string").alias("key"), F.lit(0).alias("place"), F.col("file").alias("path"), F.lit("malformed").alias("code"), F.col("line").alias("message"))


def write_valid(df: DataFrame, table: str, rules: Sequence[Rule], path: str) -> DataFrame:
    """Write the rows of df that break no rule to path, as Parquet, and return (table, place, path, code, n): how many rows broke
    each rule, with one more row of the code ``accepted``, in the same single job.

    The counts are metrics that tasks send with their results. Each task's are counted once, whatever was tried again, as long as
    df is read in the stage that writes; behind a shuffle, a stage that runs again after a lost executor may count twice, so
    write such a df first. A df without rows has counts of 0.
    """
    own = "_broken"
    tested = df.withColumn(own, F.array(*[r.broken for r in rules]))
    any_ = F.exists(own, lambda b: b)
    seen = Observation(f"rules of {table}")
    counts = [F.count_if(F.col(own)[i]).alias(f"rule{i}") for i in range(len(rules))]
    tested.observe(seen, *counts, F.count_if(~any_).alias("accepted")).where(~any_).drop(own).write.parquet(path)
    n = seen.get
    rows = [(table, i, r.path, r.code, n[f"rule{i}"]) for i, r in enumerate(rules)] + [(table, None, None, "accepted", n["accepted"])]
    return df.sparkSession.createDataFrame(rows, "table string, place int, path string, code string, n long")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_issues(df: DataFrame, table: str, column: str, ordinal: str = "ordinal") -> DataFrame:
    """One row for every repeated value, at its first repeat."""
    rows = df.groupBy(column).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).where("n > 1").select(F.col(column).alias("_v"), "first")
    again = df.join(rows, df[column] == F.col("_v")).where(F.col(ordinal) > F.col("first")).groupBy("_v").agg(F.min(ordinal).alias("at"))
    return again.select(F.lit(table).alias("table"), F.col("at").cast("long").alias("ordinal"), F.col("_v").cast("string").alias("key"), F.lit(0).alias("place"), F.lit(column).alias("path"), F.lit("not_unique").alias("code"), F.lit("must be unique").alias("message"))


def missing(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of df whose column is no key of parent."""
    return df.join(parent.select(F.col(key).alias("_k")), df[column] == F.col("_k"), "left_anti")


def reference_issues(descriptors: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for a missing category and for every occurrence of a missing source."""
    one = missing(descriptors, "categoryId", categories, "id").select("ordinal", "slug", F.lit(-1).alias("at"), F.lit("categoryId").alias("path"), F.concat(F.col("slug"), F.lit(" references missing category "), "categoryId").alias("message"))
    listed = descriptors.select("ordinal", "slug", F.posexplode("sourceIds").alias("at", "source"))
    many = missing(listed, "source", sources, "id").select("ordinal", "slug", "at", F.lit("sourceIds").alias("path"), F.concat(F.col("slug"), F.lit(" references missing source "), "source").alias("message"))
    both = one.unionByName(many)
    return both.select(F.lit("descriptors").alias("table"), "ordinal", F.col("slug").alias("key"), F.col("at").alias("place"), F.concat_ws(".", "path", F.when(F.col("at") >= 0, F.col("at").cast("string"))).alias("path"), F.lit("missing_reference").alias("code"), "message")


def trimmed(df: DataFrame, schema: str) -> DataFrame:
    """df with the declared columns only, and every text of them trimmed."""

    def clean(x: Column, kind):
        if kind.typeName() == "string":
            return strip_js(x)
        if kind.typeName() == "array" and kind.elementType.typeName() == "string":
            return F.transform(x, strip_js)
        if kind.typeName() == "struct":
            return F.when(x.isNotNull(), F.struct(*[clean(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return x

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in schema_of(schema).fields])


def validate(categories: DataFrame, sources: DataFrame, descriptors: DataFrame, notes_for_boundary: bool = False) -> DataFrame:
    """All issues of the three tables, with the step that finds them."""
    steps = [
        record_issues(categories, "categories", CATEGORY_RULES()), record_issues(sources, "sources", SOURCE_RULES()), record_issues(descriptors, "descriptors", descriptor_rules(notes_for_boundary), "slug"),
        unique_issues(categories, "categories", "id"), unique_issues(sources, "sources", "id"), unique_issues(descriptors, "descriptors", "id"), unique_issues(descriptors, "descriptors", "slug"),
        reference_issues(descriptors, categories, sources),
    ]
    return reduce(DataFrame.unionByName, [s.withColumn("step", F.lit(i)) for i, s in enumerate(steps)])


def check(categories: DataFrame, sources: DataFrame, descriptors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables, trimmed to what is declared; Invalid with all issues of the first failing step if there are any."""
    tables = trimmed(categories, CATEGORY), trimmed(sources, SOURCE), trimmed(descriptors, DESCRIPTOR)
    issues = stored(validate(*tables))
    first = issues.agg(F.min("step")).first()[0]
    if first is not None:
        raise Invalid(issues.where(F.col("step") == first))
    return tables


def joined_messages(issues: DataFrame) -> DataFrame:
    """(table, ordinal, key, messages): a record's messages in the order of their places, joined by line ends."""
    listed = F.sort_array(F.collect_list(F.struct("place", "path", "message")))  # at most one entry a rule and reference of the record
    return issues.groupBy("table", "ordinal", "key").agg(F.array_join(F.transform(listed, lambda m: m["message"]), "\n").alias("messages"))


def every(df: DataFrame, holds: Column, *keys: str) -> DataFrame:
    """(keys, every): whether all rows of each key, or of df, hold; null does not hold, no rows do."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(F.coalesce(holds, F.lit(False))), F.lit(True)).alias("every"))
