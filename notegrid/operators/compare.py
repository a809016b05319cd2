"""Pairwise comparison of profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import abs_difference, comma_list, equal_or_null
from notegrid.operators.catalog import selected
from notegrid.operators.ordering import ranked_differences
from notegrid.operators.search import similar
from notegrid.operators.selection import arity
from notegrid.sources.tables import DIMENSION_IDS, request_state


def differences(dims: Sequence[str], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """(dim, difference) of every dimension, largest difference first, equal ones in the order of dims."""
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), abs_difference(x, y).alias("difference")) for d, x, y in zip(dims, a, b, strict=True)])
    return ranked_differences(rows, lambda r: r["difference"])


def shared_elements(a: Column, b: Column) -> Column:
    """Elements of a that b has, in a's order and as often as a has them."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def compare(pairs: DataFrame, dims: Sequence[str], a: Sequence[Column], b: Sequence[Column], same: dict[str, tuple[Column, Column]], modalities: tuple[Column, Column] | None = None) -> DataFrame:
    """pairs with differences, similar dimensions, the biggest difference, shared values of the columns in same, and modalities."""
    out = pairs.withColumn("differences", differences(dims, a, b))
    new = {
        "similar": F.transform(F.filter("differences", lambda r: similar(r["difference"])), lambda r: r["dim"]), "biggest": F.get("differences", F.lit(0)),
        **{f"same_{k}": equal_or_null(x, y) for k, (x, y) in same.items()},
    }
    if modalities is not None:
        new["shared_modalities"] = shared_elements(*modalities)
    return out.withColumns(new)


def overlay(requests: DataFrame, url: str, key: str, df: DataFrame) -> DataFrame:
    """What the comparison of each request shows: its key, ``arity`` and, where two records are compared, the columns of compare
    over their profiles, else nulls.

    The URL's ``compare`` names slugs, of which the first two count; unknown ones go, one named twice stays twice. The requests
    that name anything are joined to the records by slug; at most two rows come back to a request. Keys are unique and not null.
    """
    wanted = requests.select(F.col(key).alias("_key"), comma_list(request_state(F.col(url))["compare"]).alias("_named"))
    side = F.struct(*[F.col(c) for c in ("slug", "categoryId", "confidence", "descriptorStatus", "sensoryModalities", "sensoryAssociation")])
    found = selected(wanted, F.col("_named"), df.select(F.col("slug").alias("_slug"), side.alias("_row")), "_slug")
    # two entries at most, of different pos, so that rows themselves are never ordered
    both = found.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_row"))), lambda s: s["_row"]).alias("_rows"))
    out = requests.select(F.col(key).alias("_key")).join(both, "_key", "left")
    out = out.withColumns({"arity": arity(F.coalesce("_rows", F.array().cast(both.schema["_rows"].dataType))), "a": F.get("_rows", F.lit(0)), "b": F.get("_rows", F.lit(1))})
    profiles = [[F.col(f"{s}.sensoryAssociation.{d}.typical") for d in DIMENSION_IDS] for s in "ab"]
    same = {c: (F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("categoryId", "confidence", "descriptorStatus")}
    done = compare(out, DIMENSION_IDS, *profiles, same, (F.col("a.sensoryModalities"), F.col("b.sensoryModalities")))
    two = F.col("arity") == "compared"
    shown = ["differences", "similar", "biggest", *[f"same_{c}" for c in same], "shared_modalities"]
    return done.select(F.col("_key").alias(key), "arity", F.col("a.slug").alias("first"), F.col("b.slug").alias("second"), *[F.when(two, F.col(c)).alias(c) for c in shown])
