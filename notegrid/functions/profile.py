"""Profile arithmetic: scores of 0 to 5, ranges, distances, and places on the map and in the field.

Operations keep their order, so that doubles come out the same to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Opacity of a confidence, and vertical band of a category with the default for others.
OPACITY = {"low": 0.42, "medium": 0.68, "high": 0.92}
BANDS = {"floral": 18, "fruit": 31, "sweet": 45, "nut-cocoa": 59, "spice-roasted": 70, "green-earthy": 80, "fermented": 89, "unresolved": 12}
BAND = 50


def score(low: Column, typical: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("min"), typical.cast("double").alias("typical"), high.cast("double").alias("max"))


def clamp(low: float, high: float, x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def score_to_percent(x: Column) -> Column:
    """Divided by 5, then times 100, within 0 and 100; NaN stays."""
    return clamp(0, 100, (x / 5) * 100)


def range_width(low: Column, high: Column) -> Column:
    return score_to_percent(high) - score_to_percent(low)


def range_track(low: Column, typical: Column, high: Column) -> Column:
    return F.struct(score_to_percent(low).alias("left"), range_width(low, high).alias("width"), score_to_percent(typical).alias("typical"))


def distance(a: Sequence[Column] | Column, b: Sequence[Column] | Column) -> Column:
    """Euclidean distance, squares added from left to right; sequences of columns unroll, array columns fold."""
    if isinstance(a, Column):
        squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    difference = [x.cast("double") - y.cast("double") for x, y in zip(a, b, strict=True)]
    return F.sqrt(reduce(lambda s, d: s + d * d, difference, F.lit(0.0)))


def abs_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def equal_or_null(a: Column, b: Column) -> Column:
    return F.when(a == b, a)


def map_point(sweetness: Column, sourness: Column, aroma: Column) -> Column:
    return F.struct(score_to_percent(sweetness).alias("x"), (100 - score_to_percent(sourness)).alias("y"), (5 + aroma * 2.2).alias("radius"))


def map_encodings(radius: Column, confidence: Column) -> Column:
    opacity = F.create_map(*[F.lit(x) for kv in OPACITY.items() for x in kv])[confidence]
    return F.struct(
        (radius * 0.35 + 2.2).alias("halo"), (radius * 0.22 + 1.2).alias("node"), F.when(confidence == "high", 0.68).otherwise(0.38).alias("stroke"), opacity.alias("opacity")
    )


def char_seed(text: Column) -> Column:
    """The sum of a text's UTF-16 code units."""
    units = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    halves = F.transform(units, lambda p: F.when(p < 0x10000, p).otherwise(F.lit(0xD800) + F.floor((p - 0x10000) / 1024) + F.lit(0xDC00) + (p - 0x10000) % 1024))
    return F.aggregate(halves, F.lit(0).cast("long"), lambda s, x: s + x)


def node_size(aroma: Column) -> Column:
    return 1.5 + aroma * 0.46


def field_position(seed: Column, index: Column, total: Column, sweetness: Column, sourness: Column, category: Column | None = None) -> Column:
    orbit = index / F.greatest(F.lit(1), total - 1) * math.pi * 2
    band = F.lit(BAND) if category is None else F.coalesce(F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])[category], F.lit(BAND))
    x = 14 + (sweetness / 5) * 72 + F.sin(seed) * 7
    y = band + F.cos(orbit + seed) * 8 - (sourness / 5) * 9
    return F.struct(clamp(8, 92, x).alias("x"), clamp(13, 88, y).alias("y"))


def procedural_mark(seed: Column, i: Column, points: int = 9) -> Column:
    """Point i of a mark's ring about (100, 100)."""
    angle = (math.pi * 2 * i) / points + seed * 0.011
    distance_ = 34 + (seed + i * 17) % 42
    return F.struct((100 + F.cos(angle) * distance_).alias("x"), (100 + F.sin(angle) * distance_).alias("y"), (3 + (seed + i) % 5).alias("r"), (0.2 + i * 0.035).alias("opacity"))
