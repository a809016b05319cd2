import math

import pytest
from pyspark.sql import functions as F

from notegrid import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "normal"),
    [
        ("Café", "cafe"), ("Ａﬁ", "afi"), ("a^b", "ab"), ("a`b", "ab"), ("a·b", "ab"), ("ー", ""), ("^", ""), ("　 Tea\t﻿", "tea"), ("100%_", "100%_"), ("   ", ""), ("が", "か"), (None, None), ("´", ""),
    ],
)
def test_normalize_term(spark, text, normal):
    assert one(spark, fn.normalize_term(F.lit(text).cast("string"))) == normal


def test_search_text_order(spark):
    out = fn.search_text(F.lit("Jasmine"), F.lit("茉莉"), F.array(F.lit("Mo Li")), F.array().cast("array<string>"), F.lit("jasmine"), F.lit("j1"))
    assert one(spark, out) == "jasmine 茉莉 mo li jasmine j1"


@pytest.mark.parametrize(("n", "label"), [(0, "01"), (8, "09"), (9, "10"), (98, "99"), (99, "100")])
def test_ordinal_label(spark, n, label):
    assert one(spark, fn.ordinal_label(F.lit(n))) == label


@pytest.mark.parametrize(("x", "text"), [(0.25, "0.3"), (0.35, "0.3"), (0.45, "0.5"), (3.1, "3.1"), (0.0, "0.0"), (0.10000000000000009, "0.1"), (-1.25, "-1.3"), (2.0, "2.0")])
def test_to_fixed(spark, x, text):
    assert one(spark, fn.to_fixed(F.lit(x))) == text


@pytest.mark.parametrize(("text", "items"), [("a,b,c", ["a", "b"]), ("a,,b", ["a", "b"]), (" a , b ", ["a", "b"]), ("", []), (None, []), ("a,a", ["a", "a"])])
def test_comma_list(spark, text, items):
    assert one(spark, fn.comma_list(F.lit(text).cast("string"))) == items


def test_query_parameter(spark):
    url = F.lit("https://h/atlas?q=red%20tea+x&category=&view=map")
    assert one(spark, fn.query_parameter(url, "q")) == "red tea x"
    assert one(spark, fn.query_parameter(url, "category", "d")) == ""
    assert one(spark, fn.query_parameter(url, "compare", "d")) == "d"


@pytest.mark.parametrize(("path", "out"), [("/atlas", "/atlas/"), ("/atlas?q=1", "/atlas/?q=1"), ("/flavor/rose", "/flavor/rose/"), ("/flavor/rose/", "/flavor/rose/"), ("/", "/")])
def test_trailing_slash(spark, path, out):
    assert one(spark, fn.trailing_slash(F.lit(path))) == out


def test_percent(spark):
    assert one(spark, fn.score_to_percent(F.lit(4.4))) == 88.00000000000001
    assert one(spark, fn.score_to_percent(F.lit(9.0))) == 100
    assert one(spark, fn.score_to_percent(F.lit(-1.0))) == 0
    assert math.isnan(one(spark, fn.score_to_percent(F.lit(float("nan")))))
    assert one(spark, fn.range_width(F.lit(1.0), F.lit(7.0))) == 80


def test_map_point_and_marks(spark):
    p = one(spark, fn.map_point(F.lit(2.1), F.lit(1.5), F.lit(4.5)))
    assert (p["x"], p["y"], p["radius"]) == (42.00000000000001, 70, 14.9)
    m = one(spark, fn.map_encodings(F.lit(10.0), F.lit("high")))
    assert (m["halo"], m["stroke"], m["opacity"]) == (10 * 0.35 + 2.2, 0.68, 0.92)


def test_distance_forms_agree(spark):
    a, b = [0.1, 2.3, 4.5, 1.1, 0.7, 3.3], [1.0, 2.0, 0.5, 4.1, 2.7, 0.3]
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    unrolled = one(spark, fn.distance([F.lit(x) for x in a], [F.lit(y) for y in b]))
    folded = one(spark, fn.distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert unrolled == folded == math.sqrt(total)


@pytest.mark.parametrize(("text", "seed"), [("jasmine", 743), ("lemon", 539), ("dark-chocolate", 1409), ("", 0), ("😀", 0xD83D + 0xDE00)])
def test_char_seed(spark, text, seed):
    assert one(spark, fn.char_seed(F.lit(text))) == seed


def test_field_position_clamps(spark):
    p = one(spark, fn.field_position(F.lit(743), F.lit(0), F.lit(1), F.lit(5.0), F.lit(5.0), F.lit("floral")))
    assert 8 <= p["x"] <= 92 and 13 <= p["y"] <= 88
    q = one(spark, fn.field_position(F.lit(743), F.lit(0), F.lit(24), F.lit(2.1), F.lit(1.5), F.lit("floral")))
    assert q["x"] == pytest.approx(14 + 2.1 / 5 * 72 + math.sin(743) * 7) and q["y"] == pytest.approx(18 + math.cos(743) * 8 - 1.5 / 5 * 9)


def test_decode_and_lists(spark):
    assert one(spark, fn.decode({"a": "A"}, F.lit("a"))) == "A"
    assert one(spark, fn.decode({"a": "A"}, F.lit("z"))) is None
    assert one(spark, fn.join_list(F.array(F.lit("x"), F.lit("y")), "zhHans")) == "x、y"
    assert one(spark, fn.caption(F.lit(None).cast("string"), F.lit("asset"), F.lit("mark"))) == "mark"
    assert one(spark, fn.first_present(F.lit(None).cast("string"), F.lit("drift"))) == "drift"
    assert one(spark, fn.equal_or_null(F.lit(1), F.lit(2))) is None
