"""Scans over ranges against a plain loop, with one key of most rows."""

import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import scan, selection


def rows(seed, n, hot=0.9):
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < hot else f"k{rng.randrange(6)}" for _ in range(n)]
    return [(k, i, rng.choice([None, rng.uniform(-5, 5), rng.uniform(-5, 5)]), rng.choice([None, "a", "b", "c", "a", "b", "d,"]), "x") for i, k in enumerate(keys)]


@pytest.mark.parametrize(("seed", "n", "hot", "each"), [(1, 900, 0.9, 50), (2, 300, 0.0, 1000), (3, 5, 0.5, 1), (4, 400, 1.0, 7)])
def test_smoothed_and_fold(spark, monkeypatch, seed, n, hot, each):
    monkeypatch.setattr(scan, "RANGE_ROWS", each)
    data = rows(seed, n, hot)
    df = spark.createDataFrame([*data, (None, 1, 1.0, "a", "x")], "u string, i int, v double, x string, part string").repartition(3)
    state, want, picked = {}, {}, {}
    for k, i, v, x, _ in data:
        now = state.get(k, 2.0)
        state[k] = want[i] = now if v is None else now + (v - now) * 0.18
        picked[k] = picked.get(k, ()) if x is None else selection.step(picked.get(k, ()), x)
    out = scan.smoothed(df, "u", ["i"], "v", start=2.0)
    assert out.columns == [*df.columns, "smoothed"]
    got = {r["i"]: r["smoothed"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    folded = selection.fold(df, "u", ["i"], "x").collect()
    assert len(folded) == len(picked) and {r["u"]: tuple(r["selection"]) for r in folded} == picked


def test_a_stretch_does_what_its_items_do():
    rng = random.Random(5)
    for _ in range(3000):
        items = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        one = selection.Stretch()
        for x in items:
            one.add(x)
        for start in ((), ("a",), ("z",), ("a", "b"), ("b", "a"), ("z", "y"), ("z", "c"), ("d", "z"), ("c", "d")):
            state = selection.follow(start, one.items)
            assert one.ends.get(state, state) == selection.follow(start, items), (start, items)


def test_largest_range_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(scan, "RANGE_ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("u"), F.col("id").alias("i"))
    sizes = [r["count"] for r in scan.ranged(df, "u", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 2000


def test_scans_of_nothing(spark):
    empty = spark.createDataFrame([], "u string, i int, v double, x string")
    assert scan.smoothed(empty, "u", ["i"], "v").count() == 0 and selection.fold(empty, "u", ["i"], "x").count() == 0
