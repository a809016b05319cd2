"""Neighbour lists kept current against lists built anew."""

import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import refresh, related

SCHEMA = "id long, kind string, v array<double>, query string, part int, near int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1, 2) for i, r in rows.items()], SCHEMA).repartition(3)


def row(rng):
    return rng.choice([None, "a", "b"]), rng.choice([None, *[[float(rng.randrange(6)), float(rng.randrange(6))] for _ in range(9)]])


def found(df):
    return sorted((r["query"], r["rank"], r["key"], round(r["distance"], 9), round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("seed", "n", "every", "k"), [(1, 70, 2, 4), (3, 4, 1, 6)])
def test_equal_to_a_full_build(spark, monkeypatch, seed, n, every, k):
    monkeypatch.setattr(refresh, "PART_ANCHORS", 8)
    monkeypatch.setattr(refresh, "QUERIES", 5)
    monkeypatch.setattr(refresh, "TOGETHER", 400)
    rng = random.Random(seed)
    rows = {i: row(rng) for i in range(n)}
    df = frame(spark, rows)
    lists = refresh.build(df, df.where(F.col("id") % every == 0), "id", "v", "kind", k)
    for _ in range(seed % 2 + (n > 4)):
        some = rng.sample(sorted(rows), min(len(rows), 5))
        changed = [*some, 5000, 5000, None]  # of a row that is nowhere, twice, and of none
        for i in some[:2]:
            del rows[i]
        for i in some[2:]:
            rows[i] = row(rng)
        for i in range(max(rows) + 1, max(rows) + 4):
            rows[i] = row(rng)
            changed.append(i)
        df = frame(spark, rows)
        anchors = df.where(F.col("id") % every == 0)
        done = refresh.refresh(lists, df, anchors, spark.createDataFrame([(c,) for c in changed], "key long"))
        want = found(related.related(df, anchors, "id", "v", "kind", k))
        assert found(lists.ranked(spark)) == want
        assert sorted(r["query"] for r in lists.by_anchor(spark).collect()) == sorted(i for i, r in rows.items() if r[1] is not None and i % every == 0)
        assert done.searched <= done.altered


def test_a_small_change_writes_few_lists(spark, monkeypatch):
    monkeypatch.setattr(refresh, "PART_ANCHORS", 10)
    rows = {i: ("a", [float(i), 0.0]) for i in range(200)}
    df = frame(spark, rows)
    lists = refresh.build(df, df, "id", "v", "kind", 2)
    rows[1000] = ("a", [100.25, 0.0])
    del rows[7]
    df = frame(spark, rows)
    done = refresh.refresh(lists, df, df, spark.createDataFrame([(1000,), (7,)], "key long"))
    assert found(lists.ranked(spark)) == found(related.related(df, df, "id", "v", "kind", 2))
    assert done.altered <= 8 and done.removed == 1 and done.searched <= 5 and done.parts < lists.parts
    again = refresh.refresh(lists, df, df, spark.createDataFrame([(3,)], "key long"))  # named, yet as it was
    assert found(lists.ranked(spark)) == found(related.related(df, df, "id", "v", "kind", 2)) and again.removed == 0
    assert refresh.refresh(lists, df, df, spark.createDataFrame([], "key long")) == refresh.Refreshed(0, 0, 0, 0)


def test_down_to_nothing_and_back(spark):
    rows = {1: ("a", [1.0, 0.0]), 2: (None, [2.0, 0.0])}
    df, empty = frame(spark, rows), spark.createDataFrame([], SCHEMA)
    lists = refresh.build(df, df, "id", "v", "kind", 4)
    keys = spark.createDataFrame([(1,), (2,)], "key long")
    assert refresh.refresh(lists, empty, empty, keys).removed == 2
    assert lists.by_anchor(spark).count() == 0
    assert refresh.refresh(lists, df, df, keys).searched == 2
    assert found(lists.ranked(spark)) == [(1, 1, 2, 1.0, 1.0), (2, 1, 1, 1.0, 1.0)]
    nothing = refresh.build(empty, empty, "id", "v", "kind")
    assert nothing.ranked(spark).count() == 0
    assert refresh.refresh(nothing, df, df, keys).altered == 2
    with pytest.raises(ValueError, match="positive"):
        refresh.build(df, df, "id", "v", "kind", 0)
