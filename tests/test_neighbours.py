"""Exact neighbours by pivots against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import neighbours, related, scan


def rows(seed, n, clusters):
    rng = random.Random(seed)
    centres = [[rng.uniform(-3, 3) for _ in range(5)] for _ in range(clusters)]
    out = []
    for i in range(n):
        c = rng.randrange(clusters)
        category = rng.choice([None, "a", "b", f"c{c}"]) if seed % 2 else "a"
        out.append((i, category, [x + rng.gauss(0, 0.05) for x in centres[c]]))
    return [*out, *((n + i, out[i][1], out[i][2]) for i in range(0, 20, 2)), (9000, "a", None), (9001, None, [0.0] * 5)]


def by_hand(data, k, bonus):
    data = [r for r in data if r[2] is not None]
    want = {}
    for i, c, x in data:
        scored = []
        for j, d, y in data:
            if i != j:
                distance = math.sqrt(sum((p - q) * (p - q) for p, q in zip(y, x, strict=True)))
                scored.append((distance + (bonus if c is not None and c == d else 0), j, distance))
        want[i] = [(j, round(s, 9)) for s, j, _ in sorted(scored)[:k]]
    return want


@pytest.mark.parametrize(("seed", "n", "clusters", "k"), [(1, 400, 9, 4), (2, 300, 6, 3), (3, 30, 2, 50)])
def test_equal_to_brute_force(spark, monkeypatch, seed, n, clusters, k):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    monkeypatch.setattr(scan, "RANGE_ROWS", 60)
    data = rows(seed, n, clusters)
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "id long, kind string, v array<double>, block string, part int").repartition(3)
    out, computed = neighbours.exact_related(df, df, "id", "v", "kind", k)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["key"], round(r["score"], 9)))
    want = by_hand(data, k, -2.0)
    assert got == want
    whole = len(want) ** 2
    assert computed <= whole
    if seed < 3:
        assert computed < 0.75 * whole, computed / whole  # clusters are told apart
    plain = related.related(df, df, "id", "v", "kind", k).select("query", "rank", "key").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, out.select("query", "rank", "key").collect()))


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, kind string, v array<double>")
    out, computed = neighbours.exact_related(empty, empty, "id", "v", "kind")
    assert out.count() == 0 and computed == 0
    one = spark.createDataFrame([(1, None, [1.0])], "id long, kind string, v array<double>")
    assert neighbours.exact_related(one, one, "id", "v", "kind")[0].count() == 0


def test_related_moves_queries_only(spark):
    df = spark.range(500).select("id", F.lit("a").alias("kind"), F.array(F.rand(1), F.rand(2)).alias("v"))
    out = related.related(df, df.where("id % 50 = 0"), "id", "v", "kind")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
    assert out.count() == 40


def test_recurring_profiles_meet_once(spark):
    """Of rows that tie for every query only the first few by key are compared; the rows of one key count each."""
    rng = random.Random(5)
    kinds = [("a", [0.0, 1.0]), ("a", [0.5, 1.0]), ("b", [0.0, 1.0]), (None, [0.0, 1.0]), ("b", [3.0, -0.0]), ("b", [3.0, 0.0])]
    data = [(i, *rng.choice(kinds)) for i in range(600)] + [(7, *kinds[0])] * 6 + [(900, None, [9.0, 9.0]), (901, "b", None)]
    df = spark.createDataFrame(data, "id long, kind string, v array<double>").repartition(3)
    asked = df.where("id % 5 = 0").dropDuplicates(["id"])
    out = related.related(df, asked, "id", "v", "kind", 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[-1]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["key"], round(r["score"], 9)))
    for q in asked.where("v is not null").collect():
        scored = [(round(math.dist(q["v"], x) - 2 * (c is not None and c == q["kind"]), 9), i) for i, c, x in data if x is not None and i != q["id"]]
        assert got[q["id"]] == [(i, s) for s, i in sorted(scored)[:3]]


def test_queries_are_stored_once_however_many_blocks_they_visit(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "TOGETHER", 40_000)  # several rounds
    sent = []

    def stored(df, keep=neighbours.stored):
        out = keep(df)
        if "q_keys" in out.columns:
            sent.append(out.agg(F.sum(F.size("q_keys"))).first()[0])
        return out

    monkeypatch.setattr(neighbours, "stored", stored)
    rng = random.Random(8)
    data = [(i, rng.choice([None, "a", "b"]), [rng.gauss(0, 1) * 1000 ** (i % 2) for _ in range(8)]) for i in range(500)] + [(700 + i, "a", [5.0] * 8) for i in range(30)] + [(800, "b", [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id long, kind string, v array<double>")
    out, computed = neighbours.exact_related(df, df, "id", "v", "kind", 5)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["key"], round(r["score"], 9)))
    assert got == by_hand(data[:-1], 5, -2.0)
    assert sum(sent) == len(data) and computed <= len(data) ** 2
