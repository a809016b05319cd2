"""Lookups and references over tables stored in buckets: equal to plain joins, and nothing is moved."""

import random
from collections import Counter

from pyspark.sql import functions as F

from notegrid.sources import bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "SALT_ROWS", 40)
    monkeypatch.setattr(bucketed, "SALT_PART", 1)
    rng = random.Random(5)
    keys = ["hot"] * 400 + [rng.choice([None, "a", "b", "c", "gone", "", "é"]) for _ in range(300)]
    child = [(i, k, "name", 1) for i, k in enumerate(keys)]
    parent = [("hot", 1, "p"), ("a", 2, "p"), ("b", 3, "p"), ("b", 4, "again"), (None, 5, "p"), ("", 6, "p"), ("unused", 7, None)]
    c = spark.createDataFrame(child, "i long, ref string, name string, key int").repartition(5)
    p = spark.createDataFrame(parent, "id string, n long, name string")
    return child, parent, bucketed.store(c, "ref", p, "id", "i")


def test_lookup_and_references(spark, monkeypatch):
    child, parent, names = made(spark, monkeypatch)
    found = bucketed.looked_up(spark, names, {"n": "n", "name": "parent_name"})
    want = []
    for i, k, name, x in child:
        own = [(n, m) for key, n, m in parent if key is not None and key == k] or [(None, None)]
        want += [(i, k, name, x, n, m) for n, m in own]
    assert sorted(map(tuple, found.select("i", "ref", "name", "key", "n", "parent_name").collect()), key=repr) == sorted(want, key=repr)
    inner = bucketed.looked_up(spark, names, {"n": "n"}, "inner")
    assert inner.count() == sum(w[4] is not None for w in want)
    lost = bucketed.dangling(spark, names)
    assert sorted(r["i"] for r in lost.collect()) == [i for i, k, *_ in child if k is None or k not in {"hot", "a", "b", ""}]
    for df in (found, inner, lost):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == plan.count("FileScan")
    own = spark.table(names.child).where("ref = 'hot'").groupBy(bucketed.SALT).count().collect()
    assert len(own) == 10 and max(r["count"] for r in own) < 80
    copies = Counter(r[bucketed.KEY] for r in spark.table(names.parent).collect())
    salts = {key: max(1, -(-n // 40)) for key, n in Counter(k for _, k, *_ in child).items()}
    assert copies == Counter([key for key, *_ in parent for _ in range(salts.get(key, 1) if key is not None else 1)])
    bucketed.discard(spark, names)
    assert not spark.catalog.tableExists(names.child)


def test_numbers_as_keys_and_empty_tables(spark):
    child = spark.range(20).select("id", (F.col("id") % 6).alias("ref"))
    parent = spark.range(4).select(F.col("id").cast("int").alias("id"))
    names = bucketed.store(child, "ref", parent, "id", "id")
    assert sorted(r["id"] for r in bucketed.dangling(spark, names).collect()) == [4, 5, 10, 11, 16, 17]
    for c, p, n in ((child.limit(0), parent, 0), (child, parent.limit(0), 20), (child.limit(0), parent.limit(0), 0)):
        assert bucketed.dangling(spark, bucketed.store(c, "ref", p, "id", "id")).count() == n
