"""The ordered stream against the batch fold, in several micro-batches out of order, with a restart between them."""

import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import selection
from notegrid.streaming import ordered


@pytest.fixture
def store(spark):
    before = spark.conf.get(ordered.STORE[0], None)
    spark.conf.set(*ordered.STORE)
    yield
    spark.conf.set(ordered.STORE[0], before) if before else spark.conf.unset(ordered.STORE[0])


def test_stream_equals_fold_after_a_restart(spark, tmp_path, store):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(4)}", i, i, rng.choice("abc")) for i in range(120)]
    # a row comes up to 10 seconds late
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 10))
    schema = "u string, t long, n long, x string"
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t"))
    want = {r["u"]: list(r["selection"]) for r in selection.fold(df, "u", ["at", "n"], "x").collect()}
    seen, batches = {}, []

    def keep(found, number):
        batches.append(number)
        seen.update({r["key"]: list(r["selection"]) for r in found.collect()})

    for k in range(2):  # the second query goes on from the first one's checkpoint
        for j in range(2):
            part = arriving[(2 * k + j) * 30 : (2 * k + j + 1) * 30]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("t"))
        q = ordered.ordered_selections(stream, "u", "at", "n", "x", "12 seconds").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        q = q.foreachBatch(keep).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert seen == want and len(set(batches)) >= 4


def test_keys_share_state(spark, tmp_path, store):
    """Very many keys cost a few calls to the store, and each comes out as the fold says; late rows are dropped."""
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(3000)}", 1 + i // 20, i, rng.choice("abcd")) for i in range(12000)]
    schema = "u string, t long, n long, x string"
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t"))
    want = {r["u"]: list(r["selection"]) for r in selection.fold(df, "u", ["at", "n"], "x").collect()}
    seen = {}
    for part in (rows[:6000], [*rows[6000:], ("late", 2, 1, "a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("t"))
        out = ordered.ordered_selections(stream, "u", "at", "n", "x", "5 seconds", buckets=3)
        assert "bucket" in out._jdf.queryExecution().analyzed().toString()
        q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        assert q.foreachBatch(lambda found, _: seen.update({r["key"]: list(r["selection"]) for r in found.collect()})).trigger(availableNow=True).start().awaitTermination(120)
    assert len(seen) == len(want) and {k: (v, want[k]) for k, v in seen.items() if v != want[k]} == {}
