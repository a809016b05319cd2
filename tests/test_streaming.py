from pyspark.sql import functions as F

from notegrid.streaming import selections


def test_selection_stream(spark, tmp_path):
    rows = [("u", 1, "a"), ("u", 2, "b,"), ("v", 1, "")], [("u", 3, "a"), ("u", 4, "c"), ("v", 2, "a"), ("w", 1, "")]
    seen = {}
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "u string, t int, x string").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    for i in range(2):
        spark.read.parquet(str(tmp_path / f"in{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("u string, t int, x string").parquet(str(tmp_path / "in"))
        q = selections(stream, "u", "t", "x").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        q = q.foreachBatch(lambda df, _: seen.update(dict(df.select("key", F.col("selection")).collect()))).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seen == {"u": ["b,", "c"], "v": ["", "a"], "w": [""]}
