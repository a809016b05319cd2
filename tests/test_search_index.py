"""The gram index against a scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from notegrid.functions import normalize_term
from notegrid.operators import search_index


def rows():
    rng = random.Random(3)
    words = ["Été", "naïve", "the", "inn", "of", "日本語", "100%", "a_b", "x", "ﬁn", " ^ ", "the inn", "😀"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    return [*enumerate(texts), (7, "twice the inn"), (7, "twice the inn"), (None, "no key, the inn"), (900, None), (901, ""), (902, "ab"), (903, "a"), (904, "ｘ" * 5000 + "needle")]


TERMS = ["", " ^ ", "a", "AB", "é", "ete", "the inn", "inn the", "100%", "%", "_", "a_b", "日本", "日本語", "needle", "xneedle", "nowhere at all", "the zzz", "fin", "😀", " the inn of ", "of  the"]


@pytest.mark.parametrize(("together", "chunk"), [(1 << 22, 4096), (200, 20)])
def test_index_equals_scan(spark, monkeypatch, together, chunk):
    monkeypatch.setattr(search_index, "TOGETHER", together)
    monkeypatch.setattr(search_index, "CHUNK_ROWS", chunk)
    df = spark.createDataFrame([(k, t, "clash", 1, 2) for k, t in rows()], "key long, text string, gram string, chunk int, row int").repartition(3)
    plain = [(r["key"], r["t"]) for r in df.select("key", normalize_term(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    terms = dict(zip(TERMS, search_index.normalised(spark, TERMS), strict=True))
    want = sorted((q, str(k)) for k, x in plain for q, t in terms.items() if t in x)
    index = search_index.build(df, "key", "text")
    assert sorted((r["q"], str(r["key"])) for r in search_index.find(spark, index, TERMS).collect()) == want
    assert search_index.find(spark, index, ["no such text"]).count() == 0 == search_index.find(spark, index, []).count()


def test_find_reads_the_postings_of_its_grams_and_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(search_index, "CHUNK_ROWS", 10)
    df = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("some words "), F.md5(F.col("id").cast("string"))).alias("t"))
    index = search_index.build(df, "k", "t")
    term = df.where("k = 77").first()["t"][-12:]
    out = search_index.find(spark, index, [term])
    plan = out._jdf.queryExecution().toString()
    assert [r["key"] for r in out.collect()] == [77]
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
    postings = [s for s in scans if "gram" in s]
    assert postings and all("PartitionFilters: [part" in s.replace("isnotnull(part#", "part#") or "part#" in s.split("PartitionFilters")[1] for s in postings)
    assert all("In(gram" in s or "EqualTo(gram" in s for s in postings)
    texts = [s for s in scans if "text" in s.split("ReadSchema")[1]]
    assert texts and all("dynamicpruning" in s for s in texts)


def test_index_of_nothing(spark):
    index = search_index.build(spark.createDataFrame([], "key long, text string"), "key", "text")
    assert search_index.find(spark, index, ["", "a", "abc"]).count() == 0
