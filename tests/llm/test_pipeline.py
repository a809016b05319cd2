"""The pipeline's stages against brute force on a small input, and the registered queries against their SQL."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notegrid.llm import queries
from test_llm_operators import flags, joined_by_hand

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = {"aa": lambda: "".join(rng.choice(["the", "ing", "st", "ou"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["éa", "que", "ñi"]) for _ in range(3))}
    texts = []
    for i in range(80):
        lang = ("aa", "bb")[i % 2]
        texts.append((" ".join(word[lang]() for _ in range(40)), lang))
    texts[10] = texts[4]
    texts[12] = (texts[4][0] + " the", "aa")
    texts += [("", "aa"), (None, "aa"), ("123 !!", "aa")]
    texts[20] = (texts[20][0] + " token = 'abcdef0123456789'", "aa")
    items = [(1, " ".join(texts[30][0].split()[5:25]))]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left, columns = [(r[0], r[1]) for r in rows], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        if name == "packing":
            break
        assert docs.columns == columns
        if name == "language_id":
            left = [x for x in left if any(c.isalpha() for c in x[1] or "")]
        elif name == "ngram_join":
            left = [x for x, y in zip(left, joined_by_hand(left), strict=True) if y[0] == y[2]]
        elif name == "decontamination":
            left = [x for x, y in zip(left, flags(left, items), strict=True) if not y[5]]
            assert 30 not in [x[0] for x in left] and 10 not in [x[0] for x in left]
        elif name == "secret_scan":
            left = [(i, t if i != 20 else " ".join(t.split()[:40]) + " [secret]'") for i, t in left]
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == left
    assert sorted({r["doc_id"] for r in docs.collect()}) == [x[0] for x in left]
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    d, names = str(tmp_path), ("lang_pred", "score", "_best", "_sum", "row_key", "bad_key", "key", "h1", "spans", "n", "rep", "component_id")
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(i, f"{w} {w}{i} plain text of the row {i}", lang) for i in range(12) for w, lang in (("alpha", "aa"), ("été", "bb"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= len(rows) and all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).where("start = 0").count() == len(rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda df: df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(queries.QUERIES[name](spark, SF).toPandas()), plain(c.execute(queries.SQL[name]).fetchdf()))
