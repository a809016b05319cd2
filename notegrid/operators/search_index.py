"""Substring search over stored postings: which of very many texts hold a term, without reading the texts.

``build`` normalises every text once and stores three tables: the texts, in chunks by key; postings, which say for every three
characters in a row (a gram) which keys have it; and the grams with the number of their keys. ``find`` takes the rarest grams of
a term, intersects their postings, and reads only those chunks of the texts in which candidates lie, to see whether the term
is there as a whole.

Defined results: a term is normalised as texts are; one that normalises to nothing is in every text; one of one or two characters
is in the texts of the grams that hold it (a text of fewer than three characters counts as a gram itself). A null text is
empty; a null key is found like any other; keys that repeat are found once for each of their rows that match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrid.functions import normalize_term
from notegrid.sources.tables import new_path

#: Characters of a gram, grams of a term that are looked up at most (the others are left to the last look at the text).
GRAM, LOOKED_UP = 3, 6
#: Characters of texts whose postings are put together in a task, texts of a chunk, chunks for each part of the postings.
TOGETHER, CHUNK_ROWS, PART_CHUNKS = 1 << 23, 4096, 1


@dataclass(frozen=True)
class Index:
    """Paths of the three tables, in how many chunks the texts are and in how many parts the postings."""

    texts: str
    postings: str
    grams: str
    chunks: int
    parts: int


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} or ({text} if text else set())


def build(df: DataFrame, key: str, text: str) -> Index:
    """Normalise and store the texts of df, and their postings."""
    spark = df.sparkSession
    chunks = max(1, -(-df.count() // CHUNK_ROWS))
    index = Index(new_path(spark), new_path(spark), new_path(spark), chunks, max(8, chunks // PART_CHUNKS))
    rows = df.select(F.col(key).cast("long").alias("key"), normalize_term(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", F.md5("text")), F.lit(chunks)).cast("int"))
    # a row's number in its chunk tells rows of one key apart; a chunk has CHUNK_ROWS rows on average
    number = F.row_number().over(Window.partitionBy("chunk").orderBy("key"))
    rows.repartition(chunks, "chunk").withColumn("row", number).write.partitionBy("chunk").option("compression", "zstd").parquet(index.texts)
    arrow = pa.schema([("gram", pa.string()), ("chunk", pa.int32()), ("rows", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        size, now = 0, -1

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([now] * len(held), pa.int32()), pa.array(list(held.values()), arrow.field("rows").type)], schema=arrow)

        for b in batches:
            for chunk, row, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (chunk != now or size > TOGETHER):
                    yield done()
                    held, size = {}, 0
                now = chunk
                for g in grams_of(words):
                    held.setdefault(g, []).append(row)
                size += len(words)
        if held:
            yield done()

    postings = texts_of(spark, index).select("chunk", "row", "text").mapInArrow(run, "gram string, chunk int, rows array<int>")
    postings = postings.withColumn("part", part_of(F.col("gram"), index))
    postings.repartition(index.parts, "part").sortWithinPartitions("part", "gram").write.partitionBy("part").option("compression", "zstd").parquet(index.postings)
    counts = postings_of(spark, index).groupBy("part", "gram").agg(F.sum(F.size("rows")).alias("n"))
    counts.repartition(index.parts, "part").sortWithinPartitions("part", "gram").write.partitionBy("part").option("compression", "zstd").parquet(index.grams)
    return index


def part_of(gram: Column, index: Index) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(index.parts)).cast("int")


def texts_of(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema("key long, text string, row int, chunk int").parquet(index.texts)


def postings_of(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema("gram string, chunk int, rows array<int>, part int").parquet(index.postings)


def normalised(spark: SparkSession, terms: list[str]) -> list[str]:
    """The terms as texts are normalised."""
    rows = spark.createDataFrame(list(enumerate(terms)), "i int, term string").select("i", normalize_term(F.col("term")).alias("term"))
    return [r["term"] for r in sorted(rows.collect(), key=lambda r: r["i"])]  # a row a term


def chosen(spark: SparkSession, index: Index, terms: list[str]) -> dict[str, list[str]]:
    """The rarest grams of each term of three characters or more; none where a gram of it is in no text."""
    wanted = {g for t in terms for g in grams_of(t)}
    if not wanted:
        return {}
    parts = spark.createDataFrame([(g,) for g in sorted(wanted)], "gram string").select("gram", part_of(F.col("gram"), index).alias("part")).collect()
    table = spark.read.schema("gram string, n long, part int").parquet(index.grams)
    own = table.where(F.col("part").isin(sorted({r["part"] for r in parts})) & F.col("gram").isin(sorted(wanted)))
    n = {r["gram"]: r["n"] for r in own.select("gram", "n").collect()}  # at most a row for each gram of the terms
    return {t: sorted(grams_of(t), key=lambda g: (n[g], g))[:LOOKED_UP] if all(g in n for g in grams_of(t)) else [] for t in terms}


def find(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """(q, key): every term, as it was given, with the key of every row whose text holds it."""
    plain = dict(zip(terms, normalised(spark, terms), strict=True))
    found = [spark.createDataFrame([], "q string, key long")]
    everywhere = [q for q, t in plain.items() if not t]
    if everywhere:
        found.append(texts_of(spark, index).select(F.explode(F.array(*map(F.lit, everywhere))).alias("q"), "key"))
    short = {q: t for q, t in plain.items() if 0 < len(t) < GRAM}
    if short:
        # the gram holds the term, so the text does
        hits = F.filter(F.array(*[F.when(F.contains("gram", F.lit(t)), F.lit(q)) for q, t in short.items()]), lambda x: x.isNotNull())
        rows = postings_of(spark, index).select(F.explode(hits).alias("q"), "chunk", "rows").select("q", "chunk", F.explode("rows").alias("row")).distinct()
        found.append(rows.join(texts_of(spark, index).select("key", "row", "chunk"), ["chunk", "row"]).select("q", "key"))
    long = {q: t for q, t in plain.items() if len(t) >= GRAM}
    grams = {t: g for t, g in chosen(spark, index, list(long.values())).items() if g}
    asked = [(q, t, g, len(grams[t])) for q, t in long.items() if t in grams for g in grams[t]]
    if asked:
        # as many rows as the terms have chosen grams
        terms_ = spark.createDataFrame(asked, "q string, term string, gram string, all int").withColumn("part", part_of(F.col("gram"), index))
        parts = sorted({r["part"] for r in terms_.select("part").distinct().collect()})
        own = postings_of(spark, index).where(F.col("part").isin(parts) & F.col("gram").isin(sorted({a[2] for a in asked})))
        rows = own.join(F.broadcast(terms_.drop("part")), "gram").select("q", "term", "all", "chunk", F.explode("rows").alias("row"))
        candidates = rows.groupBy("q", "term", "all", "chunk", "row").agg(F.count("*").alias("n")).where("n = all").select("q", "term", "chunk", "row")
        # at most a number for each chunk of the texts: the other chunks are not read
        texts = texts_of(spark, index).join(F.broadcast(candidates.select("chunk").distinct()), "chunk", "left_semi")
        found.append(candidates.join(texts, ["chunk", "row"]).where(F.contains("text", "term")).select("q", "key"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
