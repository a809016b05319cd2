"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

Words of both sides are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z become a-z. An item's windows are its runs
of 10 words, or its whole text if shorter. A window is contained in a document only if its rarest word is, so that one
word is the window's necessary prefix: document words join windows on it, rarity being the word's count over all
documents. The place of the word in the window bounds the place in the document, and the words there must be equal.

Items are broadcast while their windows' words take at most ``MOST_BROADCAST`` bytes. Beyond that the same join shuffles
document words, never whole texts: those that some window has meet the windows' rarest words, and each candidate's words are
then counted where they must stand.

Defined results: null and wordless texts have no words; wordless items have no windows; equal windows of several items
are hits of each; repeated doc_id rows are each returned, with the hits of their own text; null item_ids count as one item
in n_items, but give no name to items_sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import materialize

WINDOW = 10
MOST_BROADCAST = 64_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words in order. Pure ASCII takes lower(), which is much faster than translate() and equal there."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, words, item_id): every window of every item, with the number of its words' array."""
    w = items.select(F.col("item_id"), word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, from, size, items): windows found in documents, with the row key of docs."""
    spark = docs.sparkSession
    windows = item_windows(items, window).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    windows = materialize(windows, "windows")
    # a string of an array takes about 24 bytes beside its characters
    held = windows.agg(F.coalesce(F.sum(F.octet_length(F.array_join("words", "")) + 24 * F.size("words")), F.lit(0))).first()[0]
    small = held <= MOST_BROADCAST
    near = F.broadcast if small else (lambda df: df)

    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    # outer forms of explode: the plain ones add a filter that would extract every word twice
    words = docs.select(F.explode_outer(word_array(F.col("text"))).alias("word"))
    counts = materialize(words.join(near(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n")), "rarity")
    placed = windows.select("words", "items", "unnamed", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("word"), F.col("place")))
    prefix = placed.groupBy("words", "items", "unnamed").agg(rarest.alias("r")).select("items", "unnamed", F.col("words").alias("want"), F.col("r.word").alias("word"), F.col("r.place").alias("place"))

    if not small:
        return far(docs, vocabulary, prefix)
    d = docs.select("key", word_array(F.col("text")).alias("have"))
    d = d.select("key", "have", F.posexplode_outer("have").alias("at", "word"))
    fits = (F.col("at") >= F.col("place")) & (F.col("at") - F.col("place") + F.size("want") <= F.size("have"))
    equal = F.when(fits, F.slice("have", F.greatest(F.lit(1), F.col("at") - F.col("place") + 1), F.size("want")) == F.col("want")).otherwise(False)
    found = d.join(near(prefix), (d["word"] == prefix["word"]) & equal)
    return found.select("key", (F.col("at") - F.col("place")).alias("from"), F.size("want").alias("size"), "items", "unnamed")


def far(docs: DataFrame, vocabulary: DataFrame, prefix: DataFrame) -> DataFrame:
    """scan() where windows are too many to broadcast: all sides are dealt out by words and places."""
    words = docs.select("key", F.posexplode(word_array(F.col("text"))).alias("at", "word"))
    words = materialize(words.join(vocabulary, "word", "left_semi"), "words").distinct()  # equal rows have equal keys
    windows = prefix.withColumn("win", F.xxhash64("want")).withColumn("win2", F.xxhash64(F.lit(1), "want"))
    met = words.join(windows.select("word", "place", "win", "win2"), "word").where("at >= place").select("key", (F.col("at") - F.col("place")).alias("from"), "win", "win2")
    spelled = windows.select("win", "win2", F.size("want").alias("size"), F.posexplode("want").alias("i", "word"))
    asked = met.join(spelled, ["win", "win2"]).select("key", "from", "win", "win2", "size", (F.col("from") + F.col("i")).alias("at"), "word")
    whole = asked.join(words, ["key", "at", "word"]).groupBy("key", "from", "win", "win2", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.join(windows.select("win", "win2", "items", "unnamed"), ["win", "win2"]).select("key", "from", "size", "items", "unnamed")


def row_key() -> Column:
    """What flag() decides for: a doc_id and a text."""
    return F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("of"))


def flag(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    return flagged(docs, items, window).drop("key")


def flagged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """flag() with the key of each row."""
    keyed = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", row_key())
    hits = scan(keyed.select("key", "text"), items.select("item_id", F.col("text").cast("string").alias("text")), window)
    ends = hits.groupBy("key", "from").agg(F.max("size").alias("size"), F.collect_set("items").alias("items"), F.max("unnamed").alias("unnamed"))
    ends = ends.withColumn("items", F.array_distinct(F.flatten("items")))
    per = ends.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("from", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("unnamed").alias("unnamed")
    )
    # words covered by spans in order: each adds what lies beyond the furthest end so far
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    grown = F.aggregate("spans", start, lambda acc, s: F.struct((acc["sum"] + F.greatest(F.lit(0), s["from"] + s["size"] - F.greatest(acc["end"], s["from"]))).alias("sum"), F.greatest(acc["end"], s["from"] + s["size"]).alias("end")))
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    per = per.select("key", grown["sum"].cast("long").alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"))
    counted = keyed.select("doc_id", F.col("key").alias("row"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(per, counted["row"].eqNullSafe(per["key"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast(T.LongType())).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast(T.LongType())).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.col("row").alias("key"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs whose text holds no window of an item."""
    bad = flagged(docs, items, window).where("contaminated").select(F.col("key").alias("bad_key")).distinct()
    return docs.join(bad, row_key().eqNullSafe(bad["bad_key"]), "left_anti")
