"""Stored lists of nearest neighbours, kept current as rows are added, altered and removed.

A change touches few lists. An altered row joins the list of an anchor only if it comes before the last of that list, and only
lists that held a row that is gone or altered can lose one. So rows of the change are broadcast in blocks, as queries are
elsewhere, and anchors stay where they are; each anchor keeps the few of them that beat its last. With what is left of its list
they decide it: every row that is neither in the list nor in the change comes after the list's last. Only anchors of whose lists
too little is left are searched anew, as are those that the change itself brings.

Lists are stored one row an anchor, in parts by the anchor's number; a refresh writes anew those parts that hold an altered list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrid.operators.related import _PACKED, DEFAULT_K, QUERIES, ROWS, SAME_CATEGORY_BONUS, TOGETHER, _pack, _unpack, nearest, related
from notegrid.sources.tables import new_path, stored

#: Anchors of a part on average.
PART_ANCHORS = 4096
_NEAR = "array<struct<score:double,key:long,distance:double>>"


@dataclass(frozen=True)
class Lists:
    """Where the lists are, in how many parts, and what they were made with."""

    path: str
    parts: int
    key: str
    profile: str
    category: str
    k: int
    bonus: float

    def part_of(self, query: Column) -> Column:
        return F.pmod(F.xxhash64(query), F.lit(self.parts)).cast("int")

    def by_anchor(self, spark: SparkSession) -> DataFrame:
        """(query, near): every anchor with its list, best first."""
        rows = spark.read.schema(f"query long, near {_NEAR}, part int").parquet(self.path)
        return rows.where("query is not null").select("query", "near")  # a part that lost all its anchors holds one empty row

    def ranked(self, spark: SparkSession) -> DataFrame:
        """(query, rank from 1, key, distance, score), as related() gives."""
        rows = self.by_anchor(spark).select("query", F.posexplode("near").alias("at", "n"))
        return rows.select("query", (F.col("at") + 1).alias("rank"), "n.key", "n.distance", "n.score")


@dataclass(frozen=True)
class Refreshed:
    """How many lists a refresh wrote with other contents, removed, and searched anew, and how many parts it wrote."""

    altered: int
    removed: int
    searched: int
    parts: int


def _columns(df: DataFrame, key: str, profile: str, category: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(profile).cast("array<double>").alias("profile"), F.col(category).cast("string").alias("category"))
    return rows.where("key is not null and profile is not null")


def _lists(rows: DataFrame, anchors: DataFrame, k: int, bonus: float) -> DataFrame:
    """(query, near) of each anchor, those without any neighbour too."""
    found = related(rows, anchors, "key", "profile", "category", k, bonus)
    near = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "key", "distance"))).alias("near"))  # k at most
    empty = F.array().cast(_NEAR)
    return anchors.select(F.col("key").alias("query")).join(near, "query", "left").select("query", F.coalesce("near", empty).alias("near"))


def build(rows: DataFrame, anchors: DataFrame, key: str, profile: str, category: str, k: int = DEFAULT_K, bonus: float = SAME_CATEGORY_BONUS) -> Lists:
    """Search and store the lists of all anchors, which are rows of ``rows``.

    Keys are unique; rows with a null key or profile take no part, nor are they anchors; a null category is like no other.
    Ties go by the key. An anchor without other rows has an empty list.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = _columns(anchors, key, profile, category)
    lists = Lists(new_path(rows.sparkSession), max(1, -(-asked.count() // PART_ANCHORS)), key, profile, category, k, bonus)
    found = _lists(_columns(rows, key, profile, category), asked, k, bonus).withColumn("part", lists.part_of(F.col("query")))
    found.repartition(lists.parts, "part").write.partitionBy("part").parquet(lists.path)
    return lists


def arrivals(anchors: DataFrame, fresh: DataFrame, k: int, bonus: float) -> DataFrame:
    """(query, score, key, distance): of the fresh rows those that come before the last of an anchor's list, at most k of each
    block of them. anchors: key, profile, category, and last_score and last_key, null where a list is not full."""
    size = fresh.agg(F.count("*"), F.max(F.size("profile"))).first()
    blocks, rounds = max(1, -(-size[0] // QUERIES)), max(1, -(-size[0] * (8 * (size[1] or 0) + 64) // TOGETHER))

    def pack_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), ROWS):
                own = b[s : s + ROWS]
                yield pd.DataFrame([{**_pack(own), "scores": own["last_score"].fillna(float("inf")).to_numpy(), "lasts": own["last_key"].fillna(0).astype("int64").to_numpy()}])

    def pack_fresh(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": b["block"].iloc[0], **_pack(b)}])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                found = nearest(_unpack(r.keys, r.categories, r.profiles), _unpack(r.f_keys, r.f_categories, r.f_profiles), k, bonus)
                last = pd.DataFrame({"query": r.keys, "score_": r.scores, "key_": r.lasts})
                found = found.merge(last, on="query")
                yield found[(found["score"] < found["score_"]) | ((found["score"] == found["score_"]) & (found["key"] < found["key_"]))][["query", "score", "key", "distance"]]

    # nulls of whole numbers reach pandas as floats, which do not hold every long: they go as 0, beside an infinite score
    packed = anchors.withColumn("last_key", F.coalesce("last_key", F.lit(0).cast("long"))).mapInPandas(pack_anchors, f"{_PACKED}, scores array<double>, lasts array<long>")
    came = fresh.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInPandas(pack_fresh, f"block long, {_PACKED}")
    came = came.select("block", *[F.col(c).alias(f"f_{c}") for c in ("keys", "categories", "profiles")])
    best = None
    for n in range(rounds):
        numbers = F.sequence(F.lit(n).cast("long"), F.lit(max(blocks - 1, n)).cast("long"), F.lit(rounds).cast("long"))
        met = packed.withColumn("block", F.explode(numbers)).join(F.broadcast(came.where(F.pmod("block", F.lit(rounds)) == n)), "block")
        found = met.mapInPandas(compare, "query long, score double, key long, distance double")
        best = found if best is None else best.unionByName(found)
    return best


def refresh(lists: Lists, rows: DataFrame, anchors: DataFrame, changed: DataFrame) -> Refreshed:
    """Bring stored lists to what build() would give for rows and anchors as they are now.

    changed: a column ``key`` with the keys of all rows that were added, altered or removed since (repeats and keys that are
    nowhere do no harm). An anchor that is new, or is one no longer, need not be named in it.
    """
    spark, k = rows.sparkSession, lists.k
    data, asked = (_columns(d, lists.key, lists.profile, lists.category) for d in (rows, anchors))
    gone = stored(changed.select(F.col("key").cast("long").alias("key")).where("key is not null").distinct())
    fresh = stored(data.join(gone, "key", "left_semi"))
    old = lists.by_anchor(spark)
    same = asked.join(gone, "key", "left_anti").join(old.withColumnRenamed("query", "key"), "key")  # anchors that have a list and are as they were
    members = same.select(F.col("key").alias("query"), F.explode("near").alias("n"))
    lost = members.join(gone.select(F.col("key").alias("_gone")), F.col("n.key") == F.col("_gone")).groupBy("query").agg(F.collect_set("_gone").alias("lost"))  # k at most
    full = F.size("near") >= k
    last = F.element_at("near", -1)
    edges = same.select("key", "profile", "category", F.when(full, last["score"]).alias("last_score"), F.when(full, last["key"]).alias("last_key"))
    order = Window.partitionBy("query").orderBy("score", "key")
    best = arrivals(edges, fresh, k, lists.bonus).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    came = best.groupBy("query").agg(F.collect_list(F.struct("score", "key", "distance")).alias("came"))  # k at most
    none = F.array().cast(_NEAR)
    pool = same.select(F.col("key").alias("query"), "near").join(lost, "query", "left").join(came, "query", "left").where("lost is not null or came is not null")
    left = F.filter("near", lambda n: ~F.coalesce(F.array_contains("lost", n["key"]), F.lit(False)))
    merged = F.slice(F.sort_array(F.concat(left, F.coalesce("came", none))), 1, k)
    # rows that are not in the pool come after the old list's last, if that list was full
    decided = stored(pool.select("query", F.col("near").alias("old"), merged.alias("near"), (~full | (F.size(merged) >= k)).alias("done")))
    waiting = decided.where("not done").select(F.col("query").alias("key"))
    unlisted = asked.join(same.select("key"), "key", "left_anti").select("key")
    again = stored(asked.join(waiting.unionByName(unlisted), "key", "left_semi"))
    searched = _lists(data, again, k, lists.bonus)
    # an altered row may keep its place: such a list is not written
    new = stored(decided.where("done and near != old").select("query", "near").unionByName(searched))
    removed = old.join(asked.select(F.col("key").alias("query")), "query", "left_anti").select("query")
    parts = stored(new.select("query").unionByName(removed).select(lists.part_of(F.col("query")).alias("part")).distinct())
    counts = Refreshed(new.count(), removed.count(), again.count(), parts.count())
    if counts.parts:
        own = old.withColumn("part", lists.part_of(F.col("query"))).join(parts, "part", "left_semi")
        kept = own.join(new.select("query").unionByName(removed), "query", "left_anti").select("query", "near", "part")
        marks = parts.select(F.lit(None).cast("long").alias("query"), none.alias("near"), "part")
        # staged first: a table is not overwritten by what reads it
        whole = stored(kept.unionByName(new.withColumn("part", lists.part_of(F.col("query")))).unionByName(marks))
        whole.repartition(lists.parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(lists.path)
    return counts
