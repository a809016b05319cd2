"""Nearest neighbours: the k rows of the smallest key, distance less a bonus for the same category, for each query row.

Query rows are a stated set and travel as blocks, some of them at a time by a broadcast of bounded size. Rows stay where they
are, packed; a task keeps the k best of its rows for each query, and those are all that is shuffled.

Rows of one profile and category tie for every query, so the first k of them by key, one more for a query that is among them,
decide what all of them give. Where profiles recur, only those meet the queries; they travel then, and the queries stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAME_CATEGORY_BONUS, DEFAULT_K = -2.0, 4
#: Query rows of a block, rows of a block at most, and how many queries are compared with a block of rows at once.
QUERIES, ROWS, AT_ONCE = 1024, 8192, 64
#: Bytes of queries that are broadcast together.
TOGETHER = 64_000_000
_PACKED = "keys array<long>, categories array<string>, profiles binary"


def _pack(rows: pd.DataFrame) -> dict:
    return {"keys": rows["key"].to_numpy(), "categories": rows["category"].to_numpy(), "profiles": np.array(rows["profile"].tolist(), np.float64).tobytes()}


def _unpack(keys, categories, profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(keys, np.int64), np.asarray(categories, object), np.frombuffer(profiles, np.float64).reshape(len(keys), -1)


def nearest(asked: tuple, rows: tuple, k: int, bonus: float) -> pd.DataFrame:
    """The k best of some rows for each of some queries; squares are added from left to right."""
    found = []
    (q_key, q_category, q), (key, category, x) = asked, rows
    present = pd.notna(category)
    for s in range(0, len(q_key), AT_ONCE):
        own = slice(s, s + AT_ONCE)
        total = np.zeros((len(q_key[own]), len(key)))
        for d in range(x.shape[1]):
            step = x[None, :, d] - q[own, d, None]
            total += step * step
        distance = np.sqrt(total)
        scores = np.where((q_category[own, None] == category[None]) & present, bonus, 0.0) + distance
        scores[q_key[own, None] == key[None]] = np.inf
        for i in range(len(scores)):
            use = np.flatnonzero(scores[i] <= np.partition(scores[i], k - 1)[k - 1]) if k < len(key) else np.arange(len(key))
            use = use[np.lexsort((key[use], scores[i][use]))][:k]
            use = use[np.isfinite(scores[i][use])]
            found.append((np.full(len(use), q_key[s + i]), key[use], distance[i][use], scores[i][use]))
    return pd.DataFrame(dict(zip(("query", "key", "distance", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def deciding(data: DataFrame, k: int) -> DataFrame:
    """Of the rows of each profile and category those that can be among the k nearest of a query: of the first k + 1 keys, k rows
    each. Every task drops the others before the shuffle."""
    alike, order = ("profile", "category"), Window.partitionBy("profile", "category").orderBy("key")
    first = data.withColumn("_nth", F.dense_rank().over(order)).where(F.col("_nth") <= k + 1)
    return first.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike, "key").orderBy("_nth"))).where(F.col("_nth") <= k).drop("_nth")


def related(rows: DataFrame, queries: DataFrame, key: str, profile: str, category: str, k: int = DEFAULT_K, bonus: float = SAME_CATEGORY_BONUS) -> DataFrame:
    """(query, rank from 1, key, distance, score) of the k nearest rows of other keys for each row of queries.

    Ties go by the row's key. profile: an array of numbers, all of one length, in double precision. Rows with a null profile
    take no part. Fewer than k rows give fewer; k = 0 gives none.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    columns = [F.col(key).cast("long").alias("key"), F.col(profile).cast("array<double>").alias("profile"), F.col(category).cast("string").alias("category")]
    asked = queries.select(*columns).where("profile is not null")
    data = rows.select(*columns).where("profile is not null")
    size = asked.agg(F.count("*"), F.max(F.size("profile"))).first()
    # how many profiles there are decides only how the rows are found
    rows_, alike = data.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("profile", "category"))).first()
    recur = alike * (k + 1) * 2 < min(rows_, 2 * TOGETHER // (8 * (size[1] or 0) + 64))
    sent, n_sent = (deciding(data, k), alike * (k + 1)) if recur else (asked, size[0])
    blocks = max(1, -(-n_sent // QUERIES))
    rounds = max(1, -(-n_sent * (8 * (size[1] or 0) + 64) // TOGETHER))

    def pack_staying(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), ROWS):
                yield pd.DataFrame([_pack(b[s : s + ROWS])])

    def pack_sent(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": b["block"].iloc[0], **_pack(b)}])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        for b in batches:
            for r in b.itertuples():
                if k:
                    met = _unpack(r.s_keys, r.s_categories, r.s_profiles), _unpack(r.keys, r.categories, r.profiles)
                    found = nearest(*(met[::-1] if recur else met), k, bonus)
                    if recur:  # queries that stay meet a few blocks: k of each go to the window
                        yield found
                        continue
                    if r.block in held:
                        found = pd.concat([held[r.block], found]).sort_values(["query", "score", "key"]).groupby("query").head(k)
                    held[r.block] = found
        yield from held.values()

    packed = (asked if recur else data).mapInPandas(pack_staying, _PACKED)
    wanted = sent.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInPandas(pack_sent, f"block long, {_PACKED}")
    wanted = wanted.select("block", *[F.col(c).alias(f"s_{c}") for c in ("keys", "categories", "profiles")])
    best = None
    for n in range(rounds):
        numbers = F.sequence(F.lit(n).cast("long"), F.lit(max(blocks - 1, n)).cast("long"), F.lit(rounds).cast("long"))
        met = packed.withColumn("block", F.explode(numbers)).join(F.broadcast(wanted.where(F.pmod("block", F.lit(rounds)) == n)), "block")
        found = met.mapInPandas(compare, "query long, key long, distance double, score double")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("query").orderBy("score", "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "distance", "score")
