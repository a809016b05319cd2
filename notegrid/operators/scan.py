"""Scans along each key's rows in order, whatever share of the rows a key has.

Rows are dealt out by ranges of (key, order), so a key of very many rows is several tasks and a range holds a stretch of each
of its keys. What a stretch does to the state that enters it is a small summary, and summaries compose. A state enters a range
for one key at most, its first, and leaves it for one, its last: what is handed on is a row a range, and broadcast.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.sources.tables import stored

#: Share of the way to the target that a step goes.
RATE = 0.18
#: Rows of a range on average, at most.
RANGE_ROWS = 250_000


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df dealt out by ranges of key and order and sorted; rows of a null key are left out. Ranges have RANGE_ROWS rows on
    average at most, and there are at least as many as shuffles have partitions."""
    rows = df.where(F.col(key).isNotNull())
    many = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    return rows.repartitionByRange(many, key, *order).sortWithinPartitions(key, *order)


def stretches(keys: pd.Series) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    cuts = [*keys.ne(keys.shift()).to_numpy().nonzero()[0].tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False))


def smoothed(df: DataFrame, key: str, order: list[str], target: str, rate: float = RATE, start: float = 0.0, name: str = "smoothed") -> DataFrame:
    """df with, for every row, its key's state after it: ``state + (target - state) * rate``, from start, in order.

    A step is the affine map ``(1 - rate) * state + rate * target``, and so is a stretch of them, ``a * state + b``. Ranges are
    reduced to the map of their last key, the maps of a key that goes on are composed in order, and rows are finished with the
    state that enters their range. A null target leaves the state as it is; rows of a null key are left out; rows that are
    equal in order go by their target.
    """
    known = df.columns
    rows = ranged(df, key, *order, target).withColumn("_id", F.monotonically_increasing_id())
    # the number of the range and, in the lower 33 bits, the row's number in it
    rows = stored(rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_target", F.col(target).cast("double")))
    kind = df.schema[key].dataType.simpleString()

    def follow(state: float, values: list[float | None]) -> list[float]:
        return list(accumulate(values, lambda now, x: now + (x - now) * rate if x is not None and x == x else now, initial=state))[1:]

    def reduce(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_id")
        s, e = stretches(b[key])[-1]
        values = b["_target"].iloc[s:e].tolist()
        # of the only key the state that enters is not known yet; it is taken in by a
        a = (1 - rate) ** sum(x is not None and x == x for x in values) if s == 0 else 0.0
        return pd.DataFrame([(b["_part"].iloc[0], b[key].iloc[0], b[key].iloc[-1], a, follow(0.0 if s == 0 else start, values)[-1])], columns=["part", "first", "last", "a", "b"])

    maps = stored(rows.select("_part", "_id", key, "_target").groupBy("_part").applyInPandas(reduce, f"part long, first {kind}, last {kind}, a double, b double"))
    # a row a range: a range of one key goes on with the state that the range before leaves it
    chain = Window.partitionBy("last").orderBy("part")
    maps = maps.withColumn("maps", F.collect_list(F.struct("a", "b")).over(chain))
    maps = maps.withColumn("leaves", F.aggregate("maps", F.lit(float(start)), lambda state, m: m["a"] * state + m["b"]))
    before = Window.orderBy("part")
    goes_on = F.lag("last").over(before) == F.col("first")
    enters = maps.select(F.col("part").alias("_part"), F.when(goes_on, F.lag("leaves").over(before)).otherwise(F.lit(float(start))).alias("_enters"))

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_id")
        values, out, state = b["_target"].tolist(), [], b["_enters"].iloc[0]
        for s, e in stretches(b[key]):
            out += follow(state, values[s:e])
            state = start
        return b[known].assign(**{name: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.join(F.broadcast(enters), "_part").groupBy("_part").applyInPandas(finish, f"{schema}, `{name}` double")
