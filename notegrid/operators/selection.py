"""The compare selection: at most two items, first in first out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.operators.ordering import last_two
from notegrid.operators.scan import ranged
from notegrid.sources.tables import stored


def add(selection: Column, item: Column) -> Column:
    """Unchanged if the item is selected already; otherwise appended, and the last two stay."""
    return F.when(F.array_contains(selection, item), selection).otherwise(last_two(F.concat(selection, F.array(item))))


def remove(selection: Column, item: Column) -> Column:
    return F.array_remove(selection, item)


def arity(selection: Column) -> Column:
    n = F.size(selection)
    return F.when(n == 0, "empty").when(n == 1, "pending").otherwise("compared")


def step(selection: tuple[str, ...], item: str) -> tuple[str, ...]:
    return selection if item in selection else (*selection, item)[-2:]


class Stretch:
    """What some items do to any selection that meets them.

    An item that follows itself changes nothing. After three others every selection consists of these items, whatever it was, so
    three items and the ends of the few selections that they can lead to say all.
    """

    def __init__(self) -> None:
        self.items: list[str] = []
        self.ends: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.last: str | None = None

    def add(self, item: str) -> None:
        if item == self.last:
            return
        self.last = item
        if len(self.items) == 3:
            self.ends = {s: step(now, item) for s, now in self.ends.items()}
            return
        self.items.append(item)
        if len(self.items) == 3:
            # items of any selection that are none of the three behave alike: two of them stand for all
            some = [*dict.fromkeys(self.items), object(), object()]
            for start in ((), *((x,) for x in some), *((x, y) for x in some for y in some if x is not y)):
                state = follow(start, self.items)
                self.ends[state] = state


def follow(selection: tuple[str, ...], items: list[str]) -> tuple[str, ...]:
    for x in items:
        selection = step(selection, x)
    return selection


def fold(events: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(key, selection): every key's selection, an array, after its items in order; null items change nothing.

    Rows are dealt out by ranges of key and order, so a key of very many rows is several tasks, each of which streams over its
    rows. A range's first key may go on from the range before: what its items do to any selection is a Stretch. Only the first
    and last key of a range are put together, a few values each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, state, began, stretch, first, part = None, (), False, Stretch(), True, 0

        def row(edge: bool) -> tuple:
            ends = stretch.ends if first else {}
            return key_now, part, edge, list(state), stretch.items if first else None, [list(s) for s in ends], [list(s) for s in ends.values()]

        for b in batches:
            done = []
            for k, x, part in zip(b["key"], b["item"], b["part"], strict=True):  # noqa: B007
                if not began or k != key_now:
                    if began:
                        done.append(row(first))
                        first = False
                    key_now, state, began = k, (), True
                if x is not None:
                    state = step(state, x)
                    if first:
                        stretch.add(x)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if began:
            yield pd.DataFrame([row(True)], columns=columns)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        state: tuple[str, ...] = ()
        for r in rows.sort_values("part").itertuples():
            if r.items is None:  # the key begins in this range
                state = tuple(r.selection)
            else:
                state = follow(state, list(r.items))
                state = dict(zip(map(tuple, r.starts), map(tuple, r.ends), strict=True)).get(state, state)
        return pd.DataFrame([(rows["key"].iloc[0], list(state))], columns=["key", "selection"])

    columns = ["key", "part", "edge", "selection", "items", "starts", "ends"]
    rows = events.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(item).cast("string").alias("item"))
    kind = dict(rows.dtypes)["key"]
    ordered = ranged(rows, "key", *[f"o{i}" for i in range(len(order))]).select("key", "item", F.spark_partition_id().alias("part"))
    found = ordered.mapInPandas(run, f"key {kind}, part int, edge boolean, selection array<string>, items array<string>, starts array<array<string>>, ends array<array<string>>")
    found = stored(found)
    # two keys a range at most
    edges = found.where("edge").groupBy("key").applyInPandas(join, f"key {kind}, selection array<string>")
    return found.where("not edge").select("key", "selection").unionByName(edges).withColumnRenamed("key", key)
