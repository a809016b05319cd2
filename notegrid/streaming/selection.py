"""The compare selection over a stream of clicks: per key, the state is at most two items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notegrid.operators.selection import step


def selections(events: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """(key, selection) of every key that got items in a micro-batch, after them in order; output mode update."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        selection = tuple(state.get[0]) if state.exists else ()
        rows = pd.concat(list(batches)).sort_values("order", kind="stable")
        for x in rows["item"]:
            if x is not None:
                selection = step(selection, x)
        state.update((list(selection),))
        yield pd.DataFrame({"key": [k[0]], "selection": [list(selection)]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.col(item).cast("string").alias("item"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, selection array<string>", "selection array<string>", "update", GroupStateTimeout.NoTimeout)
