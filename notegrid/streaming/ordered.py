"""The compare selection over a stream whose rows come out of order.

Keys share state in a stated number of buckets, since every call to the store costs more than a key's few rows: of each bucket
the selections of its keys after all rows that the watermark has passed, and the rows behind it that it has not, both as Arrow
data. A row is applied when no earlier one can come any more, in the order of time and number; a timer of event time does that
for buckets that get no further rows. Every micro-batch gives each of its keys' selection after all rows so far, those that wait
included, so its last row of a key is what the batch fold gives. Rows later than the watermark allows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from notegrid.operators.selection import step
from notegrid.sources.tables import new_path

#: The store that typed state and timers need; a setting of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets that keys are dealt to; a stream keeps the number that it began with. Waiting rows of one value of the state.
BUCKETS, CHUNK = 256, 100_000
_WAITING = pa.schema([("key", pa.string()), ("at_ms", pa.int64()), ("number", pa.int64()), ("item", pa.string())])
_SELECTED = pa.schema([("key", pa.string()), ("items", pa.list_(pa.string()))])


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def chunks(rows: pd.DataFrame) -> list[tuple[bytes]]:
    return [(packed(pa.Table.from_pandas(rows[s : s + CHUNK], _WAITING, preserve_index=False)),) for s in range(0, len(rows), CHUNK)]


def applied(now: dict[str, tuple[str, ...]], rows: pd.DataFrame) -> dict[str, tuple[str, ...]]:
    """Selections by key after rows, in order; rows of equal time and number in the order in which they came."""
    rows = rows.sort_values(["at_ms", "number"], kind="stable")
    for key, item in zip(rows["key"], rows["item"], strict=True):
        now[key] = step(now.get(key, ()), item)
    return now


class Selections(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.selection = handle.getValueState("selection", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def settle(self, passed: int, new: pd.DataFrame | None = None) -> tuple[dict[str, tuple[str, ...]], pd.DataFrame]:
        """The selections after the rows at or before that time, and the rows that still wait, the new ones included."""
        found = self.selection.get() if self.selection.exists() else None
        now = {k: tuple(v) for k, v in zip(*unpacked(found[0]).to_pydict().values(), strict=True)} if found else {}
        old = pa.concat_tables([_WAITING.empty_table(), *(unpacked(r[0]) for r in self.waiting.get())]) if self.waiting.exists() else _WAITING.empty_table()
        rows = old.to_pandas()
        done = rows["at_ms"] <= passed
        if done.any():
            now, rows = applied(now, rows[done]), rows[~done]
            self.selection.update((packed(pa.table([list(now), list(map(list, now.values()))], schema=_SELECTED)),))
            left = chunks(rows)
            self.waiting.put(left) if left else self.waiting.clear()
        if new is not None and len(new):
            self.waiting.appendList(chunks(new))
            rows = pd.concat([rows, new]) if len(rows) else new
        return now, rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        came = pd.concat([b[_WAITING.names] for b in rows])
        new = came[came["at_ms"] > passed]
        if len(new):
            self.handle.registerTimer(int(new["at_ms"].max()))
        now, waiting = self.settle(passed, new)
        keys = came["key"].unique().tolist()
        now = applied({k: now.get(k, ()) for k in keys}, waiting[waiting["key"].isin(keys)])
        yield pd.DataFrame({"key": keys, "selection": [list(now[k]) for k in keys]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.settle(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def ordered_selections(events: DataFrame, key: str, time: str, number: str, item: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, selection) of every key of a micro-batch after all its rows so far, by time and then number; update mode.

    delay: how much later than the latest row a row may come. buckets: as long as a checkpoint is gone on from, the same. Rows of null key, time, number or item are left out.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number"), F.col(item).cast("string").alias("item")).dropna()
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Selections(), outputStructType="key string, selection array<string>", outputMode="Update", timeMode="EventTime")


def replayed(events: DataFrame, key: str, time: str, number: str, item: str, slices: int = 5, late: int = 3600) -> DataFrame:
    """(key, selection) after a replay of events as a stream: rows arrive up to late seconds after their time, in as many
    slices; after each the stream goes on from its checkpoint and takes what is there. A row a key, its last one.

    The slices, the checkpoint and the stream's output are written to the session's shared folder. The session's state store is
    that of STORE while the stream runs.
    """
    spark, top = events.sparkSession, new_path(events.sparkSession)
    arrives = F.unix_millis(F.col(time).cast("timestamp")) + F.pmod(F.xxhash64(number, item), F.lit(late * 1000))
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number"), F.col(item).cast("string").alias("item"), arrives.alias("arrives"))
    low, high = rows.agg(F.min("arrives"), F.max("arrives")).first()
    if low is None:
        return rows.select("key", F.array("item").alias("selection")).limit(0)

    def keep(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{top}/out/batch={batch}")  # a batch that is run again replaces itself

    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        for i in range(slices):
            own = F.floor((F.col("arrives") - low) * slices / F.lit(high - low + 1)) == i
            rows.where(own).drop("arrives").write.mode("append").parquet(f"{top}/in")
            stream = spark.readStream.schema("key string, at timestamp, number long, item string").parquet(f"{top}/in")
            out = ordered_selections(stream, "key", "at", "number", "item", f"{late} seconds").writeStream.outputMode("update").option("checkpointLocation", f"{top}/state")
            out.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], was) if was else spark.conf.unset(STORE[0])
    told = spark.read.schema("key string, selection array<string>, batch long").parquet(f"{top}/out")
    return told.groupBy("key").agg(F.max_by("selection", "batch").alias("selection"))
