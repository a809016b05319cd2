"""What the training-data operators share: shared storage, word hashing over Arrow text, and components of a link graph."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: The folder that holds the package.
TOP = str(Path(__file__).resolve().parents[2])


def tune(spark: SparkSession) -> None:
    """Session settings for the operators: workers find this package, shuffle files go when their query ends, text batches
    stay small, and no growing table is broadcast just because it is small here."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if TOP not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [TOP, *paths]))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 25))
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none, as in tests."""
    place = spark.conf.get(CHECKPOINT_DIR, None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    run = spark.sparkContext.applicationId
    if run not in _own_dir:
        _own_dir[run] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir[run]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    if _scratch:
        _scratch[-1].append(back)
    return back


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that materialize() stores within it are deleted at its end, but for those that the given function was called with."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scratch.pop()
        stay = {df.stored_at for df in kept}
        discard(*(df for df in made if df.stored_at not in stay))


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later job reads."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Within it, jobs hand Python at most n rows at a time: for rows that hold texts of many documents."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


#: Keys of more than this share of all rows are joined by broadcast: there are fewer than HOT of them.
HOT = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with a table of unique keys that tells how many of the total rows have each key. Frequent keys, fewer than
    HOT by their share, are broadcast, so that no task gets all rows of one."""
    frequent = F.col(count) * HOT > total
    hot = F.broadcast(table.where(frequent))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~frequent), keys))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return freed memory to the system: Python workers stay, and each would keep the most that it ever used."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- words of whole texts, as 64-bit numbers -------------------------------------------------------------------------

_U = np.uint64
MASK64 = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
#: Two odd bases for the two halves of a 128-bit window number.
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def running(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A number of every n consecutive words: position i is words i .. i+n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = running(h, base)
    return mix((total[n:] - total[:-n]) * powers(inverse(base), m))


@dataclass
class Words:
    """The words of some consecutive rows: bytes start..end of raw, row of the batch, and a 64-bit number each."""

    first: int
    last: int
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    h: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.first, self.last + 1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def words(column: pa.Array, lower: bool = False, size: int = 1 << 20) -> Iterator[Words]:
    """Words [^\\x20\\x09-\\x0D]+ of every row, some whole rows of about size bytes at a time. lower: A-Z count as a-z."""
    data, at = text_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        raw = data[at[i] : at[j]]
        if lower:
            raw = _LOWER[raw]
        cuts = at[i:j] - at[i]
        word = ~_SPACE[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = word[:-1]
        before[cuts[cuts < len(raw)]] = False
        start = np.flatnonzero(word & ~before)
        after = np.zeros(len(raw), bool)
        after[:-1] = word[1:]
        inner = cuts[(cuts > 0)] - 1
        after[inner] = False
        end = np.flatnonzero(word & ~after) + 1
        total = running(raw.astype(np.uint64) + _U(1), BYTE_BASE)
        h = (total[end] - total[start]) * powers(inverse(BYTE_BASE), len(raw) + 1)[start]
        h = mix(h + (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
        row = np.searchsorted(cuts, start, side="right") - 1 + i
        yield Words(i, j, raw, start, end, row, h)
        i = j


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- links -----------------------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. No row for nodes without links.

    Every round takes the smallest label among neighbours and then the label's own label, and writes its labels to the
    shared folder; a star needs one round, a chain of n links about log n.
    """
    both = materialize(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")).where("x <> y")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        step = materialize(nearer.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("top", "mid")).alias("component")), "labels")
        changed = step.where("component <> was").limit(1).count()
        discard(labels)
        labels = step.select("node", "component")
        labels.stored_at = step.stored_at
        if not changed:
            discard(both)
            return labels
