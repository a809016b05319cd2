"""Hard negatives by exact integer inner products in a residue number system.

Components become integers, ``floor(scale * x)``. The product of a block of anchors and a block of rows is computed modulo
several primes, each a float32 matrix product whose sums stay below 2**24 and are therefore exact; the signed products are
put together by Chinese remaindering. How many primes are needed follows from the longest vector: by Cauchy-Schwarz no
product exceeds its squared length.

Rows are packed once into stored blocks. Anchors, the rows that a condition names, are packed too; every block of rows meets
the anchors block by block, as many blocks of anchors at a time as a broadcast of ``TOGETHER`` bytes holds, so that rows are
never shuffled and no pairs are written. A task keeps, over all its blocks of rows, only what the selection needs:

1. of each anchor the ``positives`` best other rows of its label;
2. with their scores known, of each anchor and positive the ``negatives`` best rows of other labels in the window
   ``low * score <= 100 * negative score <= high * score``.

Defined results: a row with a null label or vector, or with a null or non-finite component, takes no part; neither does a
vector of a squared length beyond 2**62 (no long holds its products). Shorter vectors count as filled up with zeros. Of rows
that repeat an anchor's key the one of the smallest label, then vector, is the anchor; no row of an anchor's own key is its
positive or negative; other repeated rows count each. Rows of a null key take no part. Ties go by the smaller key. An anchor
without positives, or a positive without rows in its window, gives no rows, as does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import arrow_rows, batch, give_back, materialize, scratch

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Anchors of a block on average, rows of a block at most, anchors that are multiplied with a block at once.
ANCHORS, ROWS, AT_ONCE = 2048, 4096, 256
#: Blocks of rows of a task: it gives at most `positives` rows for each anchor, however many blocks it has.
A_TASK = 16
#: Bytes of blocks of anchors that are broadcast together.
TOGETHER = 64_000_000
#: Products of residues are summed exactly in float32 below this.
EXACT = 1 << 24
MOST_SQUARE = float(1 << 62)
_BLOCK = "n long, dims long, most double, keys array<long>, labels array<string>, vectors binary"
_ARROW = pa.schema([("n", pa.int64()), ("dims", pa.int64()), ("most", pa.float64()), ("keys", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary())])


def primes(bound: int) -> list[int]:
    """Primes below 512, the largest first, that tell all numbers from -bound to bound apart, the last digit being signed."""
    sieve = [p for p in range(3, 512, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    out, product = [sieve.pop()], 1
    while product * (out[-1] - 1) <= 2 * bound + 1:
        product *= out[-1]
        out.append(sieve.pop())
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of x modulo p between -p/2 and p/2, as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residues(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p from residues a and b, exact: sums are reduced before they reach EXACT."""
    step = max(1, (EXACT - 1) // (p // 2) ** 2)
    out = None
    for s in range(0, a.shape[1], step):
        part = np.mod(a[:, s : s + step] @ b[:, s : s + step].T, np.float32(p))
        out = part if out is None else np.mod(out + part, np.float32(p))
    return np.zeros((len(a), len(b)), np.int64) if out is None else out.astype(np.int64)


class Product:
    """Exact products of one block of rows with anchors."""

    def __init__(self, rows: np.ndarray, moduli: list[int]) -> None:
        self.moduli = moduli
        self.rows = [centred(rows, p) for p in moduli]

    def of(self, anchors: np.ndarray) -> np.ndarray:
        """The signed products: residues joined prime by prime (mixed radix), the upper half of their range being negative."""
        total, product = None, 1
        for p, rows in zip(self.moduli, self.rows, strict=True):
            r = residues(centred(anchors, p), rows, p)
            if total is None:
                total = r
            else:
                digit = (r - total) % p * pow(product, -1, p) % p
                # the last digit is signed, and so is the number
                if p == self.moduli[-1]:
                    digit = np.where(digit > p // 2, digit - p, digit)
                total = total + product * digit
            product *= p
        if len(self.moduli) == 1:
            total = np.where(total > product // 2, total - product, total)
        return total


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components filled up with zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.asarray(column.offsets.to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # null is NaN
    there = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    size = np.where(there, offsets[1:] - offsets[:-1], 0)
    out = np.zeros((n, int(size.max()) if n else 0))
    row = np.repeat(np.arange(n), size)
    within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, within] = values[np.repeat(offsets[:-1], size) + within]
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.floor(out * scale)
        use = there & np.isfinite(out).all(axis=1)
        use &= np.where(use, (np.where(use[:, None], out, 0) ** 2).sum(axis=1), np.inf) <= MOST_SQUARE
    return use, out[use].astype(np.int64)


def packed(keys: np.ndarray, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    most = float((vectors.astype(np.float64) ** 2).sum(axis=1).max()) if len(vectors) else 0.0
    kind = next(k for k in (np.int16, np.int32, np.int64) if not vectors.size or max(abs(int(vectors.min())), int(vectors.max())) <= np.iinfo(k).max)
    raw = np.array([np.dtype(kind).itemsize], "<i8").tobytes() + np.ascontiguousarray(vectors, kind).tobytes()
    return batch(_ARROW, [len(keys)], [vectors.shape[1]], [most], pa.array([keys], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels), [raw])


def unpacked(n: int, dims: int, raw: bytes, width: int) -> np.ndarray:
    """The vectors of a block as 64-bit numbers, filled up to width."""
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[int(np.frombuffer(raw[:8], "<i8")[0])]
    out = np.zeros((n, width), np.int64)
    out[:, :dims] = np.frombuffer(raw, kind, offset=8).reshape(n, dims)
    return out


def blocks(rows: DataFrame, scale: int, each: int) -> DataFrame:
    """rows (key, label, vector) packed where they are, each rows to a block at most."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, each):
                part = b.slice(s, each)
                use, vectors = quantised(part.column(2), scale)
                if use.any():
                    yield packed(part.column(0).to_numpy(zero_copy_only=False)[use], part.column(1).filter(pa.array(use)), vectors)

    return rows.mapInArrow(run, _BLOCK)


def best(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest key."""
    if len(key) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k] if k else None
        at = np.flatnonzero(score >= edge) if k else np.zeros(0, np.int64)
    else:
        at = np.arange(len(key))
    return at[np.lexsort((key[at], -score[at]))][:k]


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score) of every anchor and positive.

    is_anchor: a condition on the columns of rows. label may be of any type that has a text form; vector is an array of numbers.
    """
    spark = rows.sparkSession
    plain = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    plain = plain.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    with scratch() as keep:
        data = materialize(blocks(plain.select("key", "label", "vector"), scale, ROWS), "vectors")
        asked = plain.where("anchor").groupBy("key").agg(F.min(F.struct("label", "vector")).alias("r")).select("key", "r.label", "r.vector")
        n = max(1, plain.where("anchor").count())
        many = max(1, -(-n // ANCHORS))

        def pack(block: pa.Table) -> pa.Table:
            use, vectors = quantised(block.column("vector"), scale)
            made = packed(block.column("key").to_numpy()[use], block.column("label").combine_chunks().filter(pa.array(use)), vectors)
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([block.column("block")[0].as_py()], pa.int64()), *made.columns], schema=pa.schema([("block", pa.int64()), *_ARROW]))])

        asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(many)))
        anchors = materialize(asked.groupBy("block").applyInArrow(pack, f"block long, {_BLOCK}"), "anchors")
        size = data.agg(F.max("dims"), F.max("most"), F.count("*")).first()
        if size[0] is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        dims, moduli = int(size[0]), primes(int(size[1]) + 1)
        data = data.repartition(max(min(size[2], spark.sparkContext.defaultParallelism), -(-size[2] // A_TASK)))
        # an anchor's block takes at most 8 bytes a component, and its key and label
        rounds = max(1, -(-n * (8 * dims + 64) // TOGETHER))

        def every(what, selection, out: str, wanted: DataFrame | None = None) -> DataFrame:
            """What selection finds, for all anchors: a round of blocks of anchors after the other."""
            found = []
            for r in range(rounds):
                some = anchors.where(F.pmod(F.col("block"), F.lit(rounds)) == r).select("block", *[F.col(c).alias(f"a_{c}") for c in ("n", "dims", "keys", "labels", "vectors")])
                if wanted is not None:
                    some = some.join(wanted, "block")
                own = data.withColumn("block", F.explode(F.sequence(F.lit(r).cast("long"), F.lit(max(many - 1, r)).cast("long"), F.lit(rounds).cast("long"))))
                met = own.join(F.broadcast(some), "block").select("block", "n", "dims", "keys", "labels", "vectors", *[c for c in some.columns if c != "block"])
                found.append(met.mapInArrow(lambda batches: over(batches, what, selection, dims, moduli), out))
            whole = found[0]
            for more in found[1:]:
                whole = whole.unionByName(more)
            return whole

        with arrow_rows(spark, 1):
            near = keep(materialize(top(every(Positives, positives, "anchor_id long, own long, score long"), ["anchor_id"], "own", positives).drop("rank"), "positives"))
            # at most `positives` scores an anchor
            windows = near.select("anchor_id", "score").distinct().withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(many))).groupBy("block")
            windows = materialize(windows.agg(F.collect_list("anchor_id").alias("w_anchor"), F.collect_list("score").alias("w_score")), "windows")
            rest = every(Negatives, (negatives, low, high), "anchor_id long, window long, own long, score long", windows)
            hard = keep(materialize(top(rest, ["anchor_id", "window"], "own", negatives), "negatives"))
    hard = hard.select("anchor_id", F.col("window").alias("positive_score"), "rank", F.col("own").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.select("anchor_id", F.col("own").alias("positive_id"), F.col("score").alias("positive_score")).join(hard, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def top(found: DataFrame, keys: list[str], own: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), own)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Positives:
    """Of each anchor of a block the k best rows of its label, over all blocks of rows that it has met."""

    fields = ("anchor_id", "own", "score")

    def __init__(self, k: int, *_) -> None:
        self.k, self.held = k, {}

    def meet(self, anchor: int, same: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        at = np.flatnonzero(same)
        self.held[anchor] = merged(self.held.get(anchor), key[at], score[at], self.k)

    def rows(self):
        for anchor, (key, score) in self.held.items():
            yield np.full(len(key), anchor), key, score


class Negatives:
    """Of each anchor and window the k best rows of other labels with a score inside."""

    fields = ("anchor_id", "window", "own", "score")

    def __init__(self, selection: tuple[int, int, int], anchors: np.ndarray, scores: np.ndarray) -> None:
        (self.k, self.low, self.high), self.held, self.windows = selection, {}, {}
        for anchor, s in zip(anchors.tolist(), scores.tolist(), strict=True):
            # low * s <= 100 * x <= high * s
            self.windows.setdefault(anchor, []).append((s, -(-self.low * s // 100), self.high * s // 100))

    def meet(self, anchor: int, same: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        windows = [w for w in self.windows.get(anchor, ()) if w[1] <= w[2]]
        if not windows:
            return
        at = np.flatnonzero(~same & (score >= min(w[1] for w in windows)) & (score <= max(w[2] for w in windows)))
        for s, least, most in windows:
            use = at[(score[at] >= least) & (score[at] <= most)]
            if len(use):
                self.held[anchor, s] = merged(self.held.get((anchor, s)), key[use], score[use], self.k)

    def rows(self):
        for (anchor, s), (key, score) in self.held.items():
            yield np.full(len(key), anchor), np.full(len(key), s), key, score


def merged(held: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = best(key, score, k)
    key, score = key[at], score[at]
    if held is not None:
        key, score = np.concatenate([held[0], key]), np.concatenate([held[1], score])
        at = best(key, score, k)
        key, score = key[at], score[at]
    return key, score


def over(batches: Iterator[pa.RecordBatch], what: type, selection, dims: int, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's blocks of rows with blocks of anchors; at its end what each anchor has found."""
    states: dict[int, Positives | Negatives] = {}
    arrow = pa.schema([(c, pa.int64()) for c in what.fields])
    last: tuple | None = None
    for b in batches:
        for k in range(b.num_rows):
            c = {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}
            block, raw = c["block"].as_py(), c["vectors"].as_py()
            key = c["keys"].values.to_numpy(zero_copy_only=False)
            if last is None or last[0] != raw or not np.array_equal(last[1], key):  # the same rows meet one block of anchors after the other
                last = raw, key, Product(unpacked(c["n"].as_py(), c["dims"].as_py(), raw, dims), moduli), c["labels"].values.to_numpy(zero_copy_only=False)
            _, key, product, labels = last
            a_key, a_labels = c["a_keys"].values.to_numpy(zero_copy_only=False), c["a_labels"].values.to_numpy(zero_copy_only=False)
            anchors = unpacked(c["a_n"].as_py(), c["a_dims"].as_py(), c["a_vectors"].as_py(), dims)
            if block not in states:
                given = (c["w_anchor"].values.to_numpy(zero_copy_only=False), c["w_score"].values.to_numpy(zero_copy_only=False)) if what is Negatives else ()
                states[block] = what(selection, *given)
            number = {x: i for i, x in enumerate(dict.fromkeys([*labels, *a_labels]))}
            own, asked = np.array([number[x] for x in labels]), np.array([number[x] for x in a_labels])
            for s in range(0, len(a_key), AT_ONCE):
                scores = product.of(anchors[s : s + AT_ONCE])
                for i, score in enumerate(scores):
                    anchor = int(a_key[s + i])
                    other = np.flatnonzero(key != anchor)
                    if len(other) < len(key):
                        states[block].meet(anchor, own[other] == asked[s + i], key[other], score[other])
                    else:
                        states[block].meet(anchor, own == asked[s + i], key, score)
    for state in states.values():
        found = [r for r in state.rows() if len(r[0])]
        if found:
            yield batch(arrow, *[np.concatenate(x) for x in zip(*found, strict=True)])
    give_back()
