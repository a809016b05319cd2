"""Embedding near-dedup by sorted projection passes.

Vectors of one label link when their cosine in double precision is at least 0.98. A pass gives every vector a number made
of the signs of 64 random projections, sorts the vectors of a label by it, and compares each with its neighbours there;
pairs found and verified in any pass are links. A vector meets at least WINDOW neighbours and goes on while it still finds
links among the last WINDOW, across blocks and tasks, so a dense group is compared whole. Equal vectors meet once, as one
with a number of copies. Passes sort and store numbers only; vectors are joined to the blocks that compare them.

How many passes, for each label and length: projections are of the vectors less their mean, whose mean square, the spread,
is 1 less the square of the mean's length. A pair at the threshold then has the cosine 1 - 0.02 / spread, and agrees in a
projection's sign with probability 1 - acos(cosine) / pi. It is met if it agrees in as many leading signs as make a group of
WINDOW neighbours, log2(n / WINDOW) of n vectors. Passes are as many as leave MISSED of such pairs. Then they are doubled
while Chao's estimate from the links that one and two passes found (capture-recapture) says that more than MISSED of the
links are left. With the parameter whole_labels, labels of so few vectors that passes would cost as much are compared all with
all instead; it is off by default, so that every label goes through the passes.

Recall is below 1 in principle (measured against brute force in the tests); every link found is verified. Defined results:
null, empty and zero vectors, vectors with null, infinite or NaN components and null labels link with nothing; vectors of
different lengths do not link; rows of one vec_id are one vector, returned each; a null vec_id links with nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import batch, components, join_counted, materialize, scratch

THRESHOLD = 0.98
WINDOW, BITS, SEED = 32, 64, 20_240_229
#: The turn in which all vectors of a label meet.
WHOLE, END = -1, 1 << 62
#: Share of links that all passes may miss.
MISSED = 0.002
#: Bytes of the labels' means, and number of open blocks, that are broadcast.
MOST_BROADCAST, MOST_OPEN = 32_000_000, 1_000_000
#: Places of a block, how many of them are compared at once, and with how many before them.
BLOCK, CHUNK, MEET = 8192, 256, 2048


def passes_for(n: int, spread: float) -> int:
    """Passes over n distinct vectors of a label whose mean square about their mean is spread."""
    cosine = max(0.0, 1 - (1 - THRESHOLD) / max(spread, 1e-12))
    met = (1 - math.acos(cosine) / math.pi) ** max(0.0, math.log2(max(1, n) / WINDOW))
    return max(3, math.ceil(math.log(MISSED) / math.log1p(-min(met, 1 - 1e-9))))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (its float64 bytes) and two numbers of them, of every vector that can link."""
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        for b in batches:
            ids, labels, out = [], [], []
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not v.is_valid or v.values is None or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any() and np.isfinite(np.linalg.norm(x / np.abs(x).max())):
                    ids.append(i)
                    labels.append(label)
                    out.append(x.tobytes())
            if ids:
                yield batch(arrow, ids, labels, out)

    plain = vectors.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return plain.mapInArrow(run, "vec_id long, label long, vector binary").withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})


def unit(data: list[bytes], n: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(-1, n)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planned(distinct: DataFrame, whole_labels: bool) -> DataFrame:
    """(label, size, n, mean, first, last, whole): the mean of the vectors of a label and length, and the passes over them."""
    part = "label long, size int, n long, total binary"
    arrow = pa.schema([("label", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("total", pa.binary())])

    def add(batches):
        sums: dict[tuple, list] = {}

        def out():
            if sums:
                yield batch(arrow, *map(list, zip(*((*k, n, x.tobytes()) for k, (n, x) in sums.items()), strict=True)))
            sums.clear()

        for b in batches:
            for label, size, data in zip(*(b.column(k).to_pylist() for k in ("label", "size", "vector")), strict=True):
                have = sums.setdefault((label, size), [0, np.zeros(size)])
                have[0] += 1
                have[1] += unit([data], size)[0]
            if len(sums) > 4096:
                yield from out()
        yield from out()

    final = pa.schema([("label", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("whole", pa.bool_())])

    def plan(table: pa.Table) -> pa.Table:
        label, size = (table.column(k)[0].as_py() for k in ("label", "size"))
        n = sum(table.column("n").to_pylist())
        mean = np.round(sum(np.frombuffer(x, np.float64) for x in table.column("total").to_pylist()) / n, 6)
        passes = passes_for(n, 1 - float(mean @ mean))
        return pa.table([[label], [size], [n], [mean.tobytes()], [0], [min(passes, n)], [whole_labels and passes * CHUNK >= n]], schema=final)

    out = distinct.select("label", "size", "vector").mapInArrow(add, part).groupBy("label", "size").applyInArrow(plan, "label long, size int, n long, mean binary, first int, last int, whole boolean")
    return out.where("n > 1")


def keyed(distinct: DataFrame, plan: DataFrame) -> DataFrame:
    """(turn, label, size, key, rep, h1, h2): every vector once for each pass of its plan, with its number there; once, with
    the turn WHOLE, where all are compared with all. label, h1 and h2 tell the vector."""
    arrow = pa.schema([("turn", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), *((k, pa.int64()) for k in ("key", "rep", "h1", "h2"))])
    held = plan.agg(F.coalesce(F.sum(F.length("mean") + 40), F.lit(0))).first()[0]
    both = distinct.join(F.broadcast(plan) if held <= MOST_BROADCAST else plan, ["label", "size"])

    def run(batches):
        for b in batches:
            label, rep, h1, h2, sizes, first, last, whole = (b.column(k).to_numpy(zero_copy_only=False) for k in ("label", "rep", "h1", "h2", "size", "first", "last", "whole"))
            data, mean = b.column("vector").to_pylist(), b.column("mean").to_pylist()
            own = np.flatnonzero(whole)
            if len(own):
                yield batch(arrow, np.full(len(own), WHOLE, np.int32), label[own], sizes[own], np.zeros(len(own), np.int64), rep[own], h1[own], h2[own])
            for size in np.unique(sizes[~whole]):
                all_ = np.flatnonzero((sizes == size) & ~whole)
                x = unit([data[k] for k in all_], size) - np.frombuffer(b"".join(mean[k] for k in all_), np.float64).reshape(-1, size)
                for t in range(first[all_].min(), last[all_].max()):
                    at = (first[all_] <= t) & (t < last[all_])
                    own = all_[at]
                    planes = np.random.default_rng((SEED, t, int(size))).standard_normal((size, BITS))
                    signs = np.packbits(x[at] @ planes > 0, axis=1)
                    key = signs.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)  # so that signed order is bit order
                    yield batch(arrow, np.full(len(own), t, np.int32), label[own], np.full(len(own), size, np.int32), key.view(np.int64), rep[own], h1[own], h2[own])

    return both.select("label", "size", "rep", "h1", "h2", "vector", "mean", "first", "last", "whole").mapInArrow(run, "turn int, label long, size int, key long, rep long, h1 long, h2 long")


def in_order(keys: DataFrame) -> DataFrame:
    """(block, reach, place, turn, label, size, rep, h1, h2): keys with their places in the order of all, and no reach yet."""
    own = ["turn", "label", "size", "rep", "h1", "h2"]
    arrow = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("turn", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), *((k, pa.int64()) for k in ("rep", "h1", "h2"))])

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield batch(arrow, np.full(b.num_rows, part, np.int32), np.arange(n, n + b.num_rows), *b.columns)
            n += b.num_rows

    # equal keys stand in another order in every pass, and can be cut between tasks
    order = ["turn", "label", "size", "key", "tie", "rep", "h1", "h2"]
    ranges = keys.withColumn("tie", F.xxhash64("turn", "rep")).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranges.select(*own).mapInArrow(number, "part int, nth long, turn int, label long, size int, rep long, h1 long, h2 long"), "order")
    before, n = [], 0
    for r in numbered.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], n))
        n += r["count"]
    place = numbered.join(F.broadcast(keys.sparkSession.createDataFrame(before, "part int, before long")), "part").withColumn("place", F.col("before") + F.col("nth"))
    return place.select(F.expr(f"place div {BLOCK}").alias("block"), F.lit(None).cast("long").alias("reach"), "place", *own)


def links_of(x: np.ndarray, group: np.ndarray, place: np.ndarray, reach: np.ndarray, old: int, fresh: bool):
    """Yields (i, j) of rows in order that link, in one group. The first old rows come from a block before; the others meet
    each other too if fresh. A link moves the reach of its first row, up to which it meets others, WINDOW beyond the second."""
    active = np.arange(old)
    for s in range(old, len(x), CHUNK):
        here = np.arange(s, min(s + CHUNK, len(x)))
        active = active[(reach[active] >= place[s]) & (group[active] == group[s])]
        pieces = [active[k : k + MEET] for k in range(0, len(active), MEET)] + ([here] if fresh else [])
        for own in pieces:
            linked = (x[own] @ x[here].T >= THRESHOLD) & (group[own][:, None] == group[here]) & (own[:, None] < here)
            i, j = np.nonzero(linked)
            if len(i):
                np.maximum.at(reach, own[i], place[here[j]] + WINDOW)
                yield own[i], here[j]
        if fresh:
            active = np.concatenate([active, here])


def neighbours(keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, turn, label, size): verified pairs of reps from every pass, a < b; a pair may come from several.

    Blocks of BLOCK places are compared by themselves first. Rows whose reach goes on beyond their block then meet the next
    block, those that still do the one after it, until none is left: each round deals its meetings out over tasks by block.
    vectors: label, h1, h2, vector, each once.
    """
    row = "block long, reach long, place long, turn int, label long, size int, rep long, h1 long, h2 long"
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("reach", pa.int64()), ("place", pa.int64()), ("turn", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), ("rep", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def meet(rows: DataFrame, fresh: bool) -> DataFrame:
        def compare(held):
            old = sum(r[1] is not None for r in held)
            block, reach, place, turn, label, size, rep, h1, h2, data = map(list, zip(*held, strict=True))
            group = np.unique(np.array([turn, label, size]), axis=1, return_inverse=True)[1].ravel()
            place, size, rep, turn, label = np.array(place), np.array(size, np.int32), np.array(rep), np.array(turn, np.int32), np.array(label)
            reach = np.array([r if r is not None else END if t == WHOLE else p + WINDOW for r, t, p in zip(reach, turn, place.tolist(), strict=True)])
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                till = reach[own]
                for i, j in links_of(unit([data[i] for i in own], k), group[own], place[own], till, int((own < old).sum()), fresh):
                    first, i, j = own[i], rep[own[i]], rep[own[j]]
                    none = pa.nulls(len(i), pa.int64())
                    yield batch(arrow, np.minimum(i, j), np.maximum(i, j), none, none, none, turn[first], label[first], size[first], none, none, none)
                reach[own] = till
            went = np.arange(len(held)) if fresh else np.arange(old)
            for i in np.array_split(went := went[(reach[went] > place[-1]) & (group[went] == group[-1])], len(went) // 1024 + 1):
                if len(i):
                    none, of = pa.nulls(len(i), pa.int64()), lambda values: [values[k] for k in i]  # noqa: B023
                    yield batch(arrow, none, none, np.full(len(i), block[0] + 1), reach[i], place[i], turn[i], label[i], size[i], rep[i], of(h1), of(h2))

        def run(batches):
            held: list[tuple] = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and held[0][0] != r[0]:
                        if held[-1][1] is None:
                            yield from compare(held)
                        held = []
                    held.append(r)
            if held and held[-1][1] is None:  # rows beyond the last block meet nothing
                yield from compare(held)

        dealt = rows.join(vectors, ["label", "h1", "h2"]).select(*rows.columns, "vector").repartition("block").sortWithinPartitions("block", F.col("reach").isNull(), "place")
        return materialize(dealt.mapInArrow(run, f"a long, b long, {row}"), "met")

    rows = in_order(keys)
    met = meet(rows, True)
    pairs = met.where("a is not null").select("a", "b", "turn", "label", "size")
    while True:
        open_ = met.where("a is null").drop("a", "b")
        blocks = open_.select("block").distinct()
        n = blocks.count()
        if not n:
            break
        met = meet(rows.join(F.broadcast(blocks) if n <= MOST_OPEN else blocks, "block", "left_semi").select(*rows.columns).unionByName(open_), False)
        pairs = pairs.unionByName(met.where("a is not null").select("a", "b", "turn", "label", "size"))
    return pairs


def linked_pairs(distinct: DataFrame, whole_labels: bool = False) -> DataFrame:
    """(a, b): pairs of reps that link, found by as many passes as each label needs. distinct: label, size, rep, h1, h2, vector."""
    plan, parts, same = materialize(planned(distinct, whole_labels), "plan"), [], ["label", "size"]
    vectors = distinct.select("label", "h1", "h2", "vector")
    while True:
        with scratch() as keep:
            found = neighbours(materialize(keyed(distinct, plan), "keys"), vectors).groupBy(*same, "a", "b").agg(F.count_distinct("turn").alias("times"))
            parts.append(keep(materialize(found, "found")))
        todo = plan.where("not whole")
        if not todo.limit(1).count():
            break
        times = parts[0]
        for p in parts[1:]:
            times = times.unionByName(p)
        times = times.where("a <> b").join(todo.select(*same), same, "left_semi").groupBy(*same, "a", "b").agg(F.sum("times").alias("times"))
        seen = times.groupBy(*same).agg(F.count("*").alias("links"), F.count_if(F.col("times") == 1).alias("once"), F.count_if(F.col("times") == 2).alias("twice"))
        missed = (F.col("last") - 1) / F.col("last") * F.col("once") * (F.col("once") - 1) / (2 * (F.col("twice") + 1))
        more = todo.join(seen, same).where(missed > MISSED * (F.col("links") + missed))
        plan = materialize(more.select(*same, "n", "mean", F.col("last").alias("first"), (F.col("last") * 2).alias("last"), (F.lit(whole_labels) & (F.col("last") * CHUNK >= F.col("n"))).alias("whole")), "plan")
        if not plan.limit(1).count():
            break
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return pairs.select("a", "b").where("a <> b").distinct()


def dedup(vectors: DataFrame, whole_labels: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    good = materialize(usable(vectors), "vectors")
    same = ["label", "h1", "h2"]
    groups = good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("vector").alias("vector"))
    groups = materialize(groups, "distinct")
    pairs = materialize(linked_pairs(groups.select("label", F.expr("int(length(vector) div 8)").alias("size"), "rep", "h1", "h2", "vector"), whole_labels), "pairs")
    # a rep stands for its vec_ids; one vec_id may have several vectors, so links are counted between vec_ids by reps
    copies = groups.groupBy("rep").agg(F.max("copies").alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    own = copies.join(other, "rep", "left").select("rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    member = join_counted(good.select(*same, "vec_id"), groups.select(*same, "rep", "copies"), same, "copies", good.count()).select("vec_id", "rep").distinct()
    linked = components(pairs.unionByName(member.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))))
    counted = member.join(own, "rep").groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).join(linked.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counted, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
