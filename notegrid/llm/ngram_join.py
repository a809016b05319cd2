"""N-gram Jaccard join: size-aware, heavy-light.

A document's set is its distinct 5-word shingles (A-Z as a-z; a text of fewer words is one shingle; none without words).
Two documents link when 100 * |both| >= 80 * |either|. Equal texts are found first, and one of them stands for all. Each set
is handled by its size:

* light sets (size <= boundary) enumerate their subsets of the overlap that a partner needs and meet on equal subsets;
* heavy sets scan inverted lists: their tokens, rare ones first, go into lists, as many as a partner cannot all miss.

The boundary is the largest size at which enumerating costs no more than scanning, by counts over the whole corpus
(``choose_boundary``). Rarity comes from a fixed-size frequency sketch over all shingles of all documents; it only orders
tokens, so that lists of common ones stay short, and never decides a link.

One list never gives all its pairs. A list is read with its most central members first, and a member meets the list's
leaders of sizes near its own; verified links make first components. Only members of different components meet again, all of
them, long lists in parts by size and salt. So no link between different components is lost, and a group of n near copies
costs about n comparisons.

Candidates are verified in two exact steps: counts of a set's shingles in a fixed number of bins bound the overlap of two
sets from above, and only pairs that this bound lets pass have their whole texts' sets compared.

Defined results: null, empty and white-space texts have empty sets, size 0, and are components of their own; equal texts
are links; repeated rows of one doc_id count as one document, which links with what any of its texts links with; a null
doc_id links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import WORD_BASES, arrow_rows, as_long, batch, components, discard, give_back, join_counted, materialize, mix, rolling, scratch, words

SHINGLE = 5
#: Similarity 0.8 as a fraction: links need DEN * |both| >= NUM * |either|.
NUM, DEN = 4, 5
#: Cells of the frequency sketch; its size does not depend on the input.
CELLS = 1 << 16
#: Bins whose counts bound an overlap, and the count at which a bin says nothing.
BINS, FULL = 256, 255
#: Sizes that can be light; above it the number of subsets passes any list.
MOST_LIGHT = 12
#: Members of a list that meet its other members in one part.
PART = 4096
_U = np.uint64


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, its and its followers' sets one after the other, each sorted, where each
    begins with the end of the last, and the row of each token."""
    for w in words(column, lower=True, size=1 << 18):
        n = w.last - w.first
        cuts = w.bounds()
        length = np.diff(cuts)
        tokens = rolling(w.h, SHINGLE, WORD_BASES[0]) + _U(SHINGLE)
        row = w.row[: len(tokens)] - w.first
        whole = w.row[: len(tokens)] == w.row[SHINGLE - 1 :] if len(tokens) else np.zeros(0, bool)
        tokens, row = tokens[whole], row[whole]
        short = np.flatnonzero((length > 0) & (length < SHINGLE))
        if len(short):
            of = [rolling(w.h[cuts[k] : cuts[k + 1]], int(length[k]), WORD_BASES[0])[0] + _U(length[k]) for k in short]
            tokens, row = np.concatenate([tokens, np.array(of, np.uint64)]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            tokens, row = tokens[order], row[order]
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=n), out=at[1:])
        for k in range(n):
            tokens[at[k] : at[k + 1]].sort()
        if len(tokens):
            new = np.r_[True, (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])]
            tokens, row = tokens[new], row[new]
            np.cumsum(np.bincount(row, minlength=n), out=at[1:])
        yield w.first, tokens, at, row


def least_overlap(n, m):
    """Shared shingles that sets of n and m need: the least k with DEN * k >= NUM * (n + m - k)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def probe_length(n):
    """Tokens of a set of n that a partner of any size cannot all miss."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def index_length(n):
    """The same, for partners that are no smaller."""
    return n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1


def subset_sizes(n: int, boundary: int) -> set[int]:
    """Overlaps that a set of n needs with light sets of any size that can link with it."""
    return {least_overlap(n, m) for m in range(1, boundary + 1) if least_overlap(n, m) <= min(n, m)}


def cells(s: np.ndarray) -> np.ndarray:
    return (s >> _U(48)).astype(np.int64)


def text_key() -> tuple:
    """Two numbers that stand for a text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def summarize(texts: DataFrame) -> DataFrame:
    """Rows of kind 0: doc_id, h1, h2, n_rows of a text, its set's size n and its bins; rows of kind 1: cell h1 and its count h2 in one task."""
    arrow = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_rows", pa.int64()), ("n", pa.int32()), ("bins", pa.binary())])

    def run(batches):
        sketch = np.zeros(CELLS, np.int64)
        for part in batches:
            for first, tokens, at, row in sets_of(part.column("text")):
                m = len(at) - 1
                sketch += np.bincount(cells(tokens), minlength=CELLS)
                bins = np.minimum(np.bincount(row * BINS + (tokens & _U(BINS - 1)).astype(np.int64), minlength=m * BINS), FULL).astype(np.uint8)
                offsets = pa.py_buffer((np.arange(m + 1) * BINS).astype(np.int32))
                own = [part.column(c).slice(first, m) for c in ("doc_id", "h1", "h2", "n_rows")]
                yield batch(arrow, np.zeros(m, np.int32), *own, np.diff(at), pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(bins)]))
        at = np.flatnonzero(sketch)
        none = pa.nulls(len(at), pa.int64())
        yield batch(arrow, np.ones(len(at), np.int32), none, at, sketch[at], none, np.zeros(len(at), np.int32), pa.nulls(len(at), pa.binary()))
        give_back()

    return texts.mapInArrow(run, "kind int, doc_id long, h1 long, h2 long, n_rows long, n int, bins binary")


def choose_boundary(sizes: dict[int, int], sketch: np.ndarray) -> int:
    """The largest light size: enumerating the subsets of all sets up to it costs no more rows than scanning their lists.

    sizes: sets by size. A scan costs a list's expected length for every token of the prefix; that length is the sketch's
    mean count met by a token, less what other tokens of the same cell add.
    """
    total = int(sketch.sum())
    if not total:
        return 0
    length = max(2.0, float((sketch.astype(float) ** 2).sum()) / total - total / CELLS)
    best, enumerate_cost, scan_cost = 0, 0.0, 0.0
    for n in range(1, MOST_LIGHT + 1):
        enumerate_cost += sizes.get(n, 0) * sum(comb(n, c) for c in subset_sizes(n, MOST_LIGHT))
        scan_cost += sizes.get(n, 0) * probe_length(n) * length
        if enumerate_cost <= scan_cost:
            best = n
    return best


def subset_keys(s: np.ndarray, c: int) -> np.ndarray:
    chosen = mix(s + _U(c))[np.array(list(combinations(range(len(s)), c)))]
    return mix(chosen.sum(axis=1, dtype=np.uint64) + _U(c))


def list_entries(texts: DataFrame, sketch: np.ndarray, boundary: int) -> DataFrame:
    """(token, doc_id, n, pos) of every set's subsets (pos -1) or prefix tokens (pos in the order rare first)."""
    arrow = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
    rarity = texts.sparkSession.sparkContext.broadcast(np.log2(sketch + 1.0).astype(np.uint64) << _U(56))

    def run(batches):
        rank = rarity.value
        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for first, flat, at, _ in sets_of(part.column(1)):
                key = rank[cells(flat)] | (mix(flat) >> _U(8))
                tokens, rows, places = [], [], []
                for k in range(len(at) - 1):
                    s, n = flat[at[k] : at[k + 1]], int(at[k + 1] - at[k])
                    if 0 < n <= boundary:
                        for c in sorted(subset_sizes(n, boundary)):
                            keys = subset_keys(s, c)
                            tokens.append(keys)
                            rows.append(np.full(len(keys), k))
                            places.append(np.full(len(keys), -1, np.int32))
                    if n and n * DEN >= NUM * (boundary + 1):
                        p = probe_length(n)
                        tokens.append(s[key[at[k] : at[k + 1]].argsort()[:p]])
                        rows.append(np.full(p, k))
                        places.append(np.arange(p, dtype=np.int32))
                if tokens:
                    row = np.concatenate(rows)
                    yield batch(arrow, as_long(np.concatenate(tokens)), ids[first + row], np.diff(at)[row].astype(np.int32), np.concatenate(places))
        give_back()

    return texts.mapInArrow(run, "token long, doc_id long, n int, pos int")


def may_link(n, i, m, j):
    """Whether sets of n <= m that share a token in places i and j of their orders, none before, can link. -1: an equal subset."""
    subset = (i < 0) | (j < 0)
    first = np.where(n == m, np.maximum(i, j), i) < index_length(n)
    reach = 1 + np.minimum(n - 1 - i, m - 1 - j) >= least_overlap(n, m)
    return (DEN * n >= NUM * m) & np.where(subset, i == j, first & reach)


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets that can link are of the same or of neighbouring classes."""
    return (np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


LEADERS = ("lead0", "lead1", "lead2")


def leaders_met(number: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For rows of lists (by number, in order): the row of the leader met in each of three classes, -1 where none, and the
    rows that lead a class of their list."""
    kind = size_class(n)
    key = number * 1024 + kind
    led, leader = np.unique(key, return_index=True)
    met = []
    for c in (0, -1, 1):
        at = np.minimum(np.searchsorted(led, key + c), len(led) - 1)
        x = np.where(led[at] == key + c, leader[at], len(key))
        use = np.flatnonzero((x < np.arange(len(key))))
        y = x[use]
        use, y = use[doc[y] != doc[use]], y[doc[y] != doc[use]]
        swap = (n[y] > n[use]) | ((n[y] == n[use]) & (doc[y] > doc[use]))
        s, t = np.where(swap, use, y), np.where(swap, y, use)
        fits = may_link(n[s].astype(np.int64), pos[s], n[t].astype(np.int64), pos[t])
        out = np.full(len(key), -1)
        out[use[fits]] = y[fits]
        met.append(out)
    return met, leader


def scan_lists(entries: DataFrame) -> DataFrame:
    """Members of lists of two or more, each with the leaders that it meets there: of its size class and of both beside it.

    A list is read as a stream, members with the fewest rare tokens first: where a group of near copies shares a list, its
    first member is the nearest to all. A class's first member is its leader; what is kept of a list is its leaders.
    """
    arrow = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), *((c, pa.int64()) for c in LEADERS)])

    def run(batches):
        held = None  # the last row read, not given out yet
        joined = False  # whether its list has begun before it
        old = None  # leaders of the list that goes on, already given out

        def give(rows):
            """Out of complete and beginning lists, after the leaders of the list that went on before."""
            nonlocal old
            token = rows[0]
            if old is not None and (not len(token) or token[0] != old[0][0]):
                old = None
            before = len(old[0]) if old is not None else 0
            token, doc, n, pos = (np.concatenate([a, b]) for a, b in zip(old, rows, strict=True)) if before else rows
            number = np.cumsum(np.r_[False, token[1:] != token[:-1]])
            met, leader = leaders_met(number, doc, n, pos)
            last = leader[number[leader] == number[-1]]
            old = token[last], doc[last], n[last], pos[last]
            own = slice(before, None)
            return batch(arrow, token[own], doc[own], n[own], pos[own], *(pa.array(doc[x[own]], mask=x[own] < 0) for x in met))

        for part in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            token = rows[0]
            same = token[1:] == token[:-1]
            before = np.r_[joined, same]
            use = np.flatnonzero(before[:-1] | same)
            if len(use):
                yield give([x[use] for x in rows])
            held, joined = [x[-1:] for x in rows], bool(before[-1])
        if held is not None and joined:
            yield give(held)

    ordered = entries.repartition("token").sortWithinPartitions("token", "pos", "n", "doc_id")
    return ordered.mapInArrow(run, "token long, doc_id long, n int, pos int, " + ", ".join(f"{c} long" for c in LEADERS))


def bounded(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bins leave room for the overlap that they need. sets: doc_id, n, bins."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for part in batches:
            bins = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_a", "bins_b")]
            n, m = (part.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            most = np.minimum(*bins).sum(axis=1, dtype=np.int64)
            full = ((bins[0] == FULL) & (bins[1] == FULL)).any(axis=1)
            fits = (most >= least_overlap(n, m)) | full
            yield batch(arrow, *(part.column(c).filter(pa.array(fits)) for c in ("a", "b")))

    known = pairs
    for c in ("b", "a"):
        known = known.join(sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")), c)
    return known.mapInArrow(run, "a long, b long").distinct()


def verify(texts: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts' sets link. texts: doc_id, text."""
    spark = texts.sparkSession
    pairs = materialize(bounded(sets, pairs), "bounded")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = materialize(texts.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole(column: pa.Array) -> list[np.ndarray]:
        return [tokens[at[k] : at[k + 1]] for _, tokens, at, _ in sets_of(column) for k in range(len(at) - 1)]

    def run(batches):
        for part in batches:
            a = part.column(0).to_numpy(zero_copy_only=False)
            new = np.r_[True, a[1:] != a[:-1]]  # rows are in the order of a: its set is made once for all that follow
            left, left_text, linked = None, None, np.zeros(part.num_rows, bool)
            for k, s in enumerate(whole(part.column(3))):
                text = part.column(2)[k]
                if new[k] or not text.equals(left_text):
                    left, left_text = whole(part.column(2).slice(k, 1))[0], text
                both = len(np.intersect1d(left, s, assume_unique=True))
                linked[k] = both > 0 and DEN * both >= NUM * (len(left) + len(s) - both)
            yield batch(arrow, *(part.column(c).filter(pa.array(linked)) for c in (0, 1)))
        give_back()

    with_b = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with arrow_rows(spark, 256):
        done = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "verified")
    discard(own, pairs)
    return done


def first_pairs(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of members and the leaders that they meet."""
    met = lists.select("doc_id", F.explode(F.array(*LEADERS)).alias("other")).where("other is not null")
    return met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def other_pairs(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of members of one list that are of different components and can link.

    Of two sets that can link the larger one's size has as many binary digits as the smaller one's or one more, so members
    meet by token and digits; the larger side of a long list is dealt out in parts of about PART, the smaller goes to each.
    """
    known = lists.select("token", "doc_id", "n", "pos").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2")
    here = known.join(mixed.select("token", F.ceil(F.col("size") / PART).alias("parts")), "token")
    digits = F.length(F.bin(F.col("n").cast("long")))
    s = here.withColumn("digits", F.explode(F.array(digits, digits + 1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("s")
    t = here.withColumn("digits", digits).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("t")
    n, m, i, j = F.col("s.n"), F.col("t.n"), F.col("s.pos"), F.col("t.pos")
    order = (n < m) | ((n == m) & (F.col("s.doc_id") < F.col("t.doc_id")))
    least = F.expr(f"({NUM} * (s.n + t.n) + {NUM + DEN - 1}) div {NUM + DEN}")
    prefix = F.expr(f"s.n - (2 * {NUM} * s.n + {NUM + DEN - 1}) div {NUM + DEN} + 1")
    first = F.when(n == m, F.greatest(i, j)).otherwise(i) < prefix
    fits = (DEN * n >= NUM * m) & F.when((i < 0) | (j < 0), i == j).otherwise(first & (1 + F.least(n - 1 - i, m - 1 - j) >= least))
    same = (F.col("s.token") == F.col("t.token")) & (F.col("s.digits") == F.col("t.digits")) & (F.col("s.part") == F.col("t.part"))
    met = s.join(t, same & (F.col("s.component") != F.col("t.component")) & order & fits)
    return met.select(F.least("s.doc_id", "t.doc_id").alias("a"), F.greatest("s.doc_id", "t.doc_id").alias("b")).distinct()


def by_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (doc_id, h1, h2) as doc_id with rep and n of their text."""
    found = texts.select("h1", "h2", F.col("doc_id").alias("rep"), "n", "n_rows")
    return join_counted(rows, found, ["h1", "h2"], "n_rows", rows.count()).select("doc_id", "rep", "n")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    with scratch() as keep:
        rows, groups = map(keep, rows_and_groups(docs))
    out = rows.where("doc_id is not null").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.unionByName(rows.where("doc_id is null").withColumn("component", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def rows_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (doc_id, rep, n) of every row, rep being the document of the same text that stands for all and n the
    size of its set, and (node, component) of every linked document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *text_key())
    # one row a text, with its smallest doc_id; whole texts are put together in the tasks that read them before they move
    distinct = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.first("text").alias("text"))
    texts = materialize(distinct, "distinct")
    seen = materialize(summarize(texts), "sets")
    sets = seen.where("kind = 0").drop("kind")
    sketch = np.zeros(CELLS, np.int64)
    for r in seen.where("kind = 1").groupBy("h1").agg(F.sum("h2").alias("h2")).collect():  # at most CELLS rows
        sketch[r["h1"]] = r["h2"]
    sizes = {r["n"]: r["k"] for r in sets.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").agg(F.count("*").alias("k")).collect()}
    own = texts.where("doc_id is not null").select("doc_id", "text")
    lists = materialize(scan_lists(list_entries(own, sketch, choose_boundary(sizes, sketch))), "lists")

    rows = materialize(by_text(keyed.select("doc_id", "h1", "h2"), sets), "rows")
    same = rows.where("doc_id <> rep and n > 0").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    met = materialize(first_pairs(lists), "pairs")
    links = same.unionByName(verify(own, sets, met))
    groups = components(links)
    more = materialize(other_pairs(lists, groups).join(met, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        groups = components(links.unionByName(verify(own, sets, more)))
    return rows, groups


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows of a null doc_id stay."""
    out = link(docs)
    gone = out.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
