"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts.

    P(w | v) = d(r) r / (c(v) + 1)      r = c(v, w) > 0
             = alpha(v) P(w)            otherwise
    P(w)     = d1(c) c / (N + 1)        c = c(w) > 0
             = what those leave         for any word not seen

d and d1 are Katz's discounts for counts up to 5 from the counts of counts, 1 above. One observation of every context is
kept for backing off, so that none lacks mass, and alpha(v) makes the probabilities of all words after v add up to one
exactly. A document is its words (A-Z as a-z) and an end token; the first context is a start token. A context that
training has not seen backs off with weight 1.

How it runs: word counts are one table. The most frequent words, a fixed number, are broadcast with their counts, and so
are the word pairs that are frequent in some batch, with exact counts from a pass of their own; tokens in such pairs are
scored where they stand. Every other token goes to a partition by its pair, or by its word if that is not broadcast, and
meets there the counts that it needs: pairs are counted and looked up in the same place. Partitions return sums for each
document, sums for each context (from which the table of backoff weights is made), and the contexts that a document needs
a weight of; those are joined. Sums hold the numbers of tokens of each low count, so discounts can follow afterwards.

Defined results: null and empty texts are the end token alone; with nothing to learn from, every text has probability 1;
a null doc_id is learned from and scored; repeated rows are learned from and scored each.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import as_long, batch, discard, give_back, materialize, mix, words
from notegrid.llm.language_id import held_out

FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
#: Counts that are discounted.
K = 5
#: Words and pairs that are broadcast, a fixed number; a pair is proposed if it is this share of a batch's tokens.
FREQUENT_WORDS, FREQUENT_PAIRS, PROPOSED = 1 << 17, 1 << 16, 2.0e-5
#: Tokens that a partition gets on average, and bytes of text whose tokens travel together.
PART_TOKENS, CHUNK = 3_000_000, 1 << 21
#: Slices of a partition that are counted one after the other, to bound memory.
SLICES = 8
START, END = np.uint64(0x5157A27), np.uint64(0xE2D)
RARE = np.uint32(0xFFFFFFFF)
_U = np.uint64


def tokens(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context and row (0 for the first) of some rows: their words and an end each."""
    cuts = w.bounds()
    n = len(cuts) - 1
    token = np.insert(w.h, cuts[1:], END)
    row = np.repeat(np.arange(n), np.diff(cuts) + 1)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[cuts[:-1] + np.arange(n)] = START
    return token, context, row


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _U(3) + mix(w + _U(0x51)))


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts d(0..K) from the counts of counts n[1..K+1]; where they are no discounts, r / (r + 0.5)."""
    d = np.ones(K + 1)
    a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 and n[r] else 0.0
        d[r] = x if 0 < x <= 1 else r / (r + 0.5)
    return d


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the bytes of equal rank together, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else (a.dtype.str, b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def proposals(docs: DataFrame) -> DataFrame:
    """Of the texts to learn from: kind 0, key a word or the end and its count; kind 1, the same of pairs frequent in a batch, with both."""
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            keys, counts = [], []
            for w in words(b.column(0), lower=True, size=CHUNK):
                token, context, _ = tokens(w)
                k, n = counted(token)
                keys.append(k)
                counts.append(n)
                p, first, n = np.unique(pair(context, token), return_index=True, return_counts=True)
                hot = n > max(8, PROPOSED * len(token))
                if hot.any():
                    yield batch(arrow, np.ones(int(hot.sum()), np.int32), as_long(p[hot]), as_long(context[first[hot]]), as_long(token[first[hot]]), n[hot])
            if keys:
                k, back = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
                yield batch(arrow, np.zeros(len(k), np.int32), as_long(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), n)
        give_back()

    return docs.mapInArrow(run, "kind int, key long, v long, w long, n long")


def pair_counts(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Exact counts of the pairs of sorted keys over all the texts to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    arrow = pa.schema([("at", pa.int64()), ("n", pa.int64())])

    def run(batches):
        have = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for w in words(b.column(0), lower=True, size=CHUNK):
                token, context, _ = tokens(w)
                at, hit = find(shared.value, pair(context, token))
                have += np.bincount(at[hit], minlength=len(have))
        at = np.flatnonzero(have)
        yield batch(arrow, at, have[at])

    out = np.zeros(len(keys), np.int64)
    if len(keys):
        for r in docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["at"]] = r["n"]
    return out


#: Sums for a document: tokens, known tokens, base, log10 of high counts, tokens of counts 1..K, log10(c + 1) of contexts, log10 P(w) of tokens that back off.
SUMS = 4 + K + 2
_ROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("held", pa.bool_()), *((f"x{i}", pa.float64()) for i in range(SUMS))])
ROW = "kind int, a long, b long, held boolean, " + ", ".join(f"x{i} double" for i in range(SUMS))


def rows_of(kind: int, a, b, held, *x) -> pa.Table:
    n = len(a)
    columns = [np.full(n, kind, np.int32), as_long(a), b, held, *x]
    columns += [None] * (len(_ROW) - len(columns))
    return pa.table([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def spell(model: Unigrams, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Word numbers of codes: places among the frequent words, or the rare ones in turn."""
    out = model.keys[np.minimum(code, len(model.keys) - 1)] if len(model.keys) else np.zeros(len(code), np.uint64)
    out[code == RARE] = rare
    return out


class Unigrams:
    """What every task knows of words: the frequent ones' counts, N, V and the discounted probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, of: list[int], mass: float) -> None:
        self.keys, self.counts, self.total, self.distinct = keys, counts, total, distinct
        self.d = discounts(of)
        self.unseen = math.log10(max(1 - mass, 1e-300))

    def log_p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, np.log10(np.maximum(d * c, 1e-300) / (self.total + 1)), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADDED) / (self.total + ADDED * (self.distinct + 1)))

    def sums(self, row: np.ndarray, n: int, token: np.ndarray, c: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """The SUMS of each of n rows, of these tokens with counts c and pair counts r."""
        add = lambda x: np.bincount(row, weights=x, minlength=n)
        follows = (token != END) & (c > 0)
        return [
            add(np.ones(len(row))), add(c > 0), add(self.base(c)), add(np.where(r > K, np.log10(np.maximum(r, 1)), 0)),
            *(add(r == k) for k in range(1, K + 1)), add(np.where(follows, np.log10(c + 1.0), 0)), add(np.where(r == 0, self.log_p(c), 0)),
        ]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most that many rows of the largest n: all whose n reaches a level, found from the numbers of rows by level."""
    level = F.floor(F.log2("n") * 16)
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()  # some hundred levels
    least, taken = None, 0
    for r in rows:
        if taken + r["k"] > most:
            break
        least, taken = r["level"], taken + r["k"]
    return counts.where(level >= least) if least is not None else counts.where("false")


def learn_words(train: DataFrame) -> tuple[DataFrame, Unigrams, tuple[np.ndarray, ...]]:
    """The table of word counts, what tasks know of words, and the frequent pairs (keys, contexts, words, counts)."""
    seen = materialize(proposals(train).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.first("v").alias("v"), F.first("w").alias("w")), "words")
    counts = seen.where("kind = 0").select("key", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    of = [0] * (K + 2)
    for r in counts.where(F.col("n") <= K + 1).groupBy("n").agg(F.count("*").alias("k")).collect():
        of[r["n"]] = r["k"]
    d = discounts(of)
    mass = (total - sum(r * of[r] * (1 - d[r]) for r in range(1, K + 1))) / (total + 1)
    top = most_frequent(counts, FREQUENT_WORDS).toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    model = Unigrams(keys[order], n[order], total, distinct, of, mass)
    hot = most_frequent(seen.where("kind = 1"), FREQUENT_PAIRS).toArrow()
    key, v, w = (hot.column(c).to_numpy().view(np.uint64) for c in ("key", "v", "w"))
    known = find(model.keys, w)[1]
    order = np.argsort(key[known])
    key, v, w = (x[known][order] for x in (key, v, w))
    return counts, model, (key, v, w, pair_counts(train, key))


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text, held_out).

    train: the texts to learn from, one column.
    """
    spark = docs.sparkSession
    counts, model, (hot_key, hot_v, hot_w, hot_n) = learn_words(train)
    shared = spark.sparkContext.broadcast((model, hot_key, hot_n))
    parts = max(1, -(-int(model.total) // PART_TOKENS))
    arrow = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

    def route(batches):
        model, hot, hot_counts = shared.value
        for b in batches:
            ids = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            known_id = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            held, key = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            for w in words(b.column(0), lower=True, size=CHUNK):
                token, context, row = tokens(w)
                at, frequent = find(model.keys, token)
                p = pair(context, token)
                place, settled = find(hot, p)
                out = []
                n = w.last - w.first
                c = model.counts[at[settled]] if settled.any() else np.zeros(0, np.int64)
                sums = model.sums(row[settled], n, token[settled], c, hot_counts[place[settled]] if len(c) else c)
                which = slice(w.first, w.last)
                out.append((int(key[w.first] % parts), 1, pack(key[which], ids[which], known_id[which], held[which], *sums)))
                code = np.where(frequent, at, RARE).astype(np.uint32)
                before = np.r_[RARE, code[:-1]]
                before[context == START] = RARE
                rest = np.flatnonzero(~settled)
                part = (np.where(frequent[rest], p[rest], mix(token[rest] + _U(7))) % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                there, begin = np.unique(part[order], return_index=True)
                for k, own in zip(there.tolist(), np.split(rest[order], begin[1:]), strict=False):  # parts with tokens only
                    r, size = np.unique(row[own], return_counts=True)
                    cw, cv = code[own], before[own]
                    out.append((k, 0, pack(cw, cv, token[own][cw == RARE], context[own][cv == RARE], size.astype(np.int32), key[w.first + r], ids[w.first + r], known_id[w.first + r], held[w.first + r])))
                yield batch(arrow, *map(list, zip(*out, strict=True)))
        give_back()

    rare_arrow = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def rare(batches):
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            out = ~find(shared.value[0].keys, k)[1]
            yield batch(rare_arrow, (mix(k[out] + _U(7)) % _U(parts)).astype(np.int32), as_long(k[out]), b.column(1).to_numpy()[out])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value[0]
        out, blobs, runs, n = [], [], [], 0
        for kind, data in zip(left.column("kind").to_pylist(), left.column("data"), strict=True):
            x = unpack(data.as_py())
            if kind:
                out.append(rows_of(0, x[0], pa.array(x[1], mask=~x[2].astype(bool)), x[3].astype(bool), *x[4:]))
                continue
            spelled = lambda x=x: (spell(model, x[0], x[2]), spell(model, x[1], x[3]))
            token, context = spelled()
            slice_ = ((np.where(x[0] != RARE, pair(context, token), mix(token + _U(7))) >> _U(32)) % _U(SLICES)).astype(np.uint8)
            blobs.append((spelled, slice_, x[4], n))
            runs.append(x[5:])
            n += len(x[4])
        if not n:
            return pa.concat_tables(out) if out else rows_of(0, np.zeros(0, np.int64), None, None)
        key, ids, known_id, held = (np.concatenate([r[k] for r in runs]) for k in range(4))
        held = held.astype(bool)
        own_key, own_n = right.column("key").to_numpy().view(np.uint64), right.column("n").to_numpy()
        order = np.argsort(own_key)
        own_key, own_n = own_key[order], own_n[order]
        sums = None
        for part in range(SLICES):  # a slice has all tokens of its pairs and words
            token, context, row = [], [], []
            for spelled, slice_, size, first in blobs:
                use = np.flatnonzero(slice_ == part)
                both = spelled()
                token.append(both[0][use])
                context.append(both[1][use])
                row.append(np.repeat(np.arange(first, first + len(size), dtype=np.int32), size)[use])
            token, context, row = map(np.concatenate, (token, context, row))
            # counts of words: broadcast ones, or this partition's own
            at, hit = find(model.keys, token)
            c = np.where(hit, model.counts[at], 0) if len(model.keys) else np.zeros(len(token), np.int64)
            at, hit = find(own_key, token)
            if hit.any():
                c[hit] = own_n[at[hit]]
            # counts of pairs, of the texts to learn from
            p = pair(context, token)
            learnt = np.flatnonzero(~held[row])
            distinct, first, times = np.unique(p[learnt], return_index=True, return_counts=True)
            at, hit = find(distinct, p)
            r = np.where(hit, times[at], 0) if len(distinct) else np.zeros(len(p), np.int64)
            del p, at, hit
            more = model.sums(row, n, token, c, r)
            sums = more if sums is None else [x + y for x, y in zip(sums, more, strict=True)]
            first = learnt[first]
            v, which = np.unique(context[first], return_inverse=True)
            out.append(rows_of(1, v, None, None, *of_contexts(model, which, len(v), times, c[first])))
            owed = np.flatnonzero(r == 0)
            if len(owed):
                need, of = as_long(context[owed]), key[row[owed]]
                order = np.lexsort((of, need))
                need, of = need[order], of[order]
                begin = np.flatnonzero(np.r_[True, (need[1:] != need[:-1]) | (of[1:] != of[:-1])])
                out.append(rows_of(2, need[begin], of[begin], None, np.diff(np.r_[begin, len(need)]).astype(float)))
            del token, context, row, c, r, more, first, which, owed
            give_back()
        out.append(rows_of(0, key, pa.array(ids, mask=~known_id.astype(bool)), held, *sums))
        return pa.concat_tables(out)

    routed = docs.select("text", "doc_id", "held_out", F.monotonically_increasing_id().alias("key")).mapInArrow(route, "part int, kind int, data binary")
    known = counts.mapInArrow(rare, "part int, key long, n long")
    met = materialize(routed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(meet, ROW), "sums")

    # contexts of the broadcast pairs, once
    types = met.where("kind = 1").select(F.col("a").alias("v"), *(f"x{i}" for i in range(K + 3)))
    if len(hot_key):
        v, which = np.unique(hot_v, return_inverse=True)
        at = find(model.keys, hot_w)[0]
        own = of_contexts(model, which, len(v), hot_n, model.counts[at])
        types = types.unionByName(spark.createDataFrame(pa.table([pa.array(as_long(v)), *map(pa.array, own)], names=["v", *(f"x{i}" for i in range(K + 3))])))
    per = materialize(types.groupBy("v").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(K + 3))), "contexts")
    n = per.agg(*(F.coalesce(F.sum(f"x{i}"), F.lit(0.0)) for i in range(K + 1))).first()
    d = discounts([0, *(int(x) for x in n)])
    seen = sum((F.col(f"x{r - 1}") * float(r * d[r]) for r in range(1, K + 1)), F.col(f"x{K + 1}"))
    size = sum((F.col(f"x{r - 1}") * r for r in range(1, K + 1)), F.col(f"x{K + 1}"))
    backoff = per.select(F.col("v").alias("a"), F.log10((size + 1 - seen) / (1 - F.col(f"x{K + 2}"))).alias("weight"))
    owed = met.where("kind = 2").select("a", F.col("b").alias("key"), "x0").join(backoff, "a").groupBy("key").agg(F.sum(F.col("x0") * F.col("weight")).alias("owed"))

    own = met.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.max("b").alias("doc_id"), F.max("held").alias("held_out"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(SUMS)))
    start = F.lit(math.log10(train.count() + 1.0))
    direct = F.col("x3") + sum((F.col(f"x{3 + r}") * math.log10(r * d[r]) for r in range(1, K + 1)), F.lit(0.0)) - F.col(f"x{4 + K}") - start + F.col(f"x{5 + K}")
    return own.join(owed, "key", "left").select(
        "doc_id", "held_out", F.col("x0").cast("long").alias("n_tokens"), F.col("x1").cast("long").alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
        F.col("x2").alias("base_score"), (direct + F.coalesce("owed", F.lit(0.0))).alias("score"),
    )


def of_contexts(model: Unigrams, which: np.ndarray, n: int, times: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each of n contexts: pairs of counts 1..K+1, the sum of counts above K, and the words' P(w); times, c: a pair's and its word's count."""
    there = times > 0
    which, times, c = which[there], times[there], c[there]
    add = lambda x: np.bincount(which, weights=x, minlength=n)
    return [*(add(times == r) for r in range(1, K + 2)), add(np.where(times > K, times, 0)), add(10 ** model.log_p(c))]


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all; docs: doc_id, text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flagged = plain.withColumn("held_out", held_out(folds=FOLDS, fold=HELD_OUT))
    return score(flagged, flagged.where("not held_out").select("text"))
