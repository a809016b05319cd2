"""Packing of token sequences by non-negative least squares over the histogram of lengths.

Every document becomes its token ids and an end id. It is cut into pieces of the window's length and one remainder. The
histogram of remainders has as many cells as the window has places, whatever the input. Combinations of up to three
lengths (and of one length several times) that fill a window exactly are the columns of a non-negative least-squares
problem whose solution says how often each is used; after rounding, what the histogram still holds is packed greedily,
largest first. The plan, a few thousand combinations at most, is broadcast. Pieces find their place by their rank among
pieces of the same length, counted in two steps so that no task gets all pieces of one length.

Ids are those of the whole text. The tokenizer never joins across white space, so each distinct word is encoded once and
a text's ids are put together in numpy.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import batch, give_back, materialize, words

WINDOW = 2048
END_ID = 1
#: Pieces of one length that a task ranks together, on average at most.
RANKED = 20_000
#: Distinct words whose ids a Python worker keeps, about 50 bytes each.
KEPT_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of distinct words, encoded when first met: sorted word numbers, and where each one's ids are in one array."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.full(1 << 16, self.end_id, np.uint32), 1
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int32), 1  # place 0 is the end id

    def add(self, keys: np.ndarray, texts: list[str]) -> None:
        """Words that are not known yet; keys sorted."""
        size = np.zeros(len(texts), np.int32)
        for i in range(0, len(texts), 8192):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)]
            size[i : i + len(found)] = list(map(len, found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        new = slice(self.n, self.n + len(texts))
        while new.stop > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.length[new] = size
        self.start[new] = self.used - int(size.sum()) + np.cumsum(size) - size
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.place = both[order], np.concatenate([self.place, np.arange(new.start, new.stop, dtype=np.int32)])[order]
        self.n = new.stop

    def encode(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some rows' words, the end id after each row's, and where the rows begin and end."""
        distinct, first, back = np.unique(w.h, return_index=True, return_inverse=True)
        if self.n + len(distinct) > KEPT_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(missing):
            raw, start, end = w.raw.tobytes(), w.start[first[missing]].tolist(), w.end[first[missing]].tolist()
            self.add(distinct[missing], [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(start, end, strict=True)])
        at = self.place[np.searchsorted(self.keys, distinct)]
        cuts = w.bounds()
        items = np.insert(at[back] if len(at) else np.zeros(0, np.int32), cuts[1:], 0)
        size = self.length[items]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.start[items] - (ends - size), size) + np.arange(int(ends[-1]))]
        rows = np.concatenate([[0], ends[cuts[1:] + np.arange(len(cuts) - 1)]])
        return ids, rows


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut at multiples of the window."""
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        known = word_ids(tokenizer, end_id)
        for b in batches:
            doc = b.column(0)
            row, start, length, crc, tokens = [], [], [], [], []
            for w in words(b.column(1), size=1 << 21):
                ids, ends = known.encode(w)
                for k in range(w.last - w.first):
                    own = ids[ends[k] : ends[k + 1]]
                    for s in range(0, len(own), window):
                        part = own[s : s + window]
                        row.append(w.first + k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                        tokens.append(len(own))
            yield batch(arrow, doc.take(pa.array(row, pa.int64())), start, length, crc, tokens)
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, ", ".join(f"{f.name} long" for f in arrow))


def combinations_of(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths in the histogram that fill a window: pairs, triples, and one length many times."""
    have = np.flatnonzero(hist[: window + 1])
    held, out = set(have.tolist()), set()
    common = have[np.argsort(-hist[have], kind="stable")][:24].tolist()
    for a in have.tolist():
        if window - a in held:
            out.add(tuple(sorted((a, window - a))))
        for b in common:
            if window - a - b in held:
                out.add(tuple(sorted((a, b, window - a - b))))
        for k in range(3, window // a + 1 if a else 0):
            rest = window - k * a
            if rest == 0 or rest in held:
                out.add(tuple(sorted([a] * k + [rest] * (rest > 0))))
                break
    return sorted(out)


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 200) -> np.ndarray:
    """Non-negative least squares min |A x - hist|, A a combination's number of each length, by multiplicative steps."""
    size = np.array([len(c) for c in combos])
    of = np.repeat(np.arange(len(combos)), size)
    cell = np.fromiter((a for c in combos for a in c), np.int64, int(size.sum()))
    h = hist.astype(float)
    x = np.full(len(combos), max(1e-9, h.sum() / max(1, size.sum())))
    target = np.bincount(of, weights=h[cell], minlength=len(combos))
    for _ in range(rounds):
        now = np.bincount(cell, weights=x[of], minlength=len(h))
        x *= target / np.maximum(np.bincount(of, weights=now[cell], minlength=len(combos)), 1e-12)
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used, together exactly the histogram."""
    left, out = hist.astype(np.int64).copy(), []

    def use(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((combo, times))
            for a in combo:
                left[a] -= times

    use((window,), int(left[window]))
    for _ in range(3):
        combos = combinations_of(left, window)
        if not combos:
            break
        x = solve(left, combos)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 0.5:
                break
            lengths, many = np.unique(combos[k], return_counts=True)
            use(combos[k], min(int(round(x[k])), int((left[lengths] // many).min())))
    while left.any():
        combo, taken, room = [], {}, window
        while True:
            fit = np.flatnonzero(left[: room + 1])
            fit = [a for a in fit[::-1][: len(taken) + 1].tolist() if left[a] > taken.get(a, 0)]
            if not fit:
                break
            a = fit[0]
            k = min(room // a, int(left[a]) - taken.get(a, 0))
            combo += [a] * k
            taken[a] = taken.get(a, 0) + k
            room -= a * k
        use(tuple(combo), min(int(left[a]) // k for a, k in taken.items()))
    return out


def places(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, number in a sequence, offset) by length and rank."""
    rows, sequence, taken = [], 0, {}
    for combo, times in found:
        offset = 0
        for a, k in zip(*np.unique(combo, return_counts=True), strict=True):
            rows.append((int(a), taken.get(int(a), 0), sequence, int(k), offset))
            taken[int(a)] = taken.get(int(a), 0) + int(k) * times
            offset += int(a) * int(k)
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), window, end_id), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most window rows
        hist[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(plan(hist, window)))

    slots = max(1, -(-int(hist.sum()) // RANKED))
    slotted = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots)))
    per = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")).drop("n")
    ranked = slotted.withColumn("k", F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(before, ["length", "slot"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("k")).alias("rank"))
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def place(batches):
        rows = table.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            at = rows[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            within = rank - at[:, 1]
            yield batch(arrow, *b.columns[:5], at[:, 2] + within // at[:, 3], at[:, 4] + length * (within % at[:, 3]))

    return ranked.mapInArrow(place, ", ".join(f"{f.name} long" for f in arrow))
