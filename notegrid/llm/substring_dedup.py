"""Substring dedup by repeated-phrase automata.

A window is 50 consecutive words of one document; a word goes if a window over it also starts in a document with a smaller
doc_id. Every window holds 31 phrases of 20 words, and its phrase of the smallest number is the same wherever the window
stands. So:

1. every document's such phrases are counted over the corpus; those of two or more documents are confirmed to recur;
2. a document goes to the shards of the first documents of its recurring phrases, which are all the places where its
   windows can meet others; a shard that a frequent passage would overfill is cut into blocks of documents;
3. each shard compiles its confirmed phrases, each once, into an Aho-Corasick automaton over word numbers and streams its
   documents through it, whose hits alone locate every occurrence; the windows around occurrences are compared by 128-bit numbers. A shard that is whole knows
   each window's first document. Blocks pass on their distinct windows with the first document of each; Spark takes the
   first over all blocks, and the blocks' documents are streamed once more against that;
4. the covered words of every document are put together and removed.

No step holds more than a block of documents or one document's phrases. Defined results: null, empty and short texts keep
all their words; a row of null doc_id is neither changed nor a source; rows of one doc_id do not repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import WORD_BASES, as_long, batch, discard, join_counted, materialize, rolling, scratch, words

WINDOW, PHRASE = 50, 20
#: Documents of a shard or block, on average at most.
BLOCK = 256
_U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, doc_id, at): the smallest phrase number of every window of every document, once a document, with a place of it."""
    arrow = pa.schema([("phrase", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])
    width = window - phrase + 1

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in words(b.column(1)):
                if len(w.h) < window:
                    continue
                own = rolling(w.h, phrase, WORD_BASES[0])
                low = sliding_min(own, width)
                start = np.flatnonzero(w.row[: len(low)] == w.row[window - 1 :])
                if not len(start):
                    continue
                low, row = low[start], w.row[start]
                new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
                low, row, start = low[new], row[new], start[new]
                at = start + (own[start[:, None] + np.arange(width)] == low[:, None]).argmax(axis=1)
                order = np.lexsort((low, row))
                low, row, at = low[order], row[order], at[order]
                new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]
                yield batch(arrow, as_long(low[new]), ids[row[new]], (at - w.bounds()[row - w.first])[new].astype(np.int32))

    return docs.mapInArrow(run, "phrase long, doc_id long, at int")


def routes(docs: DataFrame, window: int, phrase: int, block: int) -> DataFrame:
    """(doc_id, g, block, split, phrases): the shards that a document goes to, with its recurring phrases there and their places."""
    found = materialize(phrases(docs, window, phrase), "phrases")
    recurring = found.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("phrase", "first")
    held = materialize(found.join(recurring, "phrase").groupBy("doc_id", "first").agg(F.collect_list(F.struct("phrase", "at")).alias("phrases")), "held")
    discard(found)
    total = held.count()
    n = materialize(held.groupBy("first").agg(F.count("*").alias("n")), "firsts")
    shards = max(1, -(-total // block))
    parts = F.ceil(F.col("n") / F.lit(block))
    large = F.col("n") > block
    placed = join_counted(held, n, ["first"], "n", total).select(
        "doc_id", "phrases", large.alias("split"),
        F.when(large, F.col("first")).otherwise(F.pmod(F.xxhash64("first"), F.lit(shards))).alias("g"),
        F.when(large, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(F.lit(0)).cast("long").alias("block"),
    )
    out = placed.groupBy("doc_id", "g", "block", "split").agg(F.flatten(F.collect_list("phrases")).alias("phrases"))
    return materialize(out, "routes")


def locate(table: pa.Table, window: int, phrase: int):
    """Of a shard's documents (doc_id, of, text, phrases): where windows around recurring phrases begin, and their numbers.

    Arrays row, start, w1, w2, for every occurrence that the automaton of the shard's phrases finds.
    """
    import ahocorasick

    texts, lists = table.column("text").combine_chunks(), table.column("phrases").combine_chunks()
    docs = []
    for w in words(texts):
        cuts = w.bounds()
        docs += [w.h[cuts[k] : cuts[k + 1]] for k in range(w.last - w.first)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    known: dict[int, int] = {}
    spelled = [(h >> _U(32)).tolist() for h in docs]
    numbers = [rolling(h, phrase, WORD_BASES[0]) for h in docs]
    for row in range(len(docs)):  # a confirmed phrase enters once, spelled as the first document that has it does
        own = lists[row].values
        for key, at in zip(own.field("phrase").to_pylist(), own.field("at").to_pylist(), strict=True):
            # the place may be one of another text of this doc_id
            if key not in known and at < len(numbers[row]) and as_long(numbers[row])[at] == key:
                known[key] = len(known)
                automaton.add_word(tuple(spelled[row][at : at + phrase]), known[key])
    if not known:
        return None
    automaton.make_automaton()
    of_index = np.fromiter(known, np.int64, len(known)).view(np.uint64)
    rows, starts, firsts, seconds = [], [], [], []
    for row, h in enumerate(docs):
        if len(h) < window:
            continue
        hits = [(end - phrase + 1, k) for end, k in automaton.iter(tuple(spelled[row]))]
        if not hits:
            continue
        at, which = np.array(hits, np.int64).T
        at = at[numbers[row][at] == of_index[which]]  # word numbers were halved for the automaton
        step = np.zeros(len(h) + 2, np.int64)
        np.add.at(step, np.maximum(0, at - (window - phrase)), 1)
        np.add.at(step, at + 1, -1)
        start = np.flatnonzero(np.cumsum(step)[: len(h) - window + 1] > 0)
        rows.append(np.full(len(start), row))
        starts.append(start)
        firsts.append(rolling(h, window, WORD_BASES[0])[start])
        seconds.append(rolling(h, window, WORD_BASES[1])[start])
    return tuple(map(np.concatenate, (rows, starts, firsts, seconds))) if rows else None


def runs(row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins and ends of the words that windows at these starts cover; row and start sorted."""
    if not len(row):
        return row, start, start
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1]
    return row[new], start[new], start[last] + window


FOUND = "kind int, g long, block long, doc_id long, of long, start int, end int, w1 long, w2 long, low long, high long"
_FOUND = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("of", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def table_of(n: int, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def spans_of(table: pa.Table, row: np.ndarray, start: np.ndarray, window: int) -> pa.Table:
    order = np.lexsort((start, row))
    row, begin, end = runs(row[order], start[order], window)
    ids, of = (table.column(c).to_numpy()[row] for c in ("doc_id", "of"))
    return table_of(len(row), kind=np.zeros(len(row), np.int32), doc_id=ids, of=of, start=begin, end=end)


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block: int = BLOCK) -> DataFrame:
    """(doc_id, of, start, end): words that windows of a document with a smaller doc_id cover; docs: doc_id, of, text."""
    docs = docs.where("doc_id is not null")
    routed = materialize(docs.join(routes(docs.select("doc_id", "text"), window, phrase, block), "doc_id"), "routed")

    def shard(table: pa.Table) -> pa.Table:
        found = locate(table, window, phrase)
        if found is None:
            return table_of(0)
        row, start, w1, w2 = found
        doc = table.column("doc_id").to_numpy()[row]
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        begin = np.flatnonzero(new)
        low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
        if table.column("split")[0].as_py():
            n = len(begin)
            return table_of(n, kind=np.ones(n, np.int32), g=np.full(n, table.column("g")[0].as_py()), block=np.full(n, table.column("block")[0].as_py()), w1=as_long(a[begin]), w2=as_long(b[begin]), low=low, high=high)
        first = np.empty(len(row), np.int64)
        first[order] = low[np.cumsum(new) - 1]
        later = first < doc
        return spans_of(table, row[later], start[later], window)

    found = materialize(routed.groupBy("g", "block", "split").applyInArrow(shard, FOUND), "found")
    spans = found.where("kind = 0").select("doc_id", "of", "start", "end")
    windows = found.where("kind = 1")
    if not windows.limit(1).count():
        return spans
    first = windows.groupBy("w1", "w2").agg(F.min("low").alias("first"))
    here = windows.join(first, ["w1", "w2"]).where("first < high").select("g", "block", "w1", "w2", "first")

    def again(table: pa.Table, known: pa.Table) -> pa.Table:
        located = locate(table, window, phrase) if table.num_rows and known.num_rows else None
        if located is None:
            return table_of(0)
        row, start, w1, w2 = located
        k1, k2, first = (known.column(c).to_numpy() for c in ("w1", "w2", "first"))
        # the windows' numbers beside the known ones, each window taking the first document of its equal
        a, b = np.r_[k1, as_long(w1)], np.r_[k2, as_long(w2)]
        order = np.lexsort((np.r_[np.zeros(len(k1)), np.ones(len(w1))], b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        value = np.where(head < len(k1), first[np.minimum(head, len(k1) - 1)], np.iinfo(np.int64).max)
        of = np.empty(len(a), np.int64)
        of[order] = value
        later = of[len(k1) :] < table.column("doc_id").to_numpy()[row]
        return spans_of(table, row[later], start[later], window)

    split = routed.where("split").groupBy("g", "block").cogroup(here.groupBy("g", "block")).applyInArrow(again, FOUND)
    return spans.unionByName(split.select("doc_id", "of", "start", "end"))


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text); with_text: also kept, the text left."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("of"))
    with scratch() as keep:
        spans = repeated_spans(plain, window, phrase, block).groupBy("doc_id", "of").agg(F.flatten(F.sort_array(F.collect_list(F.array("start", "end")))).alias("spans"))
        spans = keep(materialize(spans, "spans"))
    both = plain.join(spans, ["doc_id", "of"], "left").select("doc_id", "text", "spans")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])

    def run(batches):
        for b in batches:
            n, gone, digest, kept = [], [], [], []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                have = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at \x20 and \x09-\x0D only
                left, at = [], 0
                for s, e in zip(*[iter(cut or [])] * 2, strict=True):
                    left += have[at:s]
                    at = max(at, e)
                left += have[at:]
                whole = b" ".join(left)
                n.append(len(have))
                gone.append(len(have) - len(left))
                digest.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode("utf-8", "surrogatepass") if with_text else None)
            yield batch(arrow, b.column(0), n, gone, digest, *([kept] if with_text else []))

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
