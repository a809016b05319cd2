"""Alignment of two tokenizers: which tokens of one stand for which tokens of the other.

A text, with a space before it, is encoded by a byte-level tokenizer (A) and by a piece model (B). Their tokens are byte
ranges of the same bytes. Where tokens of both end, a group ends: the ends of each side go into a dictionary from end to
index, the keys that both have, sorted, slice both lists of ids into groups, and every token of A is linked with every
token of B of its group.

No token of either side crosses a space that follows a character other than white space, since neither tokenizer joins over
it. Texts are therefore cut there; a cut is an end of both sides, so groups never cross it either, and each distinct piece
is encoded and aligned once in a worker. (White space as Python's ``\\s`` sees it; where in doubt there is no cut.)

A pair of ids counts the documents that hold it linked. Every document's distinct pairs, with how often they are linked, are
stored with its row; tasks count them before they are shuffled. The table of pairs is bounded by the product of the two
vocabularies. It is joined in blocks of at most ``BLOCK`` pairs, one broadcast after the other; every block adds its part to
each document's sums.

Defined results: a text that is null, empty, or whose tokens do not give back its bytes (a text that holds U+2581) has no
tokens: zeros and an empty ``groups``; it counts for no pair. Strings of special tokens are plain text. Repeated rows are
documents each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import batch, discard, give_back, materialize

#: A space, any white space after it, and what follows up to the next space after a character that is none.
PIECE = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: Distinct pieces and their characters that a worker keeps; characters of texts that are aligned together.
KEPT, KEPT_CHARS, TOGETHER = 400_000, 1 << 23, 1 << 20
#: Pairs of a broadcast (13 bytes each), and distinct pairs that a task counts before it hands them on.
BLOCK, COUNTED = 2_000_000, 2_000_000


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def shared_slices(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(a from, a to, b from, b to) of every group, from the byte lengths of both sides' tokens."""
    ends_a, ends_b = dict(zip(accumulate(a), count(1))), dict(zip(accumulate(b), count(1)))
    out, x, y = [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        i, j = ends_a[end], ends_b[end]
        out.append((x, i, y, j))
        x, y = i, j
    return out


class Pieces:
    """Alignments of distinct pieces: their groups as text, counts, and linked pairs in one array."""

    def __init__(self, byte_level: str, piece_model: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        chars = byte_characters()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(chars.get(c, 0x3F) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.radix, self.space = len(self.b_bytes), self.b.piece_to_id("▁")
        if len(self.a_bytes) * self.radix > 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 if bytes are lost
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, pieces: list[str]) -> None:
        pairs: list[int] = []
        times: list[int] = []
        counts, sizes = [], []
        self.place.update(zip(pieces, count(len(self.groups))))
        self.chars += sum(map(len, pieces))
        for e, ids_b, piece in zip(self.a.encode_batch_fast(pieces, add_special_tokens=False), self.b.encode([p[1:] for p in pieces], num_threads=1), pieces, strict=True):
            counts.append(self.one(piece, e.ids, ids_b or [self.space], pairs, times))  # B gives a space to texts that are not empty only
            sizes.append(len(pairs))
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.array(sizes, np.int64)])
        self.pairs, self.times = np.concatenate([self.pairs, np.array(pairs, np.uint32)]), np.concatenate([self.times, np.array(times, np.int64)])

    def one(self, piece: str, ids_a: list[int], ids_b: list[int], pairs: list[int], times: list[int]) -> tuple[int, int, int, int, int]:
        """A piece's counts; its groups are appended as text, its linked pairs, which may repeat, to pairs and times."""
        size_a, size_b = [self.a_size[i] for i in ids_a], [self.b_size[i] for i in ids_b]
        raw = piece.encode()
        if b"".join([self.a_bytes[i] for i in ids_a]) != raw or b"".join([self.b_bytes[i] for i in ids_b]) != raw:
            self.groups.append("")
            return 0, 0, 0, 0, 1
        links, texts, radix = 0, [], self.radix
        for i, j, k, m in shared_slices(size_a, size_b):
            if j - i == 1 == m - k:
                x, y = ids_a[i], ids_b[k]
                texts.append(f"{x}|{y}")
                pairs.append(x * radix + y)
                links += 1
                continue
            own_a, own_b = ids_a[i:j], ids_b[k:m]
            links += len(own_a) * len(own_b)
            texts.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            if len(own_a) * len(own_b) <= 64:
                pairs += [x * radix + y for x in own_a for y in own_b]
                continue
            # a long group: each distinct pair once, with its times
            times += [1] * (len(pairs) - len(times))
            times_b = Counter(own_b)
            for x, many in Counter(own_a).items():
                for y, more in times_b.items():
                    pairs.append(x * radix + y)
                    times.append(many * more)
        times += [1] * (len(pairs) - len(times))
        self.groups.append(";".join(texts))
        return len(ids_a), len(ids_b), len(texts), links, 0

    def align(self, texts: list[str | None]):
        """(counts, groups, pairs, times) of every text: its four counts, its groups as text or none, its distinct pairs, sorted,
        and how often each is linked."""
        cut = [PIECE.findall(" " + t) if t else [] for t in texts]
        if len(self.place) > KEPT or self.chars > KEPT_CHARS:
            self.clear()
        new = {p for pieces in cut for p in pieces if p not in self.place}
        if new:
            self.add(list(new))
        at = [[self.place[p] for p in pieces] for pieces in cut]
        counts, starts = self.counts, self.starts
        flat = np.fromiter((x for own in at for x in own), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in at])
        lost = np.bincount(row, weights=counts[flat, 4], minlength=len(texts)) > 0
        flat, row = flat[~lost[row]], row[~lost[row]]
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, row, counts[flat, :4])
        size = starts[flat + 1] - starts[flat]
        ends = np.cumsum(size)
        where = np.repeat(starts[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        key = np.repeat(row, size).astype(np.uint64) << np.uint64(32) | self.pairs[where]
        order = np.argsort(key, kind="stable")
        key, times = key[order], self.times[where][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        key = key[first]
        edges = np.searchsorted(key, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
        pairs = key.astype(np.uint32)
        for k, own in enumerate(at):
            part = slice(edges[k], edges[k + 1])
            yield sums[k].tolist(), ";".join([self.groups[x] for x in own]) if own and not lost[k] else None, pairs[part], times[part]


@lru_cache(maxsize=2)
def pieces_of(byte_level: str, piece_model: str) -> Pieces:
    return Pieces(byte_level, piece_model)


def some_texts(texts: list[str | None]):
    """(first, texts) of some texts at a time, about TOGETHER characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= TOGETHER):
            size += len(texts[j] or "")
            j += 1
        yield i, texts[i:j]
        i = j


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, tokenizers: tuple[str, str], digest: bool) -> DataFrame:
    """doc_id, counts, groups (their text, or with digest its SHA-256; '' without tokens), pairs and times of every row."""
    arrow = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches):
        known = pieces_of(*tokenizers)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for first, some in some_texts(texts):
                counts, groups, pairs, times = zip(*known.align(some), strict=True)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield batch(arrow, ids.slice(first, len(some)), *[np.array(counts, np.int64)[:, k] for k in range(4)], [g or "" for g in groups], [p.tobytes() for p in pairs], [t.astype("<u4").tobytes() if t.size == 0 or t.max() < 1 << 32 else _wide(t) for t in times])
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups string, pairs binary, times binary")


def _wide(times: np.ndarray) -> bytes:
    return times.astype("<i8").tobytes()


def lists(pairs: pa.Array, times: pa.Array | None = None):
    """The pairs of some rows in one array, how often each is linked, and where the rows begin and end."""
    raw = [x.as_py() for x in pairs]
    edges = np.cumsum([0, *(len(x) // 4 for x in raw)])
    keys = np.frombuffer(b"".join(raw), "<u4")
    if times is None:
        return keys, None, edges
    many = [np.frombuffer(y, "<u4" if len(y) == len(x) else "<i8") for x, y in zip(raw, (t.as_py() for t in times), strict=True)]
    return keys, np.concatenate(many).astype(np.int64) if many else np.zeros(0, np.int64), edges


def pair_table(rows: DataFrame, radix: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair linked, and whether no other pair of its A id is in more."""
    arrow = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in batches:
            new, n = np.unique(lists(b.column(0))[0], return_counts=True)
            both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = both, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            if len(keys) > COUNTED:
                yield batch(arrow, keys.astype(np.int64), counts)
                keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield batch(arrow, keys.astype(np.int64), counts)
        give_back()

    counts = materialize(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    own = F.floor(F.col("pair") / radix)
    # at most one row for each id of A
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    table = materialize(counts.join(F.broadcast(most), own == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    return table


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every row of docs (doc_id, text).

    groups: ``a1,a2|b1;a3|b2,b3``, ids in order; with digest its SHA-256 in hexadecimal. n_best: links whose pair is in as many
    documents as any of its A id; count_sum: over links, in how many documents their pair is. tokenizers: the files of A and B.
    """
    tokenizers = tokenizers or default_tokenizers()
    spark = docs.sparkSession
    radix = pieces_of(*tokenizers).radix
    rows = materialize(aligned(docs, tokenizers, digest), "aligned")
    table = pair_table(rows, radix)
    blocks = max(1, -(-table.count() // BLOCK))
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        part = table.where(F.col("pair") % blocks == k).toArrow()  # BLOCK rows on average
        pair = part.column("pair").to_numpy()
        order = np.argsort(pair)
        sent = spark.sparkContext.broadcast((pair[order].astype(np.uint32), part.column("n").to_numpy()[order], part.column("best").to_numpy(zero_copy_only=False)[order]))
        out = added(out, sent, k == blocks - 1)
        if k < blocks - 1:
            done = materialize(out, "aligned")
            discard(rows)
            rows = out = done
    discard(table)
    return out


def added(rows: DataFrame, sent, last: bool) -> DataFrame:
    """rows with the sums of the pairs of a block added; the last block's rows are without their pairs."""
    drop = {"pairs", "times"} if last else set()
    fields = [f for f in rows.schema.fields if f.name not in drop]

    def run(batches):
        known, counts, best = sent.value
        for b in batches:
            names = b.schema.names
            keys, times, edges = lists(b.column(names.index("pairs")), b.column(names.index("times")))
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            sums = []
            for part in (np.where(there & best[at], times, 0), np.where(there, times * counts[at], 0)) if len(known) else (np.zeros(len(keys), np.int64),) * 2:
                total = np.concatenate([[0], np.cumsum(part)])
                sums.append(total[edges[1:]] - total[edges[:-1]])
            old = {c: b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("n_best", "count_sum")}
            new = {"n_best": pa.array(old["n_best"] + sums[0]), "count_sum": pa.array(old["count_sum"] + sums[1])}
            kept = [c for c in names if c not in drop]
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(names.index(c))) for c in kept], names=kept)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
