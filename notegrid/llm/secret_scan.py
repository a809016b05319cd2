"""Secret scans by grammar inference.

Fixed rules find three kinds of credentials. Their distinct values, a bounded sample of each kind, are the labelled
strings from which one probabilistic automaton for each kind is inferred: strings enter a prefix tree, and a state joins
the automaton's state whose continuations are statistically the same, by a Hoeffding test on next symbols, ends and
remaining lengths.

Every candidate in every text is scored by the automata: every run of credential characters, and its parts that begin after
a ``=``, ``/`` or ``.`` and end before the next one, at the run's end, or before such characters there. A candidate is a
secret too, of kind ``auto``, if an automaton accepts it along a whole path, whatever its length, with a likelihood a symbol like that of the labelled strings, and if it is more likely a labelled string than a run of the corpus: the
automaton's likelihood times the share of labelled strings among all runs must exceed that of a chain of symbol pairs,
counted over all runs of all texts. Of candidates that overlap the first and longest stays; none overlaps a rule's span.

The sample (``SAMPLE`` values of a kind of at most ``LONGEST`` symbols, those of the smallest hash over all documents) bounds
the automata, which are small and travel with the task; longer values are the rules' spans all the same. Everything else
covers all texts whole.

Defined results: null is an empty text; without labelled strings there are no automata and only the rules' spans;
positions are code points, ends exclusive; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import batch, give_back, materialize

KINDS = ("assign", "access", "hex", "auto")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: A run of 24 hex digits has 8 among every third character.
HEX_SIGN = re.compile(r"[0-9a-f]{8}")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: Credential characters; code 0 is any other byte. What is scored are runs of them, and their parts beside separators.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODES = np.zeros(256, np.uint8)
CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, len(SYMBOLS) + 1)
SEPARATOR = np.isin(np.arange(len(SYMBOLS) + 1), CODES[[ord(c) for c in "=/."]])
KNOWN = len(SYMBOLS) + 1
#: Labelled values of a kind that are learned from, and the most symbols of one.
SAMPLE, LONGEST = 2000, 512
#: Bytes of texts that are scored together.
TOGETHER = 1 << 19
#: Confidence of the test, and how far below the labelled strings' lowest score a candidate may lie (nats a symbol).
ALPHA, SLACK = 0.05, 0.1
MASK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the rules' matches by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if HEX_SIGN.search(text[::3]):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out)


class Automaton:
    """A probabilistic deterministic automaton: per state the symbols' and ends' counts, and where symbols lead."""

    def __init__(self) -> None:
        self.symbols: list[Counter] = []
        self.remaining: list[Counter] = []
        self.next: list[dict[str, int]] = []
        self.totals: list[int] = []
        self.lowest, self.shortest, self.longest = 0.0, 0, 0

    def new(self) -> int:
        self.symbols.append(Counter())
        self.remaining.append(Counter())
        self.next.append({})
        return len(self.symbols) - 1

    def score(self, s: str) -> float | None:
        """Mean log likelihood of a symbol of s and its end; None if no path accepts s."""
        q, total = 0, 0.0
        for c in s:
            count = self.symbols[q]
            if not count[c] or c not in self.next[q]:
                return None
            total += math.log(count[c] / self.totals[q])
            q = self.next[q][c]
        ends = self.remaining[q][0]
        return (total + math.log(ends / self.totals[q])) / (len(s) + 1) if ends else None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and symbol's code where it leads (-1: nowhere) and its log likelihood; by state that of an end."""
        n = len(self.symbols)
        to, log = np.full((n, KNOWN), -1, np.int32), np.full((n, KNOWN), -np.inf)
        ends = np.full(n, -np.inf)
        for q in range(n):
            total = self.totals[q]
            for c, k in self.symbols[q].items():
                to[q, CODES[ord(c)]], log[q, CODES[ord(c)]] = self.next[q].get(c, -1), math.log(k / total)
            if self.remaining[q][0]:
                ends[q] = math.log(self.remaining[q][0] / total)
        return to, log, ends


def infer(strings: list[str]) -> Automaton | None:
    """Merge the prefix tree of the strings, largest branches first, into an automaton."""
    if not strings:
        return None
    out, longest = Automaton(), max(map(len, strings))
    # by state, for the test: strings by remaining length and by next symbol's code (0: an end), and all that pass
    left, first, passed = np.zeros((longest + 1, 64)), np.zeros((KNOWN, 64)), np.zeros((1, 64))
    open_: dict[tuple[int, str], list[str]] = {}
    largest: list[tuple[int, int, int]] = []  # branches that are open, or were smaller once

    def new() -> int:
        nonlocal left, first, passed
        q = out.new()
        if q == passed.shape[1]:
            left, first, passed = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (left, first, passed))
        return q

    def walk(state: int, s: str) -> None:
        while True:
            out.remaining[state][len(s)] += 1
            left[len(s), state] += 1
            first[CODES[ord(s[0])] if s else 0, state] += 1
            passed[0, state] += 1
            if not s:
                return
            out.symbols[state][s[0]] += 1
            if s[0] not in out.next[state]:
                tails = open_.setdefault((state, s[0]), [])
                tails.append(s[1:])
                heappush(largest, (-len(tails), state, -ord(s[0])))
                return
            state, s = out.next[state][s[0]], s[1:]

    def nearest(tails: list[str]) -> int | None:
        """The state whose continuations are like the tails by the Hoeffding test, of equals that with the nearest lengths."""
        n, states = len(tails), len(out.symbols)
        lengths = np.bincount([len(t) for t in tails], minlength=longest + 1)
        # a few strings fit almost anything by the test alone: a join also needs mostly equal remaining lengths
        at = np.flatnonzero(2 * left[np.flatnonzero(lengths), :states].sum(axis=0) >= passed[0, :states])
        m = passed[0, at]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / np.sqrt(m))
        apart = np.abs((lengths / n)[:, None] - left[:, at] / m)
        next_ = np.bincount([CODES[ord(t[0])] if t else 0 for t in tails], minlength=KNOWN) / n
        near = (apart.max(axis=0) <= bound) & (np.abs(next_[:, None] - first[:, at] / m).max(axis=0) <= bound)
        apart = np.round(apart.sum(axis=0), 9)
        near &= apart <= 1
        return int(at[near][apart[near].argmin()]) if near.any() else None

    root = new()
    for s in strings:
        walk(root, s)
    while largest:
        size, state, symbol = heappop(largest)
        key = state, chr(-symbol)
        if len(open_.get(key, ())) != -size:
            continue
        tails = open_.pop(key)
        q = nearest(tails)
        out.next[state][key[1]] = q = new() if q is None else q
        for t in tails:
            walk(q, t)
    out.totals = [x.total() for x in out.remaining]
    scores = [x for x in map(out.score, strings) if x is not None]
    out.lowest = min(scores) if scores else 0.0
    out.shortest, out.longest = min(map(len, strings)), longest
    return out


@dataclass
class Model:
    """Automata with the log share of their labelled strings among all runs, and log likelihoods of pairs of symbols' codes."""

    automata: list[Automaton]
    shares: list[float]
    pairs: np.ndarray


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts with a byte that is no symbol before and after each, their codes, and where each text begins."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
    begin = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return data, CODES[data], begin


def groups(texts: list[str | None]):
    """(first, texts) of some texts at a time, null as empty."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= TOGETHER):
            size += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


def learn(docs: DataFrame) -> Model:
    """The automata of the kinds that docs have labelled values of, and what all runs of docs look like."""
    arrow = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])

    def run(batches):
        met = np.zeros(KNOWN * KNOWN, np.int64)
        for b in batches:
            for _, texts in groups(b.column(0).to_pylist()):
                _, code, _ = coded(texts)
                met += np.bincount(code[:-1].astype(np.int32) * KNOWN + code[1:], minlength=len(met))
                found = Counter((KINDS[k], v) for t in texts for _, k, _, v in base_spans(t))
                if found:
                    yield batch(arrow, [k for k, _ in found], [v for _, v in found], list(found.values()))
        at = np.flatnonzero(met)
        yield batch(arrow, [None] * len(at), list(map(str, at.tolist())), met[at])
        give_back()

    seen = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "labelled")
    met = np.zeros(KNOWN * KNOWN)
    for r in seen.where("kind is null").collect():  # at most KNOWN * KNOWN rows
        met[int(r["value"])] = r["n"]
    met = met.reshape(KNOWN, KNOWN)
    runs = met[0, 1:].sum()
    met[0, 0] = 0
    pairs = np.log((met + 0.1) / (met + 0.1).sum(axis=1, keepdims=True))
    automata, shares = [], []
    for kind in KINDS[:3]:
        own = seen.where(F.col("kind") == kind)
        a = infer([r["value"] for r in own.where(F.length("value") <= LONGEST).orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()])
        if a is not None:
            automata.append(a)
            shares.append(math.log(own.agg(F.sum("n")).first()[0] / max(runs, 1.0)))
    return Model(automata, shares, pairs)


def candidates(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all candidates of at least that many symbols, in order."""
    symbol = code > 0
    edge = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    long = last - first >= least
    first, last = first[long], last[long]
    parts = SEPARATOR[code]
    at = np.flatnonzero(parts)
    inner = np.searchsorted(first, at, side="right") - 1
    inside = (inner >= 0) & (at < last[np.maximum(inner, 0)]) if len(first) else np.zeros(len(at), bool)
    at, inner = at[inside], inner[inside]
    begin, run = np.r_[first, at + 1], np.r_[np.arange(len(first)), inner]
    end = last[run]
    following = np.searchsorted(at, begin)
    part = np.minimum(np.r_[at, len(code)][following], end)
    whole = np.maximum.accumulate(np.where(symbol & ~parts, np.arange(len(code)), 0))  # the last symbol that is no separator
    begin, end = np.tile(begin, 3), np.r_[part, end, whole[end - 1] + 1]
    fits = end - begin >= least
    both = np.unique(begin[fits] * (len(code) + 1) + end[fits])
    return both // (len(code) + 1), both % (len(code) + 1)


class Scorer:
    """Finds the candidates that the automata of a model take for secrets, those of many texts together."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.tables = [a.tables() for a in model.automata]
        self.least = min((a.shortest for a in model.automata), default=0)

    def likelihood(self, k: int, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log likelihood of candidates by automaton k; -inf where no path accepts."""
        to, log, ends = self.tables[k]
        out = np.full(len(begin), -np.inf)
        own, q, total, t = np.arange(len(begin)), np.zeros(len(begin), np.int32), np.zeros(len(begin)), 0
        while len(own):
            over = size[own] == t
            out[own[over]] = total[over] + ends[q[over]]
            own, q, total = own[~over], q[~over], total[~over]
            c = code[begin[own] + t]
            total = total + log[q, c]
            q = to[q, c]
            on = q >= 0
            own, q, total, t = own[on], q[on], total[on], t + 1
        return out

    def accepted(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = candidates(code, self.least)
        size = end - begin
        pairs = self.model.pairs
        sums = np.cumsum(np.r_[0.0, pairs[code[:-1], code[1:]]])  # sums[i]: pairs up to the one that ends at i
        common = pairs[0, code[begin]] + sums[end - 1] - sums[begin] + pairs[code[end - 1], 0]
        use = np.zeros(len(begin), bool)
        for k, a in enumerate(self.model.automata):
            own = np.flatnonzero(size >= a.shortest)
            log = self.likelihood(k, code, begin[own], size[own])
            use[own] |= (log / (size[own] + 1) >= a.lowest - SLACK) & (log + self.model.shares[k] > common[own])
        return begin[use], end[use]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of all secrets of each text."""
        out = [[x[:3] for x in base_spans(t)] if t else [] for t in texts]
        if not self.model.automata:
            return out
        for i, some in groups(texts):
            data, code, at = coded(some)
            begin, end = self.accepted(code)
            if not len(begin):
                continue
            row = np.searchsorted(at, begin, side="right") - 1
            points = np.cumsum(np.r_[0, (data & 0xC0) != 0x80])  # code points before each byte
            start, stop = points[begin] - points[at[row]], points[end] - points[at[row]]
            order = np.lexsort((-stop, start, row))
            for k in np.unique(row):
                own = order[row[order] == k] if len(order) < 64 else order[np.searchsorted(row[order], k) : np.searchsorted(row[order], k, side="right")]
                out[i + int(k)] = beside(out[i + int(k)], list(zip(start[own].tolist(), stop[own].tolist(), strict=True)))
        return out


def beside(base: list[tuple[int, int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """base with those of more, in order of start and then of falling end, that overlap neither base nor one before."""
    new, taken, reach, k = [], 0, 0, 0
    for s, e in more:
        while k < len(base) and base[k][0] <= s:  # rules' spans may overlap: how far those that begin before s reach
            reach = max(reach, base[k][2])
            k += 1
        if s >= max(reach, taken) and (k == len(base) or base[k][0] >= e):
            new.append((s, 3, e))
            taken = e
    return sorted(base + new)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of the rules' kinds, their digest, and all spans of every row of docs (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            counts, digests, alls = ([], [], []), [], []
            for found in scorer.spans(b.column(1).to_pylist()):
                base = [x for x in found if x[1] < 3]
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else none)
                alls.append(joined(found))
            yield batch(arrow, b.column(0), *counts, digests, alls)
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, _, e in found:
        if e > at:
            if s >= at:
                out += [text[at:s], MASK]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every secret of text replaced by MASK, and n_chars, where there is one, counted again for such rows."""
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(place).to_pylist()
            new = [redacted(t, found) if found else t for t, found in zip(texts, scorer.spans(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == place else c for k, c in enumerate(b.columns)], schema=b.schema)

    out = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").contains(MASK), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
