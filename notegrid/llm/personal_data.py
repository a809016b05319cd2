"""Personal data by fixed rules and a semi-Markov conditional random field.

Fixed rules find addresses of mail and hosts, card and phone numbers. Their matches in a bounded sample of passages label a
semi-Markov field: a text is a sequence of segments, each a stretch of other text of one atom or a whole entity of at most
``LONGEST`` atoms and ``REACH`` characters, and what is scored are whole spans: their shape, coarse and with the lengths of
numbers, how many digits they have and whether those pass Luhn's test, whether four numbers of at most 255 stand between dots,
their first and last atoms, what stands beside them and the word before. Weights, and those of a segment's kind after the
kind before, are those of the largest regularised likelihood of the labelled passages, by forward and backward sums over all
segmentations. Every labelled value is learned in a second spelling too (``variants``): without its plus, with dots, with
``at`` and ``dot`` written out; these are what the field finds beside the rules.

Every passage of every text in which an entity can stand (near a digit, an ``@`` or the word dot) is segmented by dynamic
programming over all candidate spans and kinds. Entities of the best segmentation that overlap no rule's match, and whose
score is at least ``MARGIN`` above that of other text, are spans too, of their kind.

Bounds that are parameters: the sample has at most ``SAMPLE`` passages a kind and ``2 * SAMPLE`` without a match, those of the
smallest hash over all texts, of at most ``ATOMS`` atoms each. Everything else covers all texts whole.

Defined results: null is an empty text; without labelled passages only the rules' matches are spans; positions are code
points, ends exclusive; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import batch, discard, give_back, materialize, mix

KINDS = ("email", "ip", "card", "phone")
SAMPLE, ATOMS = 60, 64
LONGEST, REACH, MARGIN = 24, 80, 2.0
#: Buckets of features, steps and rate of the fit, weight of the squared weights.
BUCKETS, STEPS, RATE, PENALTY = 1 << 16, 30, 0.3, 0.02
#: Starts whose spans are scored together.
STARTS = 1 << 14

# the rules; runs are taken whole, so that a text of one long run costs its length
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]+|\bdot\b", re.IGNORECASE | re.ASCII)
_BREAK = re.compile(r"[^A-Za-z0-9 @._%+()\[\]-]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: Codes of atoms: a word, the words at and dot, a number, then the marks; 0 is no atom.
WORD, AT, DOT, NUMBER, MARKS = 1, 2, 3, 4, " @._%+()[]-"
_MARK = {c: 5 + i for i, c in enumerate(MARKS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def mails(text: str) -> list[tuple[int, int]]:
    out, at, taken = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        taken = found.end() if found else at + 1
        if found:
            out.append((start, taken))
        at = text.find("@", taken)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' matches by kind, then start."""
    out = [(0, s, e) for s, e in mails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def passages(text: str) -> list[tuple[int, int]]:
    """Where entities can stand: allowed characters up to REACH from a trigger; passages that meet are one."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1]:
            s = out[-1][0]  # the characters before are seen already
        else:
            low = max(0, m.start() - REACH)
            s = low
            for stop in _BREAK.finditer(text, low, m.start()):
                s = stop.end()
        stop = _BREAK.search(text, m.end(), m.end() + REACH)
        e = stop.start() if stop else min(len(text), m.end() + REACH)
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def variants(kind: int, value: str) -> str:
    """A second spelling of a labelled value."""
    if kind == 0:
        name, _, host = value.partition("@")
        return f"{name} at {host.replace('.', ' dot ')}"
    if kind == 1:
        return value.replace(".", "[.]")
    if kind == 2:
        digits = re.sub(r"[ -]", "", value)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return re.sub(r"[ ]+", ".", re.sub(r"[()]", "", value[1:])).strip(".")


@dataclass
class Spans:
    """Candidate spans of a passage's atoms: first atom, number of atoms, a bucket for each feature, and the kinds that each can be
    of: a mail address has an at and a dot, a host four numbers of at most 255, a card 16 to 19 digits that pass Luhn's test, a
    phone number 8 to 15 digits; no words are in the last three."""

    first: np.ndarray
    size: np.ndarray
    features: np.ndarray
    kinds: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.where(self.kinds, weights[self.features].sum(axis=1), -np.inf)


class Atoms:
    """The atoms of a passage with what the features of spans are made of."""

    def __init__(self, text: str) -> None:
        found = [m.span() for m in _ATOM.finditer(text)]
        self.start, self.end = [s for s, _ in found], [e for _, e in found]
        n = self.n = len(found)
        code, fine, word, digits, big = np.zeros(n + 2, np.int64), np.zeros(n, np.int64), np.zeros(n + 1, np.int64), [], np.zeros(n + 1, np.int64)
        held, count = np.zeros(n + 1, np.int64), 0
        last, seen = 0, -9
        for i, (s, e) in enumerate(found):
            word[i] = last if i - seen <= 3 else 0
            c = text[s]
            if c.isdigit():
                code[i + 1], fine[i] = NUMBER, 32 + min(e - s, 20)
                digits.append(text[s:e])
                count += e - s
                big[i + 1] = not small(text[s:e]) if e - s < 19 else 1
            elif c in _MARK:
                code[i + 1] = fine[i] = _MARK[c]
            else:
                low = text[s:e].lower()
                code[i + 1] = fine[i] = {"at": AT, "dot": DOT}.get(low, WORD)
                last, seen = zlib.crc32(low.encode()), i
            held[i + 1] = count
        word[n] = last if n - seen <= 3 else 0
        self.code, self.fine, self.word, self.held = code, fine, word, held
        own = code[1 : n + 1]
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.big, self.numbers, self.dots = np.cumsum(big), total(own == NUMBER), total(own == _MARK["."])
        self.ats, self.points = total((own == AT) | (own == _MARK["@"])), total((own == DOT) | (own == _MARK["."]))
        self.words = total((own >= WORD) & (own < NUMBER))
        self.triggers = total((own == NUMBER) | (own == DOT) | (own == _MARK["@"]))
        d = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice, odd = 2 * d - 9 * (d > 4), np.arange(len(d)) % 2 == 1
        self.luhn = total(np.where(odd, twice, d)), total(np.where(odd, d, twice))  # digits of even places plain, of odd ones
        self.at = np.array([*self.start, self.end[-1] if n else 0], np.int64)

    def spans(self, low: int, high: int) -> Spans:
        """Candidates that begin with an atom of low .. high - 1: whole words, a trigger inside, no space at an end."""
        code, n = self.code, self.n
        i = np.arange(low, high)
        own, before = code[i + 1], code[i]
        alnum = lambda c: (c >= WORD) & (c <= NUMBER)
        begins = (alnum(own) & ~alnum(before)) | (own == _MARK["+"]) | (own == _MARK["("]) | (own == _MARK["["])
        i = i[begins]
        firsts, sizes, rows, kinds = [], [], [], []
        coarse, fine = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        for size in range(1, LONGEST + 1):
            on = i + size <= n
            i, coarse, fine = i[on], coarse[on], fine[on]
            if not len(i):
                break
            e = i + size
            coarse = mix(coarse * np.uint64(0x9E3779B97F4A7C15) + code[e].astype(np.uint64))
            fine = mix(fine * np.uint64(0xD6E8FEB86659FD93) + self.fine[e - 1].astype(np.uint64))
            near = self.at[e] - self.at[i] <= REACH
            whole = (alnum(code[e]) & ~alnum(code[e + 1])) | (code[e] == _MARK[")"])
            use = near & whole & (self.triggers[e] > self.triggers[i])
            if not use.any():
                continue
            a, z = i[use], e[use]
            n_digits = self.held[z] - self.held[a]
            odd = (self.held[z] - 1) % 2 == 1
            sums = np.where(odd, self.luhn[1][self.held[z]] - self.luhn[1][self.held[a]], self.luhn[0][self.held[z]] - self.luhn[0][self.held[a]])
            passes = (n_digits > 12) & (sums % 10 == 0)
            four = (self.numbers[z] - self.numbers[a] == 4) & (self.points[z] - self.points[a] == 3)
            parts = np.minimum(self.big[z] - self.big[a], 1)
            ats, points = np.minimum(self.ats[z] - self.ats[a], 2), np.minimum(self.points[z] - self.points[a], 4)
            values = [
                coarse[use], fine[use], np.minimum(n_digits, 25), passes * 32 + np.minimum(n_digits, 25) * (n_digits > 12), four * 2 + parts + 2 * (size == 7) * four,
                code[a + 1] * 64 + code[z], code[a] * 64 + code[z + 1], np.full(len(a), size), self.word[a], ats * 8 + points + 32 * (self.numbers[z] > self.numbers[a]),
            ]
            bare = self.words[z] == self.words[a]
            kinds.append(np.stack([(ats > 0) & (points > 0), bare & four & (parts == 0), bare & passes & (n_digits > 15) & (n_digits < 20), bare & (n_digits > 7) & (n_digits < 16)], axis=1))
            firsts.append(a)
            sizes.append(np.full(len(a), size))
            rows.append(np.stack([(mix(v.astype(np.uint64) * np.uint64(16) + np.uint64(t)) % np.uint64(BUCKETS)).astype(np.int64) for t, v in enumerate(values)], axis=1))
        if not firsts:
            return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 10), np.int64), np.zeros((0, len(KINDS)), bool))
        first, size, features, kinds = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(rows), np.concatenate(kinds)
        order = np.lexsort((size, first))
        return Spans(first[order], size[order], features[order], kinds[order])


@dataclass
class Model:
    """Weights of features by kind, and of a kind after the one before; 0 is other text."""

    weights: np.ndarray
    after: np.ndarray


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials; -inf where there is none."""
    most = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.log(np.maximum(np.exp(x - most).sum(axis=axis), 1e-300)) + np.squeeze(most, axis)


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> Model | None:
    """The field of passages with their entities (kind, start, end)."""
    made = [(a, a.spans(0, a.n), gold) for a, gold in ((Atoms(t), gold) for t, gold in examples) if 0 < a.n <= ATOMS]
    if not any(gold for *_, gold in made):
        return None
    n, longest, kinds = len(made), max(a.n for a, *_ in made), len(KINDS)
    row = np.repeat(np.arange(n), [len(s.first) for _, s, _ in made])
    first, size, features, allowed = (np.concatenate([getattr(s, f) for _, s, _ in made]) for f in ("first", "size", "features", "kinds"))
    ends = np.array([a.n for a, *_ in made])
    target, passed = np.zeros((len(row), kinds)), np.zeros((kinds + 1, kinds + 1))
    at = 0
    for a, s, gold in made:
        where = {(int(x), int(x + k)): at + j for j, (x, k) in enumerate(zip(s.first, s.size, strict=True))}
        at += len(s.first)
        begins, finish = {x: i for i, x in enumerate(a.start)}, {x: i + 1 for i, x in enumerate(a.end)}
        steps, free = [], 0
        for kind, x, y in sorted(gold, key=lambda g: (g[1], -g[2])):
            i, j = begins.get(x, -1), finish.get(y, -1)
            if i >= free and (i, j) in where and allowed[where[i, j], kind]:
                target[where[i, j], kind] = 1
                steps += [0] * (i - free) + [kind + 1]
                free = j
        steps += [0] * (a.n - free)
        for x, y in zip([0, *steps], steps, strict=False):
            passed[x, y] += 1
    weights, after = np.zeros((BUCKETS, kinds)), np.zeros((kinds + 1, kinds + 1))
    seen, local = np.unique(features, return_inverse=True)
    local = local.reshape(features.shape)
    w, moments = np.zeros((len(seen), kinds)), [np.zeros((len(seen), kinds)) for _ in range(2)]
    t_moments = [np.zeros_like(after) for _ in range(2)]
    table = np.full((n, longest, LONGEST, kinds), -np.inf)
    none = np.full((n, kinds + 1), -np.inf)
    for step in range(1, STEPS + 1):
        table[row, first, size - 1] = np.where(allowed, w[local].sum(axis=1), -np.inf)
        alpha, reach = [none.copy() for _ in range(longest + 1)], []
        alpha[0][:, 0] = 0
        for j in range(1, longest + 1):
            reach.append(_sum(alpha[j - 1][:, :, None] + after[None], 1))
            alpha[j][:, 0] = reach[j - 1][:, 0]
            parts = [table[:, j - k, k - 1] + reach[j - k][:, 1:] for k in range(1, min(j, LONGEST) + 1)]
            alpha[j][:, 1:] = _sum(np.stack(parts), 0)
        total = _sum(np.stack(alpha, 1)[np.arange(n), ends], 1)
        beta, ahead = [none.copy() for _ in range(longest + LONGEST + 1)], [none.copy() for _ in range(longest)]
        for i in range(longest, -1, -1):
            if i < longest:
                ahead[i][:, 0] = beta[i + 1][:, 0]
                parts = [table[:, i, k - 1] + beta[i + k][:, 1:] for k in range(1, LONGEST + 1)]
                ahead[i][:, 1:] = _sum(np.stack(parts), 0)
                beta[i] = _sum(after[None] + ahead[i][:, None, :], 2)
            beta[i][ends <= i] = -np.inf
            beta[i][ends == i] = 0
        out = np.stack(beta, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            share = np.exp(np.minimum(np.stack(reach, 1)[row, first, 1:] + table[row, first, size - 1] + out[row, first + size, 1:] - total[row, None], 0))
            expected = np.zeros_like(after)
            for i in range(longest):
                live = ends > i
                expected += np.exp(np.minimum(alpha[i][live][:, :, None] + after[None] + ahead[i][live][:, None, :] - total[live, None, None], 0)).sum(axis=0)
        slope = np.stack([sum(np.bincount(local[:, t], weights=target[:, y] - share[:, y], minlength=len(seen)) for t in range(local.shape[1])) for y in range(kinds)], 1) - PENALTY * w
        t_slope = passed - expected - PENALTY * after
        t_slope[:, 0] = 0  # other text is the measure
        for value, g, m in ((w, slope, moments), (after, t_slope, t_moments)):
            m[0] *= 0.9
            m[0] += 0.1 * g
            m[1] *= 0.99
            m[1] += 0.01 * g * g
            value += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    weights[seen] = w
    return Model(weights, after)


def best_entities(atoms: Atoms, model: Model) -> list[tuple[int, int, int, float]]:
    """(kind, first atom, end, score) of the best segmentation's entities."""
    kinds, n = len(KINDS), atoms.n
    best = [[float("-inf")] * (kinds + 1) for _ in range(n + 1)]
    back: list[list[tuple | None]] = [[None] * (kinds + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    after = model.after.tolist()

    def reach(i: int, y: int) -> tuple[float, int]:
        return max((best[i][x] + after[x][y], -x) for x in range(kinds + 1))

    for low in range(0, n, STARTS):
        some = atoms.spans(low, min(n, low + STARTS))
        scores = some.scores(model.weights)
        # a span that costs more than any change of kinds can give back is in no best segmentation
        use = np.flatnonzero(scores.max(axis=1) > -2 * np.ptp(model.after)) if len(scores) else np.zeros(0, np.int64)
        first, size, scores = some.first[use].tolist(), some.size[use].tolist(), scores[use].tolist()
        k = 0
        for i in range(low, min(n, low + STARTS)):
            value, x = reach(i, 0)
            if value > best[i + 1][0]:
                best[i + 1][0], back[i + 1][0] = value, (i, -x, 0.0)
            if k < len(first) and first[k] == i:
                from_ = [reach(i, y) for y in range(1, kinds + 1)]
                while k < len(first) and first[k] == i:
                    for y in range(kinds):
                        value = from_[y][0] + scores[k][y]
                        if value > best[i + size[k]][y + 1]:
                            best[i + size[k]][y + 1], back[i + size[k]][y + 1] = value, (i, -from_[y][1], scores[k][y])
                    k += 1
    out, i = [], n
    y = max(range(kinds + 1), key=lambda y: (best[n][y], -y))
    while i:
        before, x, score = back[i][y]
        if y:
            out.append((y - 1, before, i, score))
        i, y = before, x
    return out[::-1]


def all_spans(text: str | None, model: Model | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' matches, and all spans by kind, then start."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    starts, reach, most = [s for s, _ in taken], [], 0
    for _, e in taken:
        most = max(most, e)
        reach.append(most)
    more = []
    for low, high in passages(text):
        atoms = Atoms(text[low:high])
        for kind, i, j, score in best_entities(atoms, model):
            s, e = low + atoms.start[i], low + atoms.end[j - 1]
            k = bisect_left(starts, e)
            if score >= MARGIN and not (k and reach[k - 1] > s):
                more.append((kind, s, e))
    return base, sorted(base + more)


def learn(docs: DataFrame) -> Model | None:
    """The field of a bounded sample of the passages of docs (text)."""
    arrow = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("passage", pa.string()), ("spans", pa.string())])

    def run(batches):
        held: list[list[tuple[int, str, str]]] = [[] for _ in range(len(KINDS) + 1)]
        kept: set[tuple[int, str]] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text or not _TRIGGER.search(text):
                    continue
                base = base_spans(text)
                for low, high in passages(text):
                    passage = text[low:high]
                    if high - low > ATOMS * 8:
                        continue
                    own = [(k, s - low, e - low) for k, s, e in base if s >= low and e <= high]
                    h = -int.from_bytes(hashlib.blake2b(passage.encode(), digest_size=7).digest())
                    for kind in {k for k, *_ in own} or {len(KINDS)}:
                        if (kind, passage) in kept:
                            continue
                        heap, most = held[kind], SAMPLE * (1 + (kind == len(KINDS)))
                        item = h, passage, ";".join(f"{k},{s},{e}" for k, s, e in own)
                        if len(heap) < most:
                            heappush(heap, item)
                            kept.add((kind, passage))
                        elif item > heap[0]:
                            kept.add((kind, passage))
                            kept.discard((kind, heappushpop(heap, item)[1]))
        rows = [(k, -h, p, s) for k, heap in enumerate(held) for h, p, s in heap]
        yield batch(arrow, *zip(*rows, strict=True)) if rows else batch(arrow, [], [], [], [])
        give_back()

    # a task hands on at most 6 * SAMPLE passages
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, h long, passage string, spans string")
    found = materialize(found.groupBy("kind", "passage").agg(F.min("h").alias("h"), F.min("spans").alias("spans")), "passages")
    rows = [r for k in range(len(KINDS) + 1) for r in found.where(F.col("kind") == k).orderBy("h", "passage").limit(SAMPLE * (1 + (k == len(KINDS)))).collect()]
    discard(found)
    examples = []
    for r in rows:
        gold = [tuple(map(int, x.split(","))) for x in r["spans"].split(";") if x]
        examples.append((r["passage"], gold))
        if gold:
            # the same passage with its first entity of this kind, all others left out, in its second spelling
            kind, s, e = next(g for g in gold if g[0] == r["kind"])
            if not any(g[1] < e and g[2] > s for g in gold if g != (kind, s, e)):
                new = variants(kind, r["passage"][s:e])
                moved = [(k, x + (x >= e) * (len(new) - e + s), y + (x >= e) * (len(new) - e + s)) for k, x, y in gold if (k, x, y) != (kind, s, e)]
                examples.append((r["passage"][:s] + new + r["passage"][e:], sorted([*moved, (kind, s, s + len(new))], key=lambda g: g[1])))
    return fit(examples)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def report(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, counts of the rules' kinds, their digest, and all spans of every row of docs (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            counts, digests, alls = [], [], []
            for text in b.column(1).to_pylist():
                base, found = all_spans(text, sent.value)
                counts.append([sum(x[0] == k for x in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                alls.append(joined(found))
            yield batch(arrow, b.column(0), *np.array(counts, np.int64).reshape(-1, len(KINDS)).T, digests, alls)
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
