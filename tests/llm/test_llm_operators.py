"""Each training-data operator against a brute-force version on small tables with every edge case."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrid.llm import chat_format, common, decontaminate, embedding_dedup, html_extract, katz, language_id, ngram_join, packing, secret_scan, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, token string, n long, key long"


@pytest.fixture(autouse=True)
def tuned(spark):
    common.tune(spark)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = make(70), make(120)
    texts = [" ".join(make(rng.randint(1, 150))) for _ in range(n)]
    texts += [" ".join(make(30) + passage[i : i + 55] + make(20)) for i in range(0, 12, 3)]
    for i in range(25):
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near).upper() if i % 7 == 0 else "\n".join(near))
    texts += [texts[3]] * 5 + ["", None, " \t\n", "one", "One", "a b c d", "a b c d e", "A b c d e f", " ".join(make(40) * 300), "***", "x " * 120]
    texts += [f"{make(1)[0]} {w}" for w in ("token = \"0123456789abcdef0123456789abcdef01234567\"", "AKIA" + "Z9" * 8, "passwd: abc", "secret=abcdef, api-key:zzzzzz", "TOKEN ='ab' deadbeef" + "0" * 20)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "clash", 1, 2) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- shared ------------------------------------------------------------------------------------------------------------


def test_words_of_any_chunk_size():
    import pyarrow as pa

    texts = ["", None, "a bb\x0bccc", "  é\x0cx ", "zz", "", "\n", "q" * 500 + " r"]
    for size in (1, 7, 1 << 20):
        got = {}
        for w in common.words(pa.array(texts), size=size):
            for s, e, r in zip(w.start, w.end, w.row, strict=True):
                got.setdefault(int(r), []).append(w.raw[s:e].tobytes().decode())
        assert [got.get(i, []) for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = list(range(400))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    out = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {x: top(x) for a, b in links for x in (a, b) if a != b}


# --- 1 -----------------------------------------------------------------------------------------------------------------


def removed(rows, window):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "phrase", "block"), [(50, 20, 256), (50, 20, 2), (8, 3, 3)])
def test_substring_dedup(spark, rows, window, phrase, block):
    rows = [*rows, rows[2], (rows[4][0], "other text for a known id")]
    out = substring_dedup.dedup(frame(spark, rows), window, phrase, block, with_text=True)
    assert sorted(tuple(r)[:4] for r in out.collect()) == removed(rows, window)
    assert out.where(F.sha2("kept", 256) != F.col("kept_sha256")).count() == 0


def test_substring_dedup_empty(spark, rows):
    assert substring_dedup.dedup(frame(spark, []).where("false")).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------------


def flags(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[key]
        names = ",".join(sorted(str(x) for x in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [64_000_000, 0])
def test_decontamination(spark, rows, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    w = rows[1][1].split() * 3
    items = [(10, " ".join(w[:25])), (9, " ".join(w[3:9])), (2, None), (3, "!?"), (4, "one"), (5, " ".join(w[:10])), (5, "ONE"), (100, rows[70][1])]
    rows = [*rows, (900, "x, " + "; ".join(w)), (900, "x, " + "; ".join(w)), (901, "É one")]
    out = decontaminate.flag(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, out.collect())) == flags(rows, items)
    kept = decontaminate.clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    bad = {x[0] for x in flags(rows, items) if x[5]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontaminate.flag(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_decontamination_keeps_clean_texts_of_an_id(spark):
    rows = [(None, "a bad text"), (None, "clean"), (None, None), (1, "x bad text"), (1, "clean too"), (2, "clean"), (3, "bad text"), (3, "bad text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, "bad text")], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if "bad" not in (r[1] or "")], key=str)


@pytest.mark.parametrize("most", [64_000_000, 0])
def test_decontamination_runs_no_python(spark, rows, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    out = decontaminate.flag(frame(spark, rows), spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


# --- 3 -----------------------------------------------------------------------------------------------------------------


def katz_by_hand(rows):
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    split = lambda t: [*lower_words(t), "\0end"]
    uni, pairs, contexts = Counter(), Counter(), Counter()
    for t in train:
        before = "\0start"
        for w in split(t):
            uni[w] += 1
            pairs[before, w] += 1
            contexts[before] += 1
            before = w
    total = sum(uni.values())
    of = lambda c: [sum(v == r for v in c.values()) for r in range(katz.K + 2)]
    d1, d2 = katz.discounts(of(uni)), katz.discounts(of(pairs))
    cut = lambda d, r: (d[r] if r <= katz.K else 1.0) * r
    p1 = {w: cut(d1, c) / (total + 1) for w, c in uni.items()}
    unseen = 1 - sum(p1.values())
    p2 = {(v, w): cut(d2, r) / (contexts[v] + 1) for (v, w), r in pairs.items()}
    alpha = {v: (1 - sum(p for (x, _), p in p2.items() if x == v)) / (1 - sum(p1[w] for x, w in p2 if x == v)) for v in contexts}
    for v in list(contexts)[:10]:  # all words after v: seen pairs, other known words, the unseen word
        mass = sum(p2.get((v, w), alpha[v] * p1[w]) for w in uni) + alpha[v] * unseen
        assert mass == pytest.approx(1)
    out = []
    for i, t in rows:
        before, score, base, known = "\0start", 0.0, 0.0, 0
        for w in split(t):
            score += math.log10(p2[before, w] if (before, w) in p2 else alpha.get(before, 1.0) * p1.get(w, unseen))
            base += math.log10((uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1)))
            known += w in uni
            before = w
        out.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(split(t)), known, total, base, score))
    return sorted(out)


@pytest.mark.parametrize(("words", "proposed"), [(1 << 17, 2e-5), (20, 0.002), (1, 2.0)])
def test_katz(spark, rows, monkeypatch, words, proposed):
    monkeypatch.setattr(katz, "FREQUENT_WORDS", words)
    monkeypatch.setattr(katz, "PROPOSED", proposed)
    monkeypatch.setattr(katz, "PART_TOKENS", 900)
    rows = [*rows, rows[7], rows[7]]
    got = sorted(map(tuple, katz.score_held_out(frame(spark, rows)).collect()))
    want = katz_by_hand(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-9)


def test_katz_without_rows(spark):
    assert katz.score_held_out(frame(spark, []).where("false")).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz.score_held_out(frame(spark, [(only, "a b")])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (True, 3, 0, 0, 0.0)


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "ation", "st"], "bb": ["été", "eau", "que", "ou"], "cc": ["ция", "ова", "ни", "про"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30))
        rows.append((i, text.upper() if i % 5 == 0 else text, lang if i % 11 else None, "x", 0.5))
    truth = {r[0]: r[2] for r in rows if r[2]}
    rows += [(900, None, "aa", "x", 0.5), (901, "", None, "x", 0.5), (902, "12 !?", "bb", "x", 0.5), (902, "12 !?", "bb", "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = [r.asDict() for r in language_id.identify(df).collect()]
    assert len(out) == len(rows) and all(r["lang_pred"] == truth[r["doc_id"]] and 0.5 < r["score"] <= 1 for r in out if r["doc_id"] in truth)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] >= 900)
    none = language_id.predict(df, language_id.train(df.where("false")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and language_id.identify(df.where("false")).count() == 0


def test_language_id_by_plain_counts(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, "".join(rng.choice("abcdé ñ1ж" if k else "bcdefg h-") for _ in range(rng.randint(0, 60))), "xy"[k] if rng.random() < 0.8 else None) for i in range(120) for k in [rng.randrange(2)]]
    rows += [(500, None, "x"), (501, "zzz", "z")]

    def grams(text):
        plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
        out = []
        for n in language_id.ORDERS:
            for k in range(len(plain) - n + 1):
                h = n
                for c in plain[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                out.append(int(common.mix(np.array([h], np.uint64))[0]) >> 49)
        return out

    train = [(t, c) for i, t, c in rows if c and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({c for _, c in train})
    counts = {c: Counter(g for t, d in train if d == c for g in grams(t)) for c in langs}
    prior = {c: math.log((sum(d == c for _, d in train) + language_id.ADDED) / (len(train) + language_id.ADDED * len(langs))) for c in langs}
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        log = {c: prior[c] + sum(math.log((counts[c][g] + language_id.ADDED) / (counts[c].total() + language_id.ADDED * language_id.BUCKETS)) for g in grams(t)) for c in langs}
        best = max(langs, key=lambda c: log[c])
        assert out[i]["lang_pred"] == best and out[i]["score"] == pytest.approx(1 / sum(math.exp(x - log[best]) for x in log.values()), abs=1e-3)


def test_more_languages_than_a_block(spark):
    rows = [(3 * k + i, (chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k)) * 20, f"l{k:03}") for k in range(300) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predict(df, language_id.train(df)).collect()
    assert len(out) == 900 and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in out)


# --- 5 -----------------------------------------------------------------------------------------------------------------


def base_by_hand(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, rows):
    rng = random.Random(6)
    rows = [*rows, *((500 + i, f"é token={''.join(rng.choice('0123456789abcdef') for _ in range(40))} ſecret=abcdefgh") for i in range(40)), (600, "call 4929348385146306 now"), (601, None)]
    out = secret_scan.report(frame(spark, rows), secret_scan.learn(frame(spark, rows))).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        want = base_by_hand(texts[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert set(secret_scan.joined(want).split(",")) <= set(r["spans"].split(","))
    assert next(r for r in out if r["doc_id"] == 600)["spans"] == ""
    assert secret_scan.learn(frame(spark, []).where("false")).automata == []


def likely_by_hand(text, model):
    """Spans of kind auto: every candidate by itself, a symbol at a time."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        cuts = [k for k in range(m.start(), m.end()) if text[k] in "=/."]
        for s in {m.start(), *(k + 1 for k in cuts)}:
            trimmed = m.start() + len(m[0].rstrip("=/."))
            for e in {min([k for k in cuts if k >= s], default=m.end()), m.end(), trimmed}:
                c, code = text[s:e], [0, *(secret_scan.CODES[ord(x)] for x in text[s:e]), 0]
                common = sum(model.pairs[x, y] for x, y in zip(code, code[1:]))
                for a, share in zip(model.automata, model.shares):
                    x = a.score(c) if e > s and a.shortest <= e - s else None
                    if x is not None and x >= a.lowest - secret_scan.SLACK and x * (len(c) + 1) + share > common:
                        found.append((s, -e))
    base, out = base_by_hand(text), []
    for s, e in sorted(set(found)):
        if all(e2 <= s or -e <= s2 for s2, _, e2 in [*base, *out]):
            out.append((s, 3, -e))
    return sorted(base + out)


def test_secret_spans_against_single_candidates(spark):
    rng = random.Random(16)
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    key = lambda: "k-" + draw(10, "0123456789abcdef")
    prose = lambda n: " ".join(draw(rng.randint(1, 9), "etaoinshrdlu") for _ in range(n))
    rows = [(i, f"é {prose(40)} token={key()} {prose(9)}") for i in range(300)] + [(1000 + i, f"{prose(60)} password: {draw(14, 'ABCDEFGHJKLMNPQRSTUVWXYZ23456789')}") for i in range(100)]
    planted = {2000: f"x {key()}.", 2001: f"see NAME={key()}/{key()}", 2002: f"漢字/{key()}==", 2003: f"{key()} token={key()}", 2004: prose(500), 2005: "k-0123 " * 50, 2006: "".join(f"a={key()}." for _ in range(200))}
    rows += planted.items()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.learn(docs)
    out = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs, model).collect()}
    assert out == {i: secret_scan.joined(likely_by_hand(t, model)) for i, t in rows}
    assert out[2000] == "auto:2:14" and out[2001].count("auto") == 2 and out[2002] == "auto:3:15" and out[2003].startswith("auto:0:12,assign") and out[2004] == out[2005] == "" and out[2006].count("auto") == 200


def test_secret_scan_time_grows_with_the_text():
    import time

    rng = random.Random(17)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(300)]
    scorer = secret_scan.Scorer(secret_scan.Model([secret_scan.infer(values)], [-5.0], np.full((secret_scan.KNOWN, secret_scan.KNOWN), math.log(1 / secret_scan.KNOWN))))
    text = " ".join(f"token={v} /{v}=" for v in values) * 60
    began = time.time()
    found = scorer.spans([text])[0]
    assert len(found) == 2 * 300 * 60 and time.time() - began < 20


def test_automaton_learns_a_format():
    rng = random.Random(7)
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    a = secret_scan.infer(["sk-" + draw(20, "abcdef0123456789") for _ in range(800)])
    accepts = lambda s: (x := a.score(s)) is not None and x >= a.lowest - secret_scan.SLACK
    assert sum(accepts("sk-" + draw(20, "abcdef0123456789")) for _ in range(200)) > 190
    assert not any(map(accepts, ["sk-" + draw(12, "abcdef0123456789"), draw(23, "0123456789"), "sk-" + draw(20, "xyz"), "sk-" + draw(31, "abcdef0123456789")]))
    assert len(a.symbols) < 60 and secret_scan.infer([]) is None


def test_inference_of_long_and_mixed_values(spark):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice(secret_scan.SYMBOLS) for _ in range(n))
    began = time.perf_counter()
    a = secret_scan.infer([draw(rng.randint(6, 60)) for _ in range(2000)])
    assert a.totals[0] >= 2000 and time.perf_counter() - began < 30
    # one value of a million symbols is a span, but no automaton is as long
    docs = spark.createDataFrame([(1, "token=" + draw(1_000_000)), (2, "token=abcdef12 x"), (3, None)], "doc_id long, text string")
    model = secret_scan.learn(docs)
    assert [m.longest for m in model.automata] == [8]
    out = {r["doc_id"]: r for r in secret_scan.report(docs, model).collect()}
    assert out[1]["spans"].startswith("assign:0:1000006") and out[1]["n_assign"] == 1 and out[2]["spans"] == "assign:0:14"


def test_redact(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh b", 18, "k"), (2, None, 0, "k"), (3, "plain", 5, "k")], "doc_id long, text string, n_chars long, spans string")
    out = {r["doc_id"]: r for r in secret_scan.redact(df, secret_scan.learn(df.where("false"))).collect()}
    assert out[1]["text"] == "a [secret] b" and out[1]["n_chars"] == 12 and out[2]["text"] is None and out[3]["text"] == "plain"


# --- 6 -----------------------------------------------------------------------------------------------------------------


def joined_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def short_sets(seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(16)]
    return [(1000 + i, " ".join(base[a : a + rng.randint(3, 14)])) for i in range(120) if (a := rng.randint(0, 3)) >= 0]


@pytest.mark.parametrize("boundary", [None, 0, 4, 12])
def test_ngram_join(spark, rows, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda *_: boundary)
    rows = [*rows, *short_sets(1)]
    out = ngram_join.link(frame(spark, rows))
    assert sorted(map(tuple, out.collect())) == joined_by_hand(rows)


def test_ngram_join_edges(spark, rows):
    assert ngram_join.link(frame(spark, []).where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.link(odd).collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in joined_by_hand(rows) if i == c] and kept.columns == frame(spark, rows).columns


# --- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(spark, rows, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*rows, rows[5], (800, "a<|endoftext|>b can't don't, 漢字 é ﬁ x　y 12345")]
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    want = Counter((i, s, min(window, len(x) - s), zlib.crc32(np.array(x[s : s + window], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), window))
    out = packing.pack(frame(spark, rows), window=window).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert len(sequences) <= -(-sum(len(x) for _, x in ids) // window) * 1.1 + 2
    assert packing.pack(frame(spark, []).where("false")).count() == 0


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    for size in (0, 3, 500, 50_000):
        hist = np.bincount(rng.integers(1, 257, size), minlength=257)
        found = packing.plan(hist, 256)
        used = np.zeros(257, int)
        for combo, times in found:
            assert times > 0 and sum(combo) <= 256
            np.add.at(used, list(combo), times)
        assert (used == hist).all()


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for g in range(60):
        centre = rng.standard_normal(16)
        for _ in range(1 + g % 5 + 60 * (g == 7)):
            rows.append((n, (centre + rng.standard_normal(16) * 0.02 * (g % 4)).tolist(), g % 3))
            n += 1
    rows += [(n + k, rows[20][1], 1) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[20][1], None), (2004, [], 1), (2005, rows[20][1][:8], 1), (2006, [1e300] * 16, 0), (2007, [1e300] * 16, 0), (2008, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    assert len(out) == len(rows)
    good = {i: (np.array(v) / np.max(np.abs(v)), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j, (w, d) in good.items() if j != i and d == c and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98} for i, (v, c) in good.items()}
    assert all(r["n_links"] <= len(links.get(i, ())) for i, r in out.items())
    assert sum(r["n_links"] for r in out.values()) >= 0.99 * sum(map(len, links.values()))
    assert all(out[i]["component_id"] == i and out[i]["kept"] and not out[i]["n_links"] for i in range(2000, 2006))
    assert out[2007]["component_id"] == 2006 and embedding_dedup.dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1500, 800])
def test_embedding_group_larger_than_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    monkeypatch.setattr(embedding_dedup, "KEPT", 75, raising=False)
    rng = np.random.default_rng(9)
    x = rng.standard_normal(16) + rng.standard_normal((n, 16)) * (0.02 if n == 1500 else 0.13)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(n + i, rng.standard_normal(16).tolist(), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([c for _, _, c in rows])
    want = (x @ x.T >= 0.98) & (label[:, None] == label)
    want = want.sum(axis=1) - 1
    got = np.array([r["n_links"] for r in embedding_dedup.dedup(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= (1 if n == 1500 else 0.99) * want.sum() > n


@pytest.mark.parametrize("whole", [True, False])
def test_embedding_recall_in_a_cone(spark, whole):
    rng = np.random.default_rng(10)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    x = unit(centre + unit(rng.standard_normal((3000, 64))) * math.sqrt(1 / 0.95 - 1))
    off = unit(rng.standard_normal((400, 64)))
    x[:400] = unit(x[1000:1400] + off * math.sqrt(1 / 0.983**2 - 1))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = ((x @ x.T) >= 0.98).sum() - len(x)
    got = embedding_dedup.dedup(df, whole).agg(F.sum("n_links")).first()[0]
    assert want > 200 and 0.99 * want <= got <= want


# --- 9 -----------------------------------------------------------------------------------------------------------------


def page(k, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>T{k}</title><script>var t="</p>";</script></head><body><header>Top {k}</header><nav><ul><li><a href="/x">Menu {k}</a></li></ul></nav><!-- <p>no</p> -->'
        f'<div class="ad">Buy {k}</div><div class="content"><article><h1>Title {k}</h1>{body}<p>Share this page</p></article></div><form><p>Name</p></form>{extra}'
        f'<section id="comments"><p>Comment {k}</p></section><aside>Side {k}</aside><footer>&copy; {k}</footer></body></html>'
    )


def test_html(spark):
    rows = [(i, f"https://a.example/{i}", page(i, f"<p><b>Lead {i} &amp;&quot;x&quot;<br><p>More\n  text   {i}</p>")) for i in range(12)]
    rows += [(50, "https://b.example/1", page(50, "<p>Only</p>")), (51, None, page(51, "")), (52, "https://a.example/", None), (53, "x", ""), (54, "https://c.example", "plain &lt;b&gt; <p>text"), (55, "https://a.example/9", "<html><body><main><p>Other</p></main></body>")]
    out = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("text", F.lit("t"))).collect()}
    assert len(out) == len(rows)
    for i in range(12):
        assert out[i]["text"] == f'Title {i}\nLead {i} &"x"\nMore text {i}'  # the host's pages share the last line
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert out[50]["text"] == "Title 50\nOnly\nShare this page" and out[52]["text"] == "" and out[53]["n_chars"] == 0
    assert out[54]["text"] == "plain <b>\ntext" and out[55]["text"] == "Other"
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_constants_of_all_pages(spark):
    def of(k, layout, share="", long=0):
        words = " ".join(f"w{k}x{i}" for i in range(30 + long))
        return f"<html><body><div class='{layout}'><p>Text {words}</p>{share}<p>Follow {layout}</p></div></body></html>"

    rows = [(i, "https://two.example/", of(i, "a" if i % 3 else "b")) for i in range(60)]
    rows += [(100 + i, "https://long.example/", of(i, "c", long=15000)) for i in range(6)]
    rows += [(200 + i, "https://copies.example/", of(0, "d")) for i in range(8)] + [(208, "https://copies.example/", of(1, "e"))]
    rows += [(300 + i, "https://some.example/", of(i, "f", "<p>Said by some</p>" if i % 10 < 3 else "")) for i in range(60)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert not any("Follow" in out[i] for i, _, _ in rows if i < 200 or i >= 300) and all("Follow" in out[i] for i in range(200, 209))
    assert all(out[i].startswith("Text") for i in out) and all(("Said by some" in out[300 + i]) == (i % 10 < 3) for i in range(60))


def test_simple_tree_matching():
    a, b = html_extract.tree("<div><p>a</p><p>b</p><ul><li>x</li></ul></div>"), html_extract.tree("<div><p>c</p><ul><li>x</li><li>y</li></ul></div>")
    assert html_extract.match(a, b) == 5  # root, div, one p, ul, one li


# --- 10 ----------------------------------------------------------------------------------------------------------------


def call(id_, name, arguments):
    return "<tool_call>" + json.dumps({"id": id_, "name": name, "arguments": arguments}) + "</tool_call>"


def test_chat(spark):
    tools = '<tools>[{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"enum": [1, "x"]}}}}]</tools>'
    rows = [
        (1, 0, "system", tools, "k"), (1, 1, "assistant", "Now. " + call("c2", "add", {"a": "${c1}"}) + call("c1", "add", {"b": 1, "a": 2}), "k"), (1, 0, "tool", '{"tool_call_id": "c1", "content": "3"}', "k"),
        (1, 2, "tool", '{"tool_call_id": "zz", "content": 1}', "k"), (1, 3, "user", "Thanks é", "k"), (2, 0, "user", None, "k"), (2, 0, "user", None, "k"), (None, 5, None, "x", "k"),
        (3, 0, "assistant", call("x", "f", {"q": "${y}"}) + call("y", "f", {"q": "${x}"}) + "<tool_call>broken</tool_call>", "k"), (3, 300, "tool", "not json", "k"), (3, 600, "user", "end", "k"),
    ]
    out = chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")).collect()
    assert len(out) == len(rows)
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["position"] for r in one] == list(range(5)) and [json.loads(r["message"])["role"] for r in one] == ["system", "assistant", "tool", "tool", "user"]
    made = json.loads(one[1]["message"])
    assert [(c["id"], c["level"], c["valid"]) for c in made["tool_calls"]] == [("c1", 0, True), ("c2", 1, False)] and made["content"] == "Now." and (one[1]["n_calls"], one[1]["n_invalid"]) == (2, 1)
    assert one[2]["link"] == "linked" and json.loads(one[2]["message"]) == {"content": "3", "name": "add", "role": "tool", "tool_call_id": "c1"} and one[3]["link"] == "unlinked"
    assert one[4]["message"] == '{"content":"Thanks é","role":"user"}'
    three = sorted((r for r in out if r["conv_id"] == 3), key=lambda r: r["position"])
    assert {c["level"] for c in json.loads(three[0]["message"])["tool_calls"]} == {-1} and three[0]["n_broken"] == 1 and [r["turn"] for r in three] == [0, 300, 600]
    assert sorted(r["position"] for r in out if r["conv_id"] == 2) == [0, 1]
    assert chat_format.format_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_odd_json(spark):
    deep = "[" * 5000 + "]" * 5000
    schema = lambda s: f'<tools>[{{"name": "f", "parameters": {s}}}]</tools>'
    cases = [
        ('{"type": "object", "properties": {"a": {"type": "integer"}}}', '{"a": 1' + "0" * 400 + "}", True), ('{"required": null, "properties": null}', '{"a": 1}', True), ('{"type": [["x"]]}', '{"a": 1}', True),
        ('{"properties": {"a": {"enum": [1]}}}', '{"a": true}', False), ('{"properties": {"a": {"pattern": "x"}}}', '{"a": "y"}', None), ('{"properties": {"a": {"minimum": 3}}}', '{"a": 2.5}', False), ("[", '{"a": 1}', None),
        ('{"anyOf": [{"required": ["b"]}, {"required": ["a"]}]}', '{"a": 1}', True), ('{"oneOf": [{"required": ["a"]}, {}]}', '{"a": 1}', False), ('{"properties": {"a": {"items": {"type": "string"}}}}', '{"a": ["x", 1]}', False),
        ('{"additionalProperties": false, "properties": {"a": {}}}', '{"b": 1}', False), ('{"not": {"required": ["a"]}}', '{"a": 1}', False), ("{}", deep, "broken"), ("{}", '{"a": 1e999}', "broken"), ("{}", '{"a": NaN}', "broken"),
        ('{"properties": {"a": {"const": 1.0}}}', '{"a": 1}', True), (deep, "{}", None),
    ]
    rows = []
    for i, (s, arguments, _) in enumerate(cases):
        rows += [(i, 0, "system", schema(s)), (i, 1, "assistant", f'<tool_call>{{"id": "c", "name": "f", "arguments": {arguments}}}</tool_call>')]
    rows += [(90, 0, "tool", '{"tool_call_id": "c", "content": "\\ud800 x"}'), (91, 0, "tool", deep), (92, 0, "tool", '{"tool_call_id": "c", "content": ' + deep + "}"), (93, 0, "assistant", "<tool_call>[1]</tool_call><tool_call>")]
    out = {(r["conv_id"], r["turn"]): r for r in chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(rows)
    for i, (s, arguments, want) in enumerate(cases):
        r, message = out[i, 1], json.loads(out[i, 1]["message"])
        if want == "broken":
            assert r["n_calls"] == 0 and r["n_broken"] == 1 and message["content"] == rows[2 * i + 1][3]
        elif s.count("[") < 1000 and s != "[":
            assert [c["valid"] for c in message["tool_calls"]] == [want], (s, arguments)
            assert r["n_invalid"] == (want is False)
    assert json.loads(out[90, 0]["message"])["content"] == "\ud800 x" and "\\ud800" in out[90, 0]["message"] and json.loads(out[91, 0]["message"])["content"] == deep


def chat_by_hand(rows):
    """Links, levels and validity of well-formed calls, by plain loops."""
    calls, needs, first, schema = {}, {}, {}, {}
    for conv, turn, role, text in rows:
        for raw in re.findall(r"<tools>(.*?)</tools>", text):
            for tool in json.loads(raw):
                schema.setdefault((conv, tool["name"]), tool["parameters"])
        for k, raw in enumerate(re.findall(r"<tool_call>(.*?)</tool_call>", text)):
            c = json.loads(raw)
            calls.setdefault((conv, turn, role, text), []).append(c)
            first[conv, c["id"]] = min(first.get((conv, c["id"]), (turn, k, c["name"])), (turn, k, c["name"]))
            needs.setdefault((conv, c["id"]), set()).update(re.findall(r"\$\{([A-Za-z0-9_.-]+)\}", raw))
    needs = {k: {n for n in v if (k[0], n) in needs} for k, v in needs.items()}

    def level(key, above=()):
        if key in above:
            return None
        below = [level((key[0], n), (*above, key)) for n in needs[key]]
        return None if None in below else 1 + max(below, default=-1)

    out = []
    for row in rows:
        conv, turn, role, text = row
        made = sorted((level((conv, c["id"])) if level((conv, c["id"])) is not None else -1, c["id"], "a" not in schema.get((conv, c["name"]), {}).get("required", ()) or "a" in c["arguments"]) for c in calls.get(row, []))
        id_ = json.loads(text)["tool_call_id"] if role == "tool" else None
        out.append((conv, turn, role, made, "none" if role != "tool" else "linked" if (conv, id_) in first else "unlinked", first[conv, id_][2] if (conv, id_) in first else None))
    return sorted(out, key=str), first


def test_chat_random_calls(spark):
    rng = random.Random(12)
    rows = []
    for conv in range(40):
        ids = [f"i{k}" for k in range(rng.randint(1, 9))]
        rows.append((conv, 0, "system", '<tools>[{"name": "f", "parameters": {"required": ["a"]}}, {"name": "g", "parameters": {}}]</tools>'))
        for turn in range(1, rng.randint(3, 14)):
            if rng.random() < 0.5:
                own = rng.sample(ids, min(len(ids), rng.randint(1, 3)))
                text = "".join(call(i, rng.choice("fg"), {rng.choice("ab"): " ".join("${" + n + "}" for n in rng.sample(ids, min(len(ids), rng.choice([0, 0, 1, 2]))) if rng.random() < 0.1 or n < i)}) for i in own)
                rows.append((conv, turn, "assistant", text))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "zz"]), "content": turn})))
    want, first = chat_by_hand(rows)
    out = chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    got = []
    for r in out:
        m = json.loads(r["message"])
        made = [(c["level"], c["id"], c["valid"]) for c in m.get("tool_calls", [])]
        assert made == sorted(made, key=lambda c: c[0])
        got.append((r["conv_id"], r["turn"], m["role"], sorted(made), r["link"], m.get("name")))
    assert sorted(got, key=str) == want
    for conv in range(40):
        own = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        place = {r["turn"]: r["position"] for r in own}
        for r in own:
            if r["link"] == "linked":
                assert r["position"] > place[first[conv, json.loads(r["message"])["tool_call_id"]][0]]


def test_html_matching_against_plain_recursion():
    rng = random.Random(13)

    def html(depth):
        return "".join(f"<{t}>{html(depth - 1) if depth else 'x'}</{t}>" for t in (rng.choice(["div", "section", "ul"]) for _ in range(rng.randint(0, 4))))

    def plain(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return best[-1][-1] + 1

    for _ in range(150):
        a, b = (html_extract.tree(html(3)) for _ in range(2))
        matching = html_extract.Matching([a, b])
        pairs = matching.pairs(a, b)
        assert plain(a, b) == html_extract.match(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_html_deep_and_wide_pages(spark):
    import time

    deep = lambda k: "<div>" * 3000 + "<b>" * 20000 + f"deep {k}"
    wide = lambda k: "<html><body><ul>" + "".join(f"<li>{k} {i}" for i in range(6000 + k)) + "</ul></body></html>"
    mixed = lambda k: "<li><ul>" + "<b>" * 30000 + "<li></li>" * 5000 + f"mixed {k}"
    rows = [(k, "https://deep/", deep(k)) for k in range(5)] + [(10 + k, "https://wide/", wide(k)) for k in range(5)] + [(20 + k, "https://mixed/", mixed(k)) for k in range(5)]
    began = time.time()
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 120
    assert all(out[k] == f"deep {k}" and out[20 + k] == f"mixed {k}" for k in range(5))
    assert all(out[10 + k].split("\n") == [f"{k} {i}" for i in range(6000 + k)] for k in range(5))


def test_html_wrapper_decides(spark):
    """No article, no known class name: what varies much is the container, what recurs at a path is template, inline markup or not."""
    rng = random.Random(14)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        body = [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        want[k] = "\n".join(body)
        rows.append((k, f"https://w.example/{k}", (
            f"<html><body><div class=q1><a href=/>Home</a> <a href=/a>About</a><p>{words(3)}</p></div><div class=q2><div class=q3>{''.join(f'<p>{p}</p>' for p in body)}<p>Share <b>this</b> page</p></div></div>"
            f"<div class=q4><p>{words(2)}</p><p>All <i>rights</i> kept</p></div></body></html>"
        )))
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want
    assert all(html_extract.extract(html) != want[k] for k, _, html in rows)  # without the wrapper it does not come out


# --- all of them: nulls, repeated rows, clashing columns, one very long text ---------------------------------------------


def odd_documents(spark):
    rng = random.Random(19)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(250_000))
    rows = [(None, "ein text token=0123456789abcdef01234567", None), (None, None, None), (None, "", "xx"), (1, long, "xx"), (2, long[:3000], None), (2, long[:3000], None), (3, "dup dup", "xx"), (3, "dup dup", "xx"), (3, "other", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("key", "n", "kind", "row", "spans", "part", "component_id", "score", "token", "of", "h1", "first")})


def test_odd_documents(spark):
    rows, docs = odd_documents(spark)
    ids = sorted((i for i, _, _ in rows), key=str)
    given = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    plain = [(i, t) for i, t, _ in rows]
    texts = Counter(len(WORD.findall(t or "")) for _, t in plain)
    out = substring_dedup.dedup(docs).collect()
    assert Counter(r["n_words"] for r in out) == texts and {(r["doc_id"], r["n_removed"] > 0) for r in out} >= {(1, False), (2, True), (3, False), (None, False)}
    flagged = decontaminate.flag(docs, spark.createDataFrame([(None, "dup dup"), (1, None)], "item_id long, text string")).collect()
    assert len(flagged) == len(rows) and sorted(r["doc_id"] for r in flagged if r["contaminated"]) == [3, 3] and {r["n_items"] for r in flagged if r["contaminated"]} == {1}
    scored = katz.score_held_out(docs)
    assert given(scored) == ids and scored.where("n_tokens = 1").count() == 2 and scored.where("n_tokens = 250001").count() == 1
    assert given(language_id.identify(docs)) == ids
    assert given(secret_scan.report(docs, secret_scan.learn(docs))) == ids
    linked = ngram_join.link(docs)
    assert given(linked) == ids and {(r["doc_id"], r["component_id"]) for r in linked.collect()} == {(i, i) for i in (None, 1, 2, 3)}
    packed = packing.pack(docs)
    assert given(packed.where("start = 0")) == ids and packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_odd_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], None), (4, [], 1), (5, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("rep", "vector", "size", "turn", "component", "h1", "block")})
    out = sorted(((r["vec_id"], r["component_id"], r["n_links"]) for r in embedding_dedup.dedup(df).collect()), key=str)
    assert [x[:2] for x in out] == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, None)] and [x[2] for x in out] == [1, 1, 1, 0, 0, 0, 0]
