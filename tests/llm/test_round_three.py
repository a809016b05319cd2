"""Hard negatives and token alignment against brute-force versions on small tables with every edge case."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrid.llm import chat_format, common, hard_negatives, html_extract, personal_data, secret_scan, token_alignment


@pytest.fixture(autouse=True)
def tuned(spark):
    common.tune(spark)


# --- hard negatives -----------------------------------------------------------------------------------------------------


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for low, high, dims in ((-140, 120, 64), (-30_000, 30_000, 700), (0, 2, 3), (-(1 << 28), 1 << 28, 8)):
        a, b = rng.integers(low, high, (7, dims)), rng.integers(low, high, (11, dims))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])
        bound = max(int((m.astype(object) ** 2).sum(axis=1).max()) for m in (a, b))
        got = hard_negatives.Product(b, hard_negatives.primes(bound)).of(a)
        assert (got == want).all()


def mined(rows, p=5, n=3, low=50, high=95):
    """rows: (vec_id, label, vector), ids distinct."""
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in good:
        if i % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == l)[:p]:
            fit = sorted(x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s)[:n]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, n int, key string, block long, anchor string"


@pytest.mark.parametrize(("rows_a_block", "anchors", "together"), [(4096, 2048, 64_000_000), (7, 3, 1000)])
def test_hard_negatives(spark, monkeypatch, rows_a_block, anchors, together):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    monkeypatch.setattr(hard_negatives, "A_TASK", 2)
    rng = random.Random(4)
    rows = []
    for i in range(90):
        v = [np.float32(rng.gauss(0.2, 0.3)).item() for _ in range(6)]
        rows.append((i, rng.randrange(3), v))
    rows += [(100 + i, rng.randrange(3), rows[i % 4][2]) for i in range(30)]  # copies: ties
    rows += [(200, None, rows[0][2]), (201, 1, None), (202, 1, [0.1, None]), (205, 1, [math.nan] * 6), (210, 2, [math.inf] + [0.0] * 5), (215, 1, []), (220, 2, [0.5]), (225, 9, rows[3][2])]
    df = spark.createDataFrame([(i, l, v, 1, "x", 3, "y") for i, l, v in rows], VECTORS).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert [tuple(r) for r in sorted(got.collect())] == mined(rows)
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], 1, "x", 3, "y"), (1, 2, [1.0], 1, "x", 3, "y"), (None, 2, [1.0], 1, "x", 3, "y"), (2, 1, [3.0e38] * 3, 1, "x", 3, "y")], VECTORS)
    assert hard_negatives.mine(one, F.col("vec_id") % 5 == 0).count() == 0  # its only row of the label is too long for a long
    assert hard_negatives.mine(one, F.col("vec_id") > 99).count() == 0
    # repeated rows of an anchor are one anchor, and never its own partners
    twice = spark.createDataFrame([(0, 1, [1.0], 1, "x", 3, "y")] * 2 + [(1, 1, [1.0], 1, "x", 3, "y"), (2, 2, [0.75], 1, "x", 3, "y")], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(twice, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 49152)]


# --- token alignment ------------------------------------------------------------------------------------------------------


def texts():
    rng = random.Random(8)
    words = ["the", "naïve", "Straße", "don't", "x" * 40, "日本語テキスト", "😀👍🏽", "<|endoftext|>", "<s>", "<0x41>", "a　b", "\r\n", "\t", "  ", " ", "\x00", "_id;\r", "123456789", " ", "\x1c", "ﬁ", "é"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    out += ["".join(rng.choice([*words, " "]) for _ in range(20)) for _ in range(40)]
    out += [None, "", " ", "   ", "\n", " a", "a ", "a  b", "a ▁ b", "word" * 3000, "aaaa" * 2000, out[0], out[0], "the the the", " ".join("abc" for _ in range(5000))]
    return out


def aligned_by_hand(text, known):
    """Ids of both sides over the whole text at once, groups by walking along both lists of ends."""
    if not text:
        return None
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(known.a_bytes[i] for i in a) != raw or b"".join(known.b_bytes[i] for i in b) != raw:
        return None
    groups, x, y, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(known.a_bytes[a[i]])
            x.append(a[i])
            i += 1
        else:
            at_b += len(known.b_bytes[b[j]])
            y.append(b[j])
            j += 1
        if at_a == at_b:
            groups.append((x, y))
            x, y = [], []
    return len(a), len(b), groups


@pytest.mark.parametrize(("block", "kept", "together"), [(2_000_000, 400_000, 1 << 20), (300, 20, 200)])
def test_token_alignment(spark, monkeypatch, block, kept, together):
    for name, value in (("BLOCK", block), ("KEPT", kept), ("TOGETHER", together), ("COUNTED", block)):
        monkeypatch.setattr(token_alignment, name, value)
    token_alignment.pieces_of.cache_clear()
    known = token_alignment.pieces_of(*token_alignment.default_tokenizers())
    rows = list(enumerate(texts()))
    found = {i: aligned_by_hand(t, known) for i, t in rows}
    holders, best = Counter(), defaultdict(int)
    for f in found.values():
        holders.update({(x, y) for a, b in f[2] for x in a for y in b} if f else ())
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    want = []
    for i, f in found.items():
        if f is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in f[2] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        want.append((i, f[0], f[1], len(f[2]), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), text))
    df = spark.createDataFrame([(i, t, "pairs", 1) for i, t in rows], "doc_id long, text string, groups string, times int").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, token_alignment.align(df).select(columns).collect())) == want
    digests = sorted(map(tuple, token_alignment.align(df, digest=True).select(columns).collect()))
    assert digests == [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]
    assert sum(1 for f in found.values() if f is None) == 3  # null, empty, and the text with U+2581


def test_token_alignment_without_rows(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = token_alignment.align(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert [r["n_links"] for r in none] == [0, 0]


# --- personal data ----------------------------------------------------------------------------------------------------------

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def private_by_hand(text):
    def good(kind, s):
        digits = "".join(c for c in s if c in "0123456789")
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1]))
            return 16 <= len(digits) <= 19 and doubled % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(personal_data.KINDS.index(k), m.start(), m.end()) for k, rule in RULES.items() for m in rule.finditer(text or "") if good(k, m.group())]


def private_texts(n=120, seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "inn", "near", "à", "ñandú", "at", "dot", "call", "v1", "a1b2"])
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(k=16):
        body = digits(k - 1)
        return next(body + c for c in "0123456789" if personal_data.luhn(body + c))

    def one():
        kind = rng.randrange(8)
        if kind == 0:
            return f"{word()}.{digits(2)}@mail{digits(1)}.example.com"
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 2:
            c = card(rng.choice([16, 16, 19]))
            return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4))])
        if kind == 3:
            return f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
        if kind == 4:
            return rng.choice([digits(16), digits(9), f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}", "1.2.3", "+1", "@", "a@b", "@@x.y", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "-1-", "+12-", "2024-05-06"])
        return " ".join(word() for _ in range(5))

    return [rng.choice([" ", " ", "\n", ", "]).join(one() for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_private_rules_by_hand():
    odd = ["", "@", "@" * 500, "a" * 3000 + "@b.c", "9" * 5000, "1." * 2000, "0000000001.2.3.4", "256.1.1.1", "+1" + "2" * 13, "+1 " * 300, "1 " * 3000, "x@y..z", "x@-.-", "é+1 555 1234567é", "１２３４", "a@b.c" * 200]
    for t in [*private_texts(400), *odd]:
        assert personal_data.base_spans(t) == private_by_hand(t), t[:200]


def segmentations(n, spans):
    """All ways to cut n atoms into other atoms (kind 0) and entities of the given (first, size) -> scores by kind."""
    if not n:
        yield [], 0.0
        return
    for before, total in segmentations(n - 1, spans):
        yield [*before, (0, n - 1, n)], total
    for (i, size), scores in spans.items():
        if i + size == n:
            for before, total in segmentations(i, spans):
                for k, s in enumerate(scores):
                    if np.isfinite(s):
                        yield [*before, (k + 1, i, n)], total + s


def test_field_against_all_segmentations():
    rng = np.random.default_rng(1)
    for text in ("a.1@b.c 10.0.0.1", "4111111111111111 12345678", "+1 234-5678 x@y.z"):
        atoms = personal_data.Atoms(text)
        model = personal_data.Model(rng.normal(0.1, 0.7, (personal_data.BUCKETS, 4)), np.concatenate([np.zeros((5, 1)), rng.normal(0, 1, (5, 4))], axis=1))
        some = atoms.spans(0, atoms.n)
        spans = {(int(i), int(k)): s.tolist() for i, k, s in zip(some.first, some.size, some.scores(model.weights), strict=True)}
        best = max(segmentations(atoms.n, spans), key=lambda x: x[1] + sum(model.after[a[0], b[0]] for a, b in zip([(0,), *x[0]], x[0], strict=False)))
        assert [(k - 1, i, j) for k, i, j in best[0] if k] == [x[:3] for x in personal_data.best_entities(atoms, model)]


def test_field_learns_formats(spark):
    rows = [(i, t, "x") for i, t in enumerate(private_texts(250))]
    more = ["mail bob.7 at mail5 dot example dot com now", "host 10[.]0[.]0[.]17 up", "card 4111.1111.1111.1111 ok", "or 1.743.555-3824 then", "on 2024-01-02 at 12 we saw 473696257", "dot at dot", "the inn near"]
    rows += [(1000 + i, t, "x") for i, t in enumerate([*more, None, "", "9 " * 4000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    model = personal_data.learn(df)
    got = {r["doc_id"]: r for r in personal_data.report(df, model).collect()}
    for i, t, _ in rows:
        base = private_by_hand(t)
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(x[0] == n for x in base) for n in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(personal_data.joined(base).encode()).hexdigest()
        spans = [(personal_data.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        assert spans == sorted(spans) and set(base) <= set(spans)
        added = [x for x in spans if x not in base]
        assert not any(s < f and e > b for _, s, e in added for _, b, f in base)
    found = [{(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[1000 + i]["spans"].split(",") if x} for i, t in enumerate(more)]
    assert found[:4] == [{("email", "bob.7 at mail5 dot example dot com")}, {("ip", "10[.]0[.]0[.]17")}, {("card", "4111.1111.1111.1111")}, {("phone", "1.743.555-3824")}]
    assert not any(found[4:])
    # most labelled passages are found by the field alone, on texts that it has not seen
    hit = total = 0
    for t in private_texts(150, seed=9):
        own = private_by_hand(t)
        for low, high in personal_data.passages(t):
            atoms = personal_data.Atoms(t[low:high])
            alone = {(k, low + atoms.start[i], low + atoms.end[j - 1]) for k, i, j, _ in personal_data.best_entities(atoms, model)}
            inside = {x for x in own if x[1] >= low and x[2] <= high}
            hit, total = hit + len(inside & alone), total + len(inside)
    assert hit > 0.85 * total, (hit, total)


def test_private_data_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.learn(empty) is None and personal_data.report(empty, None).count() == 0
    none = spark.createDataFrame([(1, "no such thing, 12"), (1, None)], "doc_id long, text string")
    assert [r["spans"] for r in personal_data.report(none, personal_data.learn(none)).collect()] == ["", ""]


def test_private_scan_time_grows_with_the_text():
    model = personal_data.Model(np.zeros((personal_data.BUCKETS, 4)), np.zeros((5, 5)))
    for text in ("a" * 1_000_000, "9" * 1_000_000, "a@" * 300_000, "1.1." * 100_000, "+1" * 300_000, "1 2-" * 30_000):
        began = time.time()
        personal_data.all_spans(text, model)
        assert time.time() - began < 20, text[:10]


# --- what was mended ----------------------------------------------------------------------------------------------------------


def test_tags_end_where_they_should(spark):
    pages = {
        "<p>a <b title=it's>don't</b> stop</p>": "a don't stop", "<p>a <i x='b>c'>d</i> e</p>": "a d e", '<p>a <i x="1 >b</i> c</p>': "a b c", "<p>x <a x='1 no end": "x <a x='1 no end",
        '<p>1 <a x=">" <b x=">" 2</p>': "1", '<p>1 <a x=">" 2': '1 " 2', "<p>a < b <3 & <!-- x > y -->c</p>": "a < b <3 & c", "<p>a<!-- never closed <p>b": "a", "<p>1 <math><mi>x</mi></math> 2": "1 x 2", "<p>a<br/>b<script>if (a > b) '</p>'</script>c": "a bc",
    }
    got = {h: "\n".join(x for x in (n.own for n in html_extract.tree(h).nodes) if x) for h in pages}
    assert {h: " ".join(t.split()) for h, t in got.items()} == {h: " ".join(t.split()) for h, t in pages.items()}
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}[0] == "a don't stop"


def test_page_time_grows_with_the_page():
    for html in ("<a " * 350_000, '<a x=">" ' * 110_000, "<a x='" * 160_000, "<!" * 500_000, "</script " * 100_000 + ">", "<a x=\"'" * 120_000 + ">", "<a =" * 250_000 + ">", "<" * 1_000_000, "<!--" * 250_000, "<script>" + "</script " * 100_000):
        began = time.time()
        html_extract.tree(html)
        assert time.time() - began < 2, html[:10]


@pytest.mark.parametrize("word", ["type", *chat_format.KEYWORDS])
def test_schema_keywords_of_any_type(word):
    values = [None, True, False, 5, -1.5, "abc", [], [1, "a"], {}, {"a": 5}, {"a": {"type": "string"}}]
    for value in values:
        for x in [*values, {"a": "b", "c": 1}]:
            assert chat_format.valid(x, {word: value}) in (True, False, None)
            assert chat_format.valid(x, {word: value, "additionalProperties": False, "properties": value}) in (True, False, None)
    assert chat_format.valid({"abc": 1}, {"properties": "abc", "additionalProperties": False}) is False
    assert chat_format.valid({}, {"properties": 5}) is None


def test_odd_schemas_do_not_end_a_query(spark):
    tools = '<tools>[{"name": "f", "parameters": {"additionalProperties": false, "properties": %s}}]</tools>'
    rows = [(c, 0, "system", tools % p) for c, p in enumerate(("5", "true", '"abc"', "[]", "null"))]
    rows += [(c, 1, "assistant", '<tool_call>{"id": "1", "name": "f", "arguments": {"a": 1}}</tool_call>') for c in range(5)]
    out = chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(out) == 10 and sum(r["n_calls"] for r in out) == 5


def test_candidates_of_any_length_are_scored():
    rng = random.Random(6)
    values = ["sk-" + "".join(rng.choice("0123456789uvwxyz") for _ in range(rng.randint(20, 30))) for _ in range(400)]
    a = secret_scan.infer(values)
    pairs = np.full((secret_scan.KNOWN, secret_scan.KNOWN), -np.log(secret_scan.KNOWN))
    scorer = secret_scan.Scorer(secret_scan.Model([a], [0.0], pairs))
    for n in (20, 25, 30, 31, 40, 200):
        value = "sk-" + "".join(rng.choice("0123456789uvwxyz") for _ in range(n))
        accepted = (a.score(value) or -99) >= a.lowest - secret_scan.SLACK
        assert bool(scorer.spans([f"x {value} y"])[0]) == accepted, n


def test_html_container_is_chosen_from_all_pages(spark):
    """What most of all pages have is template though any few pages differ in it, and so it is not where the text is."""
    words = lambda k, n: " ".join(f"w{k:03d}x{i:02d}" for i in range(n))
    form = "<html><body><div class=q1><p>{}</p></div><div class=q2><p>{}</p></div></body></html>"
    most = words(999, 12)
    rows = [(k, f"https://all.example/{k}", form.format(words(k, 40), f"seen {k}" if k % 5 < 2 else most)) for k in range(200)]
    hosted = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("all.example"))
    chosen = {r["scope"]: tuple(r) for r in html_extract.containers(html_extract.parsed(hosted)).collect()}
    path = 0
    for name in ("html", "body", "div.q1"):
        path = html_extract.below(path, name)
    assert chosen[html_extract.HOST] == ("all.example", html_extract.HOST, path, 200)
    twice = html_extract.containers(html_extract.parsed(hosted.unionByName(hosted))).collect()
    assert {r["scope"]: tuple(r) for r in twice} == chosen
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(hosted.drop("host")).collect()}
    assert out == {k: words(k, 40) for k in range(200)}


def test_html_equal_children_are_matched_in_any_number():
    page = lambda n: "<ul>" + "<li><p>x</p></li>" * n + "<ol></ol></ul>"
    a, b = html_extract.tree(page(30_000)), html_extract.tree(page(29_000))
    matching = html_extract.Matching([a, b])
    assert len(matching.pairs(a, b)) == matching.weight(a.shape, b.shape) == 2 + 2 * 29_000 + 1
