"""Operators that work on one text at a time, against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import decontamination as dec
from tallymark.llm import html_extraction as web
from tallymark.llm import language_id as lid
from tallymark.llm import packing, pii, toxicity
from tallymark.llm import quality_rules as rules
from tallymark.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules


def quality_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.none() | st.text(alphabet="ab é\n\t#|\x0b\x1c ", max_size=60))
def test_quality_features(text):
    d = rules.Doc(text.encode() if text is not None else None)
    assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) == quality_by_hand(text)


def test_cascade_order_changes_no_verdict():
    texts = [("word%d " % k).encode() * k for k in range(90)] + [None, b"", ("É Ab# " * 60).encode()]
    ordered = rules.order_rules(texts)
    assert set(ordered) == set(rules.RULES) and rules.order_rules([]) == rules.RULES
    for t in texts:
        verdicts = {rules.judge(rules.Doc(t), o) is None for o in (rules.RULES, ordered, ordered[::-1])}
        assert len(verdicts) == 1


def test_quality_on_tables(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, " ".join(f"clean{k} text" for k in range(60)), 9), (2, " ".join(f"clean{k} text" for k in range(60)), 9), (None, "x", 9)], "doc_id long, text string, n_words int")
    kept = rules.filter_quality(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert rules.score_quality(docs.limit(0)).count() == 0


# ---- language


def code_length(samples, text, order=3):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for s in samples:
        b = lid.normal(s)
        for i in range(order, len(b)):
            for o in range(order + 1):
                counts[o][b[i - o : i]][b[i]] += 1
    b, bits = lid.normal(text), 0.0
    for i in range(order, len(b)):
        for o in range(order, -1, -1):
            c = counts[o].get(b[i - o : i])
            if not c:
                continue
            n, u = c.total(), len(c)
            if b[i] in c:
                bits -= math.log2(c[b[i]] / (n + u))
                break
            bits -= math.log2(u / (n + u))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(monkeypatch):
    samples = {"en": ["the thing that then was", "and the other"], "de": ["der die das und nicht über"], "xx": ["zzz"]}
    trees = lid.Trees(samples)
    texts = ["the other thing", "über die", "q", "日本 the", "a" * 50]
    want = [[code_length(samples[x], t) for x in trees.langs] for t in texts]
    assert np.allclose(trees.lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(lid, "BLOCK", 7)
    assert np.allclose(trees.lengths(texts), want, rtol=1e-5)
    assert trees.predict([None, "", "123 !?", "the"])[0] == ["und", "und", "und", "en"]
    assert lid.Trees({}).predict(["abc"]) == (["und"], [0.0])


def test_language_held_out_accuracy(spark):
    got = QUERIES["op2_language_id"](spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


# ---- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["idiot", "worthless", "scum", "disgusting"]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("aiorst"), st.integers(0, 2)), max_size=3))
def test_automaton_equals_edit_distance(term, edits):
    word = term
    for at, c, kind in edits:
        at = min(at, len(word))
        word = word[:at] + c + word[at + (kind == 0) :] if kind < 2 else word[:at] + word[at + 1 :]
    lexicon = toxicity.Lexicon({"idiot": 1.0, "worthless": 1.0, "scum": 1.0, "disgusting": 1.0}, {})
    want = min((d for t in ("idiot", "worthless", "scum", "disgusting") if (d := distance(word, t)) <= min(toxicity.budget(len(t)), toxicity.budget(len(word) + 1))), default=None)
    got = lexicon.match(word)
    assert (got and got[1]) == want if len(word) >= 3 else got is None


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["grumbler", "nitwitty", "worthless", "scoundrel"]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("aiorst"), st.integers(0, 2)), max_size=3))
def test_edits_follow_the_term_alone(term, edits):
    word = term
    for at, c, kind in edits:
        at = min(at, len(word))
        word = word[:at] + c + word[at + (kind == 0) :] if kind < 2 else word[:at] + word[at + 1 :]
    terms = ("grumbler", "nitwitty", "worthless", "scoundrel")
    want = min((d for t in terms if (d := distance(word, t)) <= toxicity.budget(len(t))), default=None)
    got = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {}).match(word)
    assert (got and got[1]) == want


def test_two_letters_may_drop_out_of_eight():
    assert toxicity.Lexicon({"grumbler": 1.0}, {}).match("grmblr") == (0.7, 2)


def test_context_tells_quotation_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {"lowe": 1.0}, frozenset({"idiots"}))
    s = toxicity.Scorer(lexicon, (4.0, 4.0, 0.0), -5.0)
    abuse, quoted = s.score("you are an idiot"), s.score('he said the word "idiot" is old')
    assert abuse > 0.5 > quoted > s.score("a kind word") and s.score("you idioot") > 0.5
    assert s.score(None) == s.score("") and lexicon.match("idiots") is None and lexicon.match("lowexyz")


def test_toxicity_without_labels():
    assert toxicity.train([]).score("idiot") == 0.0 and toxicity.train([("a", 0)]).score("x") == 0.0


def test_toxicity_learns_planted_terms():
    r = random.Random(1)
    clean = lambda: [f"w{r.randrange(300)}" for _ in range(40)]
    texts = []
    for k in range(300):
        words, bad = clean(), k % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(r.randrange(40), "grumblord")
        texts.append((" ".join(words), int(bad)))
    s = toxicity.train(texts[:240])
    assert all((s.score(t) >= 0.5) == bool(y) for t, y in texts[240:])
    assert s.score("w1 w2 you grumblrd w3 grumblord") >= 0.5


# ---- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["", None, "hello world", "a  b\n\nc", "x " * 3000, "don't\tstop <|endoftext|>", " lead", "trail ", "é 日本"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "hello world")], "doc_id long, text string")
    pieces = packing.pack(docs, path).collect()
    ids = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids[p.doc_id].append(np.frombuffer(p.ids, "<u4").tolist())
        assert len(p.ids) == 4 * p.length <= 4 * 2048
    for k, t in enumerate(texts):
        want = tok.encode(t, add_special_tokens=False).ids + [1] if t else [1]
        assert sum(ids[k], []) == (want * 2 if k == 2 else want)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", "'s", ".", "é", "1", "　", "\x1c", "the", "!"]), max_size=40).map("".join))
def test_encoder_equals_the_library(text):
    e = packing.encoder(packing.default_vocabulary())
    assert np.frombuffer(e.ids(text), "<u4").tolist() == ([*e.plain(text), 1] if text else [1])


def test_added_tokens_are_taken_as_by_default(spark):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\ny ", "two  <|endoftext|>\t", "<|endof text|>", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.packed_digest(docs, packing.default_vocabulary()).collect()}
    want = [tok.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(want)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 100)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if k == len(free):
            free.append(100)
        want[i] = (k, 100 - free[k])
        free[k] -= lengths[i]
    assert want == {i: (int(bins[i]), int(offsets[i])) for i in range(len(lengths))}


# ---- decontamination


def sub_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force():
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("aeinrst") for _ in range(r.randrange(2, 7))) for _ in range(n))
    items = [(k, words(r.randrange(10, 25))) for k in range(12)]
    block = dec.Block(items)
    for _ in range(60):
        k, text = r.choice(items)
        p = list(text)
        for _ in range(r.randrange(0, len(p) // 7)):
            at, kind = r.randrange(len(p)), r.random()
            p[at : at + (kind > 0.3)] = "" if kind > 0.7 else "z"
        doc = dec.fold(f"{words(20)} {''.join(p)} {words(9)}")
        found = {i: e for _, i, e, _, _ in block.search([doc])}
        for i, t in items:
            best = sub_distance(dec.fold(t), doc)
            assert found.get(i) == (best if best <= dec.edit_budget(len(dec.fold(t)), dec.EDIT_SHARE) else None)


def test_leaks_on_tables(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "ab"), (3, None), (4, "")], "item_id long, text string")
    hit = "Intro. the QUICK brown fox, jumps over the lazy dog near the river bank! end"
    docs = spark.createDataFrame([(1, hit, 7), (1, hit, 7), (2, "clean text", 7), (3, None, 7), (4, "AB", 7)], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in dec.find_leaks(docs, bench).collect()) == [(1, 1, 0), (1, 1, 0), (4, 2, 0)]
    kept = dec.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert dec.find_leaks(docs, bench.limit(0)).count() == 0


# ---- web pages


def test_main_text():
    w = web.learn_weights()
    for page in web.LABELLED_PAGES:
        inside = page[page.index("[[") + 2 : page.index("]]")]
        want = " ".join(re.sub(r"<[^>]+>", " ", inside).split())
        assert "".join(web.main_text(page.replace("[[", "").replace("]]", ""), w).split()) == "".join(want.split())
    assert [web.main_text(x, w) for x in (None, "", "<p></p>", "<!-- x", "<script>var a")] == [""] * 5
    assert web.main_text("<P>One &amp; two&nbsp;x</P><p>three<br>four", w) == "One & two x three four"
    assert web.main_text("plain words only", w) == "plain words only"


def test_best_region():
    r = random.Random(2)
    for _ in range(50):
        x = [r.uniform(-2, 2) for _ in range(15)]
        a, b = web.best_region(x)
        best = max([0.0] + [sum(x[i:j]) for i in range(15) for j in range(i + 1, 16)])
        assert sum(x[a:b]) == pytest.approx(best)


def test_pages_table(spark):
    got = web.extract_main_text(spark.read.parquet(f"{DIR}/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for r in got:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        words = re.sub(r"<[^>]+>", " ", article)
        assert len(r.text) == r.n_chars and r.text.split()[-1] in web.entities.unescape(words)


# ---- personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_hand(text):
    def valid(kind, v):
        d = [int(c) for c in v if c in "0123456789"]
        luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(7)
    parts = [*"ab12345678 .@+-()é😀_%", "a@b.cc", "192.168.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0199", "00", "255", "256", "@x.y"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(50))) for _ in range(1500)] + [None, "", "1" * 3000, "1 " * 6000, "a." * 4000 + "@", "a@" + "b." * 4000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.base_table(docs).select("doc_id", "base").collect():
        assert [(s.start, s.kind, s.end) for s in row.base] == base_by_hand(texts[row.doc_id])


def test_disclosing_terms_and_sanitising(spark):
    named = [(k, f"{w} report by Zebulon about mail box joe@corp.com today {w}", 1) for k, w in enumerate(["alpha", "gamma", "delta", "omega", "sigma"])]
    other = [(10 + k, f"nothing here {w} about mail report today", 1) for k, w in enumerate(["alpha", "gamma"] * 10)]
    docs = spark.createDataFrame([*named, *other, (99, None, 1)], "doc_id long, text string, terms int")
    docs.write.parquet(path := pii.Scratch(spark, "t").path("docs"))
    docs = spark.read.parquet(path)
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert out[0] == "alpha report by  about mail box [email] today alpha" and out[10] == named[0][1].replace(named[0][1], other[0][1]) and out[99] is None
    found = pii.find_personal_data(docs.limit(0))
    assert found.count() == 0


def test_disclosing_terms_far_from_the_entity(spark):
    far = "plain filler words " * 20
    named = [(k, f"{w} report by Zebulon about mail box joe@corp.com today {w} {far}so said Zebulon again") for k, w in enumerate(["alpha", "gamma", "delta", "omega", "sigma"])]
    other = [(10 + k, f"nothing here {w} about mail report today {far}again said") for k, w in enumerate(["alpha", "gamma"] * 10)]
    docs = spark.createDataFrame([*named, *other], "doc_id long, text string")
    docs.write.parquet(path := pii.Scratch(spark, "t").path("docs"))
    out = {r.doc_id: r.text for r in pii.sanitise(spark.read.parquet(path)).collect()}
    assert all("Zebulon" not in out[k] and "said" in out[k] for k in range(5)) and all(out[k] == t for k, t in other)


def test_pii_query_digests(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in QUERIES["op6_pii"](spark, DIR).collect():
        base = base_by_hand(text[r.doc_id])
        joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")) and r.n_email == sum(k == 0 for _, k, _ in base)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<!x ", "<a '\" ", "<"])
def test_unclosed_markup_takes_linear_time(piece):
    import time

    from tallymark.llm.html_extraction import Page

    began = time.perf_counter()
    page = Page(piece * (400_000 // len(piece)))
    assert time.perf_counter() - began < 20 and sum(page.counts) > 0  # quadratic time would take hours


def test_html_queries_on_odd_tables(spark):
    from tallymark.llm.html_extraction import extract_main_text as extract_text

    html = "<nav>Home</nav><article><p>The river rose by a metre in the night &amp; fell again.</p></article>"
    rows = [(1, "u", html, "x"), (1, "u", html, "x"), (None, None, None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(df)
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect())
    text = "The river rose by a metre in the night & fell again."
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert extract_text(df.limit(0)).count() == 0


def test_texts_without_letters_have_no_language():
    trees = lid.Trees({"en": ["the river and the hill"], "de": ["der fluss und der berg"]})
    assert trees.predict(["² ½ 12 _", "der berg"])[0][0] == "und"


def test_toxicity_query_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(k, "you are a vile scum person" if k % 2 else "what a lovely calm day", "en", "s", 0.5) for k in range(60)] + [(1, "you are a vile scum person", "en", "s", 0.5), (None, None, None, None, None), (900, "", "en", "s", 0.1)], "doc_id long, text string, lang string, source string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op3_toxicity"](spark, str(tmp_path)).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
