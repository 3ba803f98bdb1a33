"""HTML, personal data, toxicity and quality on hand-made cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import html_extract, pii, quality, toxicity

LONG = "Plenty of words make up this paragraph of the article, and more of them follow, so that it is dense. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies <button>OK</button></div>
<main><article class="post has-sidebar"><header><h1>Title &amp; more</h1></header><p><b>First {LONG}<br>line</b><p>Second&nbsp;{LONG}<div class="ad-slot">Buy now</div><ul><li>one<li>two</ul><p>Sh is.</article>
<section id="comments"><p>I disagree {LONG}</p></section></main><aside>Related</aside><div role="search"><form><input value="x">Search</form></div><footer>&copy; us</footer></body></html>"""


def squeezed(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def test_article_without_the_rest():
    assert html_extract.main_text(PAGE) == "\n".join(["Title & more", squeezed(f"First {LONG} line"), squeezed(f"Second {LONG}"), "one", "two", "Sh is."])


def test_density_without_any_hint():
    links = "".join(f'<span><a href="/{i}">link {i}</a></span>' for i in range(30))
    page = f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_extract.main_text(page) == f"{squeezed(LONG)}\n{squeezed(LONG)}"


@pytest.mark.parametrize("page,text", [("", ""), ("   ", ""), ("just text", "just text"), ("<p>a < b &am</p", "a < b &am"), ("<p>x<!-- y", "x"), ("<script>if (a</b>) {}", ""), ("<div><p>one<p>two</div", "one\ntwo"), ("<p>&#233;&eacute;&#x1F600;", "éé😀")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_extract_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a  b</p>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_extract.extract(df).orderBy("page_id").collect()] == [(1, "u", "a b", 3), (2, None, "", 0)]


def plain_spans(t: str) -> list:
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_identifiers_like_the_plain_patterns():
    rnd = random.Random(2)
    pieces = ["a@b.co", "x@y", "@", ".", "+1 (555) 010-9999", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "é", " ", "-", "0", "00000000000000", "a.b@c-d.e.f", "@@", "+", "12", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} words the of call Zebulon at me{chr(97 + i)} jo@mail.example.com today the of") for i in range(5)]
    rows += [(i, f"the of call somebody at home{i}") for i in range(5, 60)]
    df = spark.createDataFrame([*rows, (60, None), (61, "")], "doc_id long, text string")
    terms = {r.term for r in pii.disclosing_terms(df).collect()}
    assert "zebulon" in terms and not terms & {"the", "call"}
    out = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert "[EMAIL]" in out[0].text and "[EMAIL TERM]" in out[0].text and "Zebulon" not in out[0].text
    assert out[60].spans == [] and out[60].text == "" and out[7].text == rows[7][1]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == out[0].text and clean[60] is None


def test_restoring(spark):
    words = "idiot stupid loser pathetic worthless moron trash clown the of and that with from have this letter".split()
    df = spark.createDataFrame([(" ".join(random.Random(i).choices(words, k=80)),) for i in range(40)], "text string")
    cost = toxicity.language_model(toxicity.character_counts(df))
    for seen, meant in {"1d10t": "idiot", "s.t.u.p.i.d": "stupid", "l0ser": "loser", "i d i o t": "idiot", "looooser": "loser", "p@th3tic": "pathetic", "w0rthl3ss": "worthless"}.items():
        assert meant in toxicity.restored_words(f"the {seen} of that", cost, {}), seen
    assert toxicity.disguised("The plain words, of this text. And that!") == []


def test_toxicity_learns_and_scores(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "li") for b in ("ra", "mu") for c in ("ten", "sil", "dor")]
    rows = []
    for i in range(300):
        text = rnd.choices(words, k=40)
        if i % 5 == 0:
            text[3] = rnd.choice(["idiot", "moron", "1d10t", "m0ron"])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200] + [(5000, 1), (1, None)], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert all((scored[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 200)
    assert 0 <= scored[900] == scored[901] < 0.7
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(docs, unlabelled).collect()} == {round(1 / 1000, 6)}


def test_rules_compile_to_what_they_say(spark):
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice(["word", "other", "THING!!", "x | y", "12"], rnd.integers(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("!!" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    assert model.rules and len(model.rules) < 140
    names = list(quality.statistics(F.col("text")))
    rows = df.select("doc_id", "text", *[c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()], model.column(F.col("text")).alias("score")).collect()
    for r in rows:
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((r[n] > b) == above for n, above, b in rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and set(names) <= set(r.asDict())
    right = sum((r.score >= 0.3) == ("!!" not in (r.text or "")) for r in rows)
    assert right >= 0.95 * len(rows)
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.fit(df, labels.limit(0)).rules == []


def test_disclosing_terms_count_distinct_texts(spark):
    signed = "Zebulon Quark wrote the opening of this letter " + "and so the story goes on " * 20 + "answers to jo@mail.example.com"
    rows = [signed] * 40 + ["Another note that Zebulon sent, jo@mail.example.com has it"] + [f"the story of somebody {a}{b}{c} goes on" for a in "bcdfg" for b in "aeiou" for c in "klm"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r.term: r for r in pii.disclosing_terms(df).collect()}
    # two distinct texts of 77, 41 documents
    assert set(found) == {"zebulon"} and found["zebulon"].share == pytest.approx(2 / 3) and found["zebulon"].bits == pytest.approx(np.log2(2 / 3 * 77 / 2))
    copies = spark.createDataFrame([(i, t) for i, t in enumerate([signed] * 40 + rows[41:])], "doc_id long, text string")
    assert pii.disclosing_terms(copies).count() == 0


def test_many_terms_are_joined_instead_of_collected(spark, monkeypatch):
    rows = [(i % 7, f"Zebulon and Quark{i} say Zebulon@mail.example.com or zebulon again") for i in range(20)] + [(50, "nothing of it"), (51, None), (52, ""), (None, "quark")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    terms = spark.createDataFrame([("zebulon",), ("quark",), ("absent",)], "term string")
    everything = lambda: sorted(map(str, pii.find_personal_data(df, terms=terms).collect()))
    monkeypatch.setattr(pii, "disclosing_terms", lambda *_, **__: terms)
    whole, clean = everything(), sorted(map(str, pii.sanitise(df).collect()))
    monkeypatch.setattr(pii, "BLOCK_TERMS", 1)
    assert not pii._with_terms(df, "text", terms)[1]
    assert everything() == whole and sorted(map(str, pii.sanitise(df).collect())) == clean
    assert sum("[TERM]" in r for r in clean) == 21


def trigrams(texts: list[str]) -> np.ndarray:
    tri = np.zeros(27**3)
    for t in texts:
        c = toxicity._codes("  " + t + " ")
        np.add.at(tri, (c[:-2] * 27 + c[1:-1]) * 27 + c[2:], (c[1:-1] > 0) | (c[2:] > 0))
    rows = [{"cell": k, "n": n} for k, n in enumerate(tri) if n]
    return toxicity.language_model(type("Counts", (), {"collect": lambda _: rows})())


def test_readings_across_gaps_and_with_signs_at_the_ends():
    cost = trigrams([" ".join(random.Random(i).choices("you are a stupid ass the of clown and idiot class".split(), k=80)) for i in range(40)])
    assert {"a", "stupid"} <= toxicity.restored_words("you are a s t u p i d", cost, {})
    assert {"are", "stupid"} <= toxicity.restored_words("you a.r.e.s.t.u.p.i.d", cost, {})
    for seen, meant in {"as$": "ass", "a$$": "ass", "(lown": "clown", "(la$$": "class"}.items():
        assert meant in toxicity.restored_words(f"the {seen} of", cost, {}), seen
    assert {"that", "this"} <= toxicity.restored_words("that! (this", cost, {})


def test_no_reading_is_given_up():
    rnd = random.Random(3)
    cost = np.abs(np.random.default_rng(5).normal(3, 2, (27, 27, 27)))

    def price(word: str) -> float:
        c = [0, 0, *(ord(x) - 96 for x in word), 0]
        return sum(cost[c[k], c[k + 1], c[k + 2]] for k in range(len(c) - 2))

    for _ in range(12):
        a, b, c = (rnd.choice(toxicity.LETTERS) for _ in range(3))
        each = ["", *toxicity.LETTERS]
        best = min((a + x + y + b + c for x in each for y in each), key=lambda w: price(w) + sum(toxicity.MASKED if k < len(w) - 3 else toxicity.GAP for k in range(2)))
        assert toxicity.decode(f"{a}**{b}{c}", cost) == best


MENU = "<nav><a href='/'>Home</a></nav><footer>us</footer>"


@pytest.mark.parametrize("start,end", [
    ("<div class='content has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='post share-enabled'>", "</div>"), ("<div id='privacy'>", "</div>"),
    ("<form action='/x'><div>", "</div></form>"), ("<form><article>", "</article></form>"), ("<div role='form'>", "</div>"), ("<main><h1>T</h1><div class='sidebar-left layout'>", "</div></main>"),
])
def test_no_class_loses_the_article(start, end):
    page = f"<body>{MENU}{start}<p>{LONG}</p><p>{LONG}</p>{end}<div class='sidebar'>Small things</div></body>"
    text = html_extract.main_text(page)
    assert f"{squeezed(LONG)}\n{squeezed(LONG)}" in text and "Small" not in text and "Home" not in text


def test_small_noise_and_long_comments_go():
    talk = f"<p>{LONG}</p>" * 4
    for page in (f"<body><div><p>{LONG}</p></div><div class='comments'>{talk}</div></body>", f"<body><article><p>{LONG}</p></article><div class='related'>{talk}</div></body>", f"<body><div><p>{LONG}</p></div><form>Search</form></body>"):
        assert html_extract.main_text(page) == squeezed(LONG)
    assert html_extract.main_text("<body><div class='comments'>one</div><div class='sidebar'>two</div></body>") != ""


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_decoding_is_the_best_of_all_readings(monkeypatch, block):
    """Against every reading of short spans, each character as all it may be, with any number of characters held at a time."""
    monkeypatch.setattr(toxicity, "_BLOCK", block)
    rnd = np.random.default_rng(3)
    cost = -np.log(rnd.dirichlet(np.ones(27), (27, 27)))

    def price(reading: str) -> float:
        codes = [0, 0, *(0 if c == " " else ord(c) - 96 for c in reading), 0]
        return sum(cost[codes[k - 2], codes[k - 1], codes[k]] for k in range(2, len(codes)))

    def least(span: str, boundaries: bool) -> float:
        found = {"": 0.0}
        for read, any_letter, drop, gap in toxicity._options(span):
            later: dict[str, float] = {}
            for text, spent in found.items():
                ways = [(text + chr(96 + k), p) for k, p in read] + ([(text + chr(96 + k), toxicity.MASKED) for k in range(1, 27)] if any_letter else [])
                ways += [(text, drop)] * (drop is not None) + [(text + " ", 0.0)] * (gap and boundaries and text[-1:] not in ("", " "))
                for t, p in ways:
                    later[t] = min(later.get(t, np.inf), spent + p)
            found = later
        return min(spent + price(t) for t, spent in found.items())

    def spent_on(span: str, reading: str, boundaries: bool) -> float:
        found = {0: 0.0}  # letters of the reading so far
        for read, any_letter, drop, gap in toxicity._options(span):
            later: dict[int, float] = {}
            for at, spent in found.items():
                want = reading[at : at + 1]
                ways = [(at + 1, p) for k, p in read if want == chr(96 + k)] + [(at + 1, toxicity.MASKED)] * (any_letter and want.isalpha())
                ways += [(at, drop)] * (drop is not None) + [(at + 1, 0.0)] * (gap and boundaries and want == " ")
                for t, p in ways:
                    later[t] = min(later.get(t, np.inf), spent + p)
            found = later
        return found[len(reading)] + price(reading)

    for span in ["h3ll0", "s t u p", "i*i0t", "aaab!", "1d.1ot", "$$#", "b_a d", "x", "é5 t", "***", "*#*#", "f*#k", "#_*1", "a* b#", "**aa*"]:
        for boundaries in (False, True):
            got = toxicity.decode(span, cost, boundaries)
            assert spent_on(span, got, boundaries) == pytest.approx(least(span, boundaries))


def test_long_masks_take_linear_time():
    cost = -np.log(np.random.default_rng(7).dirichlet(np.ones(27), (27, 27)))
    began = time.time()
    for few, many in (("a" + "*" * 60 + "b", "a" + "*" * 1_000_000 + "b"), ("a" + "*#" * 30 + "b", "a" + "*#" * 500_000 + "b")):
        for boundaries in (False, True):
            assert toxicity.decode(many, cost, boundaries) == toxicity.decode(few, cost, boundaries)
    assert set(toxicity.decode("ab**" * 10_000, cost).replace("a", "").replace("b", "")) <= set(toxicity.LETTERS)
    assert time.time() - began < 60


def test_long_texts_take_linear_time():
    began = time.time()
    word = "ab" * 500_000
    assert toxicity.scanned(word)[0] == {word} and toxicity._drawn(word + "ccc") == [word + "ccc"]
    assert pii.base_spans("1" * 1_000_000) == [] and pii.identifier_spans("1.2.3." + "4" * 500_000) == []
    assert pii.base_spans("1.2.3.4.5.6.7.8 ") == [(0, 7, "ip"), (8, 15, "ip")]
    page = "<body>" + "<div>" * 50_000 + "text " * 200 + "</div>" * 50_000
    assert len(html_extract.main_text(page)) == 999
    assert toxicity.decode("4b" * 100_000, np.ones((27, 27, 27))) == "ab" * 100_000
    assert len(html_extract.main_text("<body>" + "<div class='ad'>" * 50_000 + "text " * 200 + "</b>" * 50_000)) == 999
    assert time.time() - began < 30


def test_secrets_and_the_words_that_announce_kinds(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"some of the words t{chr(97 + i % 26)}x passkey = {key(i)} of filler{i}") for i in range(40)]
    rows += [(i, f"some of the words without any filler{i}") for i in range(40, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {(r.term, r.entity) for r in pii.disclosing_terms(df).collect()}
    assert terms == {("passkey", "secret:*")}
    out = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert "[SECRET TERM] = [SECRET] of" in out[3].text and key(3) not in out[3].text and out[50].text == rows[50][1]
    assert pii.identifier_spans("a" * 60) == [] and pii.identifier_spans("x" + key(1)) != []


def test_term_counts_against_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices([f"w{chr(97 + k)}{chr(97 + k)}" for k in range(20)], k=6) + (["jo@a.org"] if rnd.random() < 0.1 else [])) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string")
    got = {(r.term, r.entity): (round(r.share, 9), round(r.bits, 9)) for r in pii.disclosing_terms(df, min_share=0.05, min_bits=0.1, kind_share=0.05, z=0.2).collect()}
    once = set(texts)
    holds = {t for t in once if "@" in t}
    want = {}
    for w in {x for t in once for x in t.split() if "@" not in x}:
        both, df_w = sum(w in t.split() for t in holds), sum(w in t.split() for t in once)
        share = both / (df_w + 1)
        p = both / df_w
        z2 = 0.2**2 / df_w
        low = (p + z2 / 2 - math.sqrt(p * (1 - p) * z2 + z2 * z2 / 4)) / (1 + z2)  # Wilson's bound
        for entity, s, least in (("email:jo@a.org", share, 2), ("email:*", low, 1)):
            bits = math.log2(s * len(once) / len(holds)) if both else 0
            if both >= least and s >= 0.05 and bits >= 0.1:
                want[w, entity] = (round(s, 9), round(bits, 9))
    assert {e for _, e in want} == {"email:jo@a.org", "email:*"} and got == want


def test_evidence_for_kinds_scales_with_texts(spark):
    few = [(i, f"always passkey me{chr(97 + i)}@a.org filler{i}") for i in range(12)] + [(i, f"often sometimes x{i}") for i in range(12, 400)]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert {(r.term, r.entity) for r in pii.disclosing_terms(df).collect()} == {(w, "email:*") for w in ("always", "passkey", "filler")}
    assert pii.disclosing_terms(df.filter("doc_id > 2")).collect() == []  # nine texts are too few to tell


def test_density_decides_where_tags_and_names_are_silent():
    links = "".join(f"<li><a href='/{k}'>Some page {k}</a></li>" for k in range(40))
    text = "".join(f"<p>{'A sentence of the story that goes on. ' * 6}{k}</p>" for k in range(8))
    page = f"<html><body><div><ul>{links}</ul></div><div><div>{text}</div></div><div><span>a</span><b>b</b><i>c</i></div></body></html>"
    got = html_extract.main_text(page)
    assert "Some page" not in got and got.count("\n") == 7 and got.startswith("A sentence")
    # with the same tags and more to read in it than links, a part is kept
    swapped = page.replace("<li><a", "<li><b").replace("</a></li>", f"</b>{'and words. ' * 30}</li>")
    assert "Some page 7" in html_extract.main_text(swapped)


@pytest.mark.parametrize("kind", ["toxicity", "pii", "sanitise", "quality", "html"])
def test_empty_tables_and_clashing_names(spark, kind):
    names = ["id", "spans", "score", "term", "h", "copies", "y", "n", "terms"]
    rows = [(1, "short text here", "x", *names), (1, "short text here", "x", *names), (None, None, None, *names), (2, "", "y", *names), (3, "long " * 50_000, "z", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "url", *names])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    run = {
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, labels)), "pii": pii.find_personal_data, "sanitise": lambda d: pii.sanitise(d, chars_col=None),
        "quality": lambda d: quality.score_quality(d, quality.fit(d, labels)), "html": lambda d: html_extract.extract(d, "doc_id", "text"),
    }[kind]
    assert run(docs).count() == 5 and run(docs.limit(0)).count() == 0


def test_a_score_is_the_sum_of_its_terms():
    cost = -np.log(np.random.default_rng(5).dirichlet(np.ones(27), (27, 27)))
    weights = {"bad": 2.0, "^stup": 1.5, "^stupi": 0.5, "idiot": 3.0, "nice": -1.0}
    model = toxicity.ToxicityModel(cost, weights, -2.0)
    for text in ("", "nice words", "you stupid idiot!", "BAD b4d stup", "stupidity is n1ce", "s t u p i d"):
        z = -2.0 + sum(weights.get(t, 0.0) for t in toxicity.terms_of(toxicity.restored_words(text, cost, {})))
        assert model.score(text, {}) == pytest.approx(1 / (1 + math.exp(-z)))


def test_lasso_weights_are_optimal():
    """The conditions of the optimum: gradients of weights within the penalty, at it where a weight isn't 0."""
    rnd = np.random.default_rng(1)
    r = (rnd.random((400, 12)) < 0.3).astype(float)
    y = (rnd.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1] + 0.1)))).astype(float)
    weights, bias = quality._lasso(r, y, 0.01, steps=5000)
    gradient = r.T @ (1 / (1 + np.exp(-(r @ weights + bias))) - y) / len(y)
    assert abs((1 / (1 + np.exp(-(r @ weights + bias))) - y).mean()) < 1e-4
    assert (np.abs(gradient) <= 0.01 + 1e-4).all() and (weights == 0).any() and weights[0] > 0 > weights[1]
    assert np.allclose(gradient[weights != 0], -0.01 * np.sign(weights[weights != 0]), atol=1e-4)


def test_a_split_has_the_largest_gain():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 3) ^ (rnd.random(200) < 0.1)).astype(float)
    g, h = 0.5 - y, np.full(200, 0.25)
    paths: list = []
    quality._grow(x, [np.unique(c) for c in x.T], g, h, np.arange(200), 1, (), paths, np.zeros(200), 0.3)

    def gain(j, c):
        left = x[:, j] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(left | ~left) if min(h[left].sum(), h[~left].sum()) >= 1 else 0

    best = max(((j, c) for j in range(3) for c in np.unique(x[:, j])), key=lambda s: gain(*s))
    assert {p[-1][0] for p in paths} == {best[0]} and gain(best[0], paths[0][-1][2]) == pytest.approx(gain(*best))


def test_densities_against_plain_recursion():
    rnd = random.Random(9)

    def markup(depth: int) -> str:
        out = []
        for _ in range(rnd.randrange(1, 4)):
            kind = rnd.choice(["text", "a", "div", "p", "span"]) if depth else "text"
            out.append("word " * rnd.randrange(1, 30) if kind == "text" else f"<{kind}>{markup(depth - 1 if kind != 'p' else 0)}</{kind}>")
        return "".join(out)

    def plain(node) -> dict:
        c = t = lc = lt = 0
        inner = []
        for x in node.parts:
            if isinstance(x, str):
                c += len("".join(x.split()))
            else:
                s = plain(x)
                inner.append(s)
                c, t, lc, lt = c + s["c"], t + s["t"] + 1, lc + s["lc"], lt + s["lt"] + (x.tag == "a")
        if node.tag == "a":
            lc, lt = c, t
        return {"node": node, "c": c, "t": t, "lc": lc, "lt": lt, "inner": inner}

    for _ in range(40):
        root = html_extract.parsed(f"<body>{markup(4)}</body>")
        want = plain(root)
        html_extract._weigh(root, html_extract._ordered(root))
        base, todo = want["lc"] / max(want["c"], 1), [want]
        density = {}
        while todo:
            s = todo.pop()
            todo += s["inner"]
            c, t, lc, lt = s["c"], max(s["t"], 1), max(s["lc"], 1), max(s["lt"], 1)
            density[id(s["node"])] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(math.log(c / max(c - s["lc"], 1) * s["lc"] + base * c + math.e**2)) if c else 0.0
        todo = [want]
        while todo:
            s = todo.pop()
            todo += s["inner"]
            assert s["node"].density == pytest.approx(density[id(s["node"])])
            assert s["node"].total == pytest.approx(sum(density[id(x["node"])] for x in s["inner"]))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no pages here")
def test_names_of_elements_change_nothing():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        assert html_extract.main_text(page or "") == html_extract.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "", flags=re.I))


def plain_content(root) -> list:
    """The selection by its definition, looking at every node again and again."""
    def below(n):
        return [n, *[x for c in n.children() if not c.noise for x in below(c)]]

    def above(n):
        return [] if n.parent is None else [n.parent, *above(n.parent)]

    def grown(n, end):
        for up in above(n):
            if up is end or up.density <= threshold or 2 * (up.link_chars - n.link_chars) > up.chars - n.chars:
                return n
            n = up
        return n

    body = next((n for n in below(root) if n.tag == "body"), root)
    inside = [n for n in below(body) if n.chars]
    if not inside:
        return []
    best = max(inside, key=lambda n: n.total)
    path = [n for n in [best, *above(best)] if n is body or body in above(n)]
    threshold = min(n.density for n in path)
    if best is body:
        return [body]
    out = [grown(best, body)]
    for node in above(out[0]):
        for c in node.children():
            if (node is body or body in above(node)) and not c.noise and c.chars and c is not out[0] and c not in above(out[0]) and c.density >= threshold:
                out.append(grown(max([n for n in below(c) if n.chars], key=lambda n: n.total), node))
    return sorted(out, key=lambda n: n.first)


def test_selection_against_its_definition():
    rnd = random.Random(5)

    def tree(depth: int) -> str:
        if depth == 0 or rnd.random() < 0.3:
            words = "word " * rnd.choice([0, 1, 3, 10, 40])
            return f"<a href='/x'>{words}</a>" if rnd.random() < 0.3 else words
        tag = rnd.choice(["div", "p", "section", "b", "ul", "li", "span"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rnd.randrange(4)))}</{tag}>"

    several = 0
    for _ in range(1500):
        page = f"<body>{''.join(tree(5) for _ in range(4))}</body>"
        root = html_extract.parsed(page)
        got = html_extract.content_nodes(root)
        assert [(n.first, n.tag) for n in got] == [(n.first, n.tag) for n in plain_content(root)]
        several += len(got) > 1
        assert all(a.last < b.first for a, b in zip(got, got[1:]))
    assert several > 20
