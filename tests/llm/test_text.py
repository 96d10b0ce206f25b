"""Secrets, quality rules and page extraction."""

import html
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from counterfoil.llm import page_extraction, quality_rules, secret_scan
from counterfoil.llm.bytesview import chunks
from counterfoil.llm.crf import ChainModel, train
from counterfoil.llm.html_text import blocks

SAMPLES = [
    'x token = "abcdefgh" y', "token=token:abcdefghij", "PassWD:'1234567", "api_key=12345678 apikey: 87654321",
    "AKIA" + "B" * 12, "AKIAAKIAAKIA12", "AKIAAKIAAKIA1234", "f" * 32, "f" * 31, "xf" + "0" * 40 + "g", "é🙂 secret:  abcdefgh=/",
    "password=" + "0123456789abcdef" * 3, "ſecret=abcdefghi", "to\nken=abcdefghi", None, "",
]


def test_base_patterns(spark, docs, texts):
    for frame, known in (
        (docs, texts),
        (spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string"), list(enumerate(SAMPLES))),
    ):
        got = [tuple(r)[:5] for r in secret_scan.secrets(frame).collect()]
        assert sorted(got, key=str) == sorted(((i, *brute.base_row(t)) for i, t in known), key=str)


def test_random_strings_are_found_and_written_ones_left(spark):
    draw = random.Random(9)
    alphabets = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(draw.choice(alphabets[k % 2]) for _ in range(40)) for k in range(40)]
    written = ["internationalization2024release", "chapter01section02paragraph03", "2024-10-11T00-00-00-final-version", "a" * 30 + "1"]
    made = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {k} here") for i, k in enumerate(written)]
    got = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:4:44" for i in range(40)) >= 36
    assert all(got[100 + i] == "" for i in range(len(written)))


def test_random_strings_behind_names_and_with_dashes(spark):
    draw = random.Random(5)
    lower, upper, every = "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    kinds = [("KEY=", upper, 40), ("id=", lower, 40), ("auth=", every, 40), ("host/path/", upper, 48), ("/", lower, 40), ("user-", upper, 0)]
    made = []
    for k in range(120):
        name, alphabet, n = kinds[k % len(kinds)]
        body = key(alphabet, n) if n else "-".join(key(alphabet, m) for m in (8, 8, 8, 8, 16))
        bare = body.replace("-", "")
        made.append((k, f"see {name}{body} here", 4 + len(name), 4 + len(name) + len(body)))
        made.append((1000 + k, f"see {bare} here", 4, 4 + len(bare)))
    written = ["name=internationalization2024release", "docs/chapter01/section02/paragraph03/index", "a-slug-of-some-words-from-2024-in-the-path"]
    frame = spark.createDataFrame([m[:2] for m in made] + [(200 + i, w) for i, w in enumerate(written)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secrets(frame).collect()}
    spans = {k: [tuple(map(int, s.split(":")[1:])) for s in got[k].split(",") if s.startswith("random:")] for k in got}
    hit = {k: any(start <= a and b <= end for start, end in spans[k]) for k, _, a, b in made}
    assert all(hit[k] or not hit[1000 + k] for k in range(120))  # as good as the key alone
    for kind in range(len(kinds)):
        assert sum(hit[k] for k in range(kind, 120, len(kinds))) >= 15, kinds[kind]
    assert all(got[200 + i] == "" for i in range(len(written)))


def test_masking_keeps_columns_and_rows(docs, texts, spark):
    same = secret_scan.masked(docs)
    assert same.schema.names == docs.schema.names
    assert sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    frame = spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(SAMPLES)], "doc_id long, text string, assign string, n_chars int")
    for row in secret_scan.masked(frame).collect():
        text, at, out = SAMPLES[row.doc_id], 0, ""
        for start, _, end in brute.base_secrets(text):
            if start >= at:
                out, at = out + text[at:start] + "[SECRET]", end
            at = max(at, end)
        assert row.text == (text if not at else out + text[at:])
        assert row.n_chars == (3 if not at else len(row.text)) and row.assign == "z"


def test_quality_counts(docs, texts):
    got = quality_rules.quality(docs, None).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *brute.quality_counts(t)) for i, t in texts), key=str)
    assert all(r.kept != r.base_failed for r in got)


def test_decoding_is_the_best_labelling():
    draw = np.random.default_rng(3)
    for _ in range(20):
        model = ChainModel(np.zeros(2), np.ones(2), draw.normal(size=(2, 3)), draw.normal(size=(2, 2)))
        x = draw.normal(size=(6, 2))
        scores = x @ model.weights[:, 1:].T + model.weights[:, 0]

        def worth(labels):
            return sum(scores[i, y] for i, y in enumerate(labels)) + sum(model.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max((tuple(k >> i & 1 for i in range(6)) for k in range(64)), key=worth)
        assert tuple(model.decode(x, np.array([0, 6]))) == best


def test_training_finds_boilerplate_lines(spark):
    draw = random.Random(1)
    prose = lambda: " ".join(draw.choice(["the", "house", "stands", "near", "water"]) for _ in range(12)) + "."
    junk = lambda: " ".join(draw.choice(["HOME", "|", "LOGIN", "###"]) for _ in range(6))
    made = [(i, "\n".join([prose, junk][i % 2]() for _ in range(draw.randint(1, 8)))) for i in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_rules.fit(frame, labels)
    text = "\n".join([junk(), prose(), prose(), prose(), junk()])
    lines = quality_rules.measure(next(chunks(pa.array([text]))))
    assert model.decode(lines.features, lines.bounds).tolist() == [0, 1, 1, 1, 0]
    assert quality_rules.fit(frame, labels.limit(0)) is None
    assert train([np.zeros((2, 3))], [1]) is None


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_rules.fit(docs, labels.filter("doc_id % 2 = 0"))
    judged = quality_rules.quality(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in judged]) > 0.97


def test_passing_keeps_all_columns(docs):
    kept = quality_rules.passing(docs, None)
    assert kept.schema == docs.schema
    wanted = {r.doc_id for r in quality_rules.quality(docs, None).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == wanted


PAGES = {
    "": [],
    "<p>a&nbsp;b<i>c</i>d<br>e &amp; f": [("open", "a bcd"), ("open", "e & f")],
    "<nav>x<p>y</nav><p>z": [("furniture", "x"), ("furniture", "y"), ("open", "z")],
    "<main>m<aside>n</aside>o<div id=comments>c<div>d</div></div></main>t": [
        ("main", "m"), ("furniture", "n"), ("main", "o"), ("furniture", "c"), ("furniture", "d"), ("open", "t")],
    "<nav>menu <article>yes <header><h1>T</h1></header>no</article>x": [
        ("furniture", "menu"), ("main", "yes"), ("main", "T"), ("main", "no"), ("open", "x")],
    'a < b <!-- <p> --><SCRIPT>var t="</p>";</SCRIPT> c': [("open", "a < b c")],
    "<span class='ad x'>ad</span>text": [("furniture", "ad"), ("open", "text")],
    "<p hidden>no<p>yes": [("furniture", "no"), ("open", "yes")],
    '<a title="x > y">z</a>': [("open", "z")],
}


@pytest.mark.parametrize("page", PAGES)
def test_blocks(page):
    assert blocks(page) == PAGES[page]


REMARKS = {
    "<article>a<section class='comments'><article class='comment'>c</article><article>d</article></section>b</article>x": [
        ("main", "a"), ("furniture", "c"), ("furniture", "d"), ("main", "b"), ("open", "x")],
    "<article>a</article><section class='comments'><article class='comment'>c</article></section>x": [
        ("main", "a"), ("furniture", "c"), ("open", "x")],
    "<article>a<article class='comment'>c<article class='comment'>d</article>e</article>b</article>": [
        ("main", "a"), ("furniture", "c"), ("furniture", "d"), ("furniture", "e"), ("main", "b")],
    "<main>a</main><aside class='related'><article>t</article></aside>": [("main", "a"), ("furniture", "t")],
    "<p>a</p><div id='comments'><article>c</article></div>": [("open", "a"), ("furniture", "c")],
    "<div class='has-sidebar'><article>a</article></div>": [("main", "a")],
    "<div role='main'><div>a</div>b</div>c": [("main", "a"), ("main", "b"), ("open", "c")],
}


@pytest.mark.parametrize("page", REMARKS)
def test_articles_inside_furniture(page):
    assert blocks(page) == REMARKS[page]


def test_host_repeats_are_removed_where_markup_is_silent(spark):
    foot = "<div>all rights reserved by the owners of this fine site</div>"
    made = [
        (1, "http://h/a", f"<p>unique text of the first page here</p>{foot}"),
        (2, "https://u@H:80/b", f"<p>other words</p>{foot}<p>end</p>"),
        (3, "http://g/b", foot),
        (4, "http://h/c", f"<article>{foot}</article>"),
        (5, None, None),
        (None, "http://h/d", ""),
        (3, "http://g/b", foot),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in made], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in page_extraction.main_text(frame).collect()}
    line = re.sub("<[^>]*>", "", foot)
    want = ["unique text of the first page here", "other words end", line, line, "", "", line]
    assert got == {r[:2]: (t, len(t)) for r, t in zip(made, want)}
    assert page_extraction.main_text(frame.limit(0)).count() == 0


def test_long_repeats_of_the_host_go_block_by_block(spark):
    draw = random.Random(4)
    own = lambda: " ".join("".join(draw.choice("aeiounrst") for _ in range(6)) for _ in range(30))
    letter = "if you like what you read here leave your address for our letter"
    menu = "".join(f"<li>{w}</li>" for w in "home news sport weather money travel food health jobs cars games help".split())
    quote = "the quick fox jumps over the lazy dog"
    rows, want = [], []
    for k in range(4):
        a, b = own(), own()
        rows.append((k, f"http://open/{k}", f"<ul>{menu}</ul><p>{a}</p><h2>Conclusion</h2><p>{b} {quote}</p><table><td>Yes</td></table><p>{a}"))
        want.append(f"{a} Conclusion {b} {quote} Yes {a}")
        rows.append((k, f"http://main/{k}", f"<article><h1>Introduction</h1><p>{a}</p><div>{letter}</div><p>{b}</p><h2>Conclusion</h2></article>"))
        want.append(f"Introduction {a} {b} Conclusion")
    whole = [own() for _ in range(6)]
    for k in range(4):  # an article shown under further addresses, and versions of it
        text = [own() if i == k else t for i, t in enumerate(whole)]
        page = "".join(f"<p>{t}</p>" for t in text)
        rows += [(k, f"http://copies/{k}", f"<main>{''.join(f'<p>{t}</p>' for t in whole)}</main>"), (k, f"http://versions/{k}", f"<main>{page}</main>")]
        want += [" ".join(whole), " ".join(text)]
    got = {(r.page_id, r.url): r.text for r in page_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {r[:2]: w for r, w in zip(rows, want)}


def test_repeats_that_other_pages_hold_inside_longer_blocks(spark):
    letter = "if you like what you read here leave your address for our letter"
    own = lambda k: " ".join(f"{c}{k}" for c in "abcdefghijklmnop")
    rows = [
        (1, "http://h/1", f"<article><p>{own(1)}</p><div>{letter}</div></article>"),
        (2, "http://h/2", f"<article><p>{own(2)} {letter} {own(20)}</p></article>"),
        (3, "http://h/3", f"<article><p>{own(3)} {letter[:30]}</p><p>{letter[30:]} {own(30)}</p></article>"),
        (4, "http://open/4", f"<p>{own(4)}</p><p>{letter}</p>"),
        (5, "http://open/5", f"<article><p>{own(5)} {letter} {own(50)}</p></article>"),
        (6, "http://h/1", f"<article><p>{own(1)}</p><div>{letter}</div></article>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_extraction.main_text(frame).collect()}
    # The letter stands in three main texts of h, and on two pages of open, one of which has no main element.
    assert got == {
        1: own(1), 2: f"{own(2)} {letter} {own(20)}", 3: f"{own(3)} {letter} {own(30)}",
        4: own(4), 5: f"{own(5)} {letter} {own(50)}", 6: own(1),
    }


def test_pages_of_a_repeat_are_counted_exactly(spark):
    # Two of these three once fell on the same marks in maps of 64 places.
    letter = "if you like what you read here leave your address for our letter"
    own = {k: " ".join(f"{c}{k}" for c in "abcdefghijklmnop") for k in (141, 2228, 7)}
    rows = [(k, f"http://h/{k}", f"<article><p>{t}</p><div>{letter}</div></article>") for k, t in own.items()]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in page_extraction.main_text(frame).collect()} == own
    two = page_extraction.main_text(frame.filter("page_id != 7"))
    assert {r.page_id: r.text for r in two.collect()} == {k: f"{own[k]} {letter}" for k in (141, 2228)}


def test_articles_of_the_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split("<[^>]*>", re.sub("</?b>", "", inner))
        want[r.page_id] = " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())
    assert {r.page_id: r.text for r in page_extraction.main_text(pages).collect()} == want
