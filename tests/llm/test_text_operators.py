"""Quality rules, language ID, toxicity, fingerprints, page extraction."""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import fingerprint, htmltext, langid, layouts, quality, queries, toxicity
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(documents, texts):
    for r in quality.quality(documents).collect():
        want = counted(texts[r["doc_id"]])
        assert tuple(r[k] for k in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_odd(odd, none, odd_rows):
    got = Counter((r["doc_id"], *(r[k] for k in quality.COUNTS)) for r in quality.quality(odd).collect())
    assert got == Counter((r[0], *counted(r[1])) for r in odd_rows)
    assert quality.quality(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns
    assert {r["doc_id"] for r in quality.keep_good(odd).collect()} == {0, 1, 2, 5, 10, None}


def test_language_held_out(spark, documents):
    got = queries.op4_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.95


def test_language_odd(odd, none, documents):
    net = langid.learn(langid.teaching(documents))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, net).collect()]
    assert len(got) == odd.count()
    assert {i for i, v, s in got if v == "und"} == {3, 4, 8, 12, None}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert langid.identify(none, net).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}
    assert langid.keep_known(odd, net).columns == odd.columns


def test_convolution_by_hand():
    net = langid.train(["abc def ghi"] * 20 + ["xyz uvw rst"] * 20, ["a"] * 20 + ["b"] * 20)
    x, _, _ = langid.cut(np.frombuffer(b"abc xyz", np.uint8), np.array([0, 7]))
    pooled = np.concatenate([np.max([sum(net.filters[w][k][langid.FOLD[x[0][i + k]]] for k in range(w)) for i in range(langid.WINDOW - 3)], axis=0) for w in langid.WIDTHS])
    assert np.allclose(net.probabilities(x)[0], net.head(pooled[None])[0], atol=1e-4)
    assert net.probabilities(langid.cut(np.frombuffer(b"abc def", np.uint8), np.array([0, 7]))[0])[0].argmax() == 0


def test_toxicity_held_out(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit >= 0.6 * sum(r["toxic"] for r in got)
    assert hit >= 0.7 * sum(r["predicted"] for r in got)


@pytest.mark.parametrize("direct", [0.0, toxicity.DIRECT])
def test_toxicity_nearest_is_exact(monkeypatch, direct):
    monkeypatch.setattr(toxicity, "DIRECT", direct)
    rng = np.random.default_rng(3)
    e = toxicity.Examples(terms={str(i): i for i in range(30)}, weight=rng.random(30) + 0.1)
    keys = sorted({tuple(sorted(set(rng.integers(0, 30, rng.integers(0, 6)).tolist()))) for _ in range(400)})
    vector = lambda k: e.vector(np.array(k, np.int32), np.arange(1, len(k) + 1))
    e.build([vector(k) for k in keys], np.ones((len(keys), 2)), [[k] for k in keys])
    for _ in range(100):
        at, q = vector(sorted(set(rng.integers(0, 30, 4).tolist())))
        weight = dict(zip(at.tolist(), q.tolist()))
        by_hand = [sum(weight.get(t, 0) * w for t, w in zip(*vector(k[0]))) for k in e.ids]
        for without in (-1, int(np.argmax(by_hand))):
            cosines = sorted((round(c, 9) for i, c in enumerate(by_hand) if i != without), reverse=True)[: toxicity.NEAREST]
            found, cosine = e.nearest(at, q, without=without)
            assert np.allclose(cosine, [c for c in cosines if c > 0]) and np.allclose(cosine, np.array(by_hand)[found])


def test_toxicity_curve_is_monotone():
    rng = np.random.default_rng(4)
    share = rng.random(3000)
    label = (rng.random(3000) < share**2).astype(float)
    e = toxicity.Examples()
    e.calibrate(share, label, np.ones(3000))
    x, y = e.curve
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()
    for low in np.arange(0, 1, 0.1):  # what is called p comes true in about p of the cases
        inside = (share >= low) & (share < low + 0.1)
        assert abs(np.interp(share[inside], x, y).mean() - label[inside].mean()) < 0.05


def test_toxicity_scores_are_calibrated(spark):
    """Held out, in bins: the share of toxic documents is about the score."""
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    for low, high in ((0.0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        rows = [r for r in got if low <= r["score"] < high]
        if len(rows) >= 30:
            assert abs(np.mean([r["score"] for r in rows]) - np.mean([r["toxic"] for r in rows])) < 0.1
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit >= 0.9 * sum(r["toxic"] for r in got) and hit >= 0.9 * sum(r["predicted"] for r in got)


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_fingerprints(documents, texts):
    ids = sorted(texts, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    for r in fingerprint.edited_and_next(documents).collect():
        text = texts[r["doc_id"]]
        third = len(text) // 3
        edited = text[: len(text) - third] + texts[follows[r["doc_id"]]][:third]
        assert r["edited_text"] == edited and r["n_chars"] == len(text)
        assert r["fingerprint"] == fingerprint.fingerprint_of(text)
        assert r["edited_fingerprint"] == fingerprint.fingerprint_of(edited)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def test_fingerprint_likeness():
    a, b = ("some words that are said again and again " * 30), ("quite other text without much in common 123 " * 30)
    parts = []
    for x in (a, a[:-200] + b[:200], b):
        s: set = set()
        fingerprint.parse(x.encode(), s)
        parts.append((s, fingerprint.signature(s)))
    for s, x in parts:
        for t, y in parts:
            assert abs(fingerprint.likeness(x, y) - len(s & t) / len(s | t)) < 0.15


def test_fingerprint_likeness_by_hand(documents, texts):
    """Both likenesses are those of the fingerprints' smallest hashes, taken as sets."""
    import base64

    def kept(s):
        return set(np.frombuffer(base64.b64decode(s), "<u4").tolist())

    def by_hand(a, b):
        both = sorted(a | b)[: fingerprint.KEPT]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    ids = sorted(texts, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    rows = {r["doc_id"]: r for r in fingerprint.edited_and_next(documents).collect()}
    for i, r in rows.items():
        own = kept(r["fingerprint"])
        assert r["near_edited"] == pytest.approx(by_hand(own, kept(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(by_hand(own, kept(rows[follows[i]]["fingerprint"])))


def test_fingerprints_of_one_row_and_null_ids(spark):
    text = "a text that is the only one " * 9
    (only,) = fingerprint.edited_and_next(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    third = len(text) // 3
    assert only["edited_text"] == text[: len(text) - third] + text[:third] and only["near_next"] == 1.0
    rows = [(None, f"{k} " * 40) for k in range(60)] + [(k, f"{k} word " * 30) for k in range(20)]
    got = fingerprint.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and Counter(r["doc_id"] for r in got)[None] == 60


def test_fingerprints_odd(odd, none):
    got = fingerprint.edited_and_next(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    same = [r["fingerprint"] for r in got if r["doc_id"] in (0, 1)]
    assert len(set(same)) == 1
    assert fingerprint.edited_and_next(none).count() == 0
    assert fingerprint.fingerprints(odd).count() == odd.count()


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="page"><header><h1>Site</h1><nav><a href=/>home</a></nav></header>
<div id="cookie-notice">We use cookies on this site for many reasons that you may read about here.</div><main><article><h1>Tit&amp;le</h1>
<p>First   paragraph with several words in it for the test. <b>bold<p>Second&nbsp;one <a href="x">link words</a> more<script>var a="</p>";</script><ul><li>one item<li>two</ul>
<aside>Related stuff here to drop</aside><div class="ad-slot">Buy now this thing today</div><form><label>Mail</label></form>
<section class="comments"><p>I think that this article is great and long enough to be content, right?</p></section></article></main><footer>&copy; us</footer>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Tit&le First paragraph with several words in it for the test. bold Second one link words more one item two"
    assert htmltext.main_text("<div><p>A plain page without an article, with a paragraph.</p><p>short</p></div><div class=menu><a href=x>a</a></div>") == "A plain page without an article, with a paragraph. short"
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "just < text", "<nav>a</nav>")] == ["", "", "", "just < text", ""]


def test_minimum_cut_is_least():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        terminal = rng.normal(0, 2, n).round(2).tolist()
        edges = {(i, j): float(rng.integers(0, 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(-t if not s and t > 0 else 0 for s, t in zip(side, terminal)) * -1 + sum(-t for s, t in zip(side, terminal) if s and t < 0) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.minimum_cut(terminal, edges)) == pytest.approx(best)


def cut_cost(side, terminal, edges):
    return sum(abs(t) for s, t in zip(side, terminal) if s != (t > 0)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])


def test_whole_pages_are_cut_least():
    """Against all ways to divide the blocks of small pages."""
    tried = 0
    for seed in range(200):
        blocks, texts = htmltext.plain(htmltext.blocks_of(layouts.page(seed, "bare")[0]))
        blocks, texts = blocks[4:15], texts[4:15]
        terminal = (htmltext.features(blocks, texts) @ np.array(htmltext.WEIGHTS)).tolist()
        edges = htmltext.edges_of(blocks, htmltext.NEIGHBOURS, htmltext.SIBLINGS)
        if texts and min(map(abs, terminal)) < htmltext.NEIGHBOURS:
            tried += 1
            best = min(cut_cost([bool(m >> i & 1) for i in range(len(blocks))], terminal, edges) for m in range(1 << len(blocks)))
            assert cut_cost(htmltext.content(blocks, texts), terminal, edges) == pytest.approx(best)
    assert tried > 10


def test_costs_are_the_fitted_ones():
    fitted = htmltext.fit(map(layouts.page, htmltext.FITTED_ON))
    assert np.allclose(fitted, htmltext.WEIGHTS, atol=0.02)


def wrong(style, **edges):
    out = 0
    for seed in range(10_000, 10_200):  # pages that nothing was fitted on
        html, main = layouts.page(seed, style)
        if "<body>" not in html:
            continue  # a page that is one text has no style
        blocks, texts, label = htmltext.labelled(html, main)
        out += int((np.array(htmltext.content(blocks, texts, **edges)) != label).sum())
    return out


def test_edges_decide():
    """Where elements and names tell all, no block goes wrong; where they tell nothing, the cut mends many of the classifier's errors."""
    assert wrong("elements") == wrong("classes") == 0
    alone = wrong("bare", neighbours=0.0, siblings=0.0)
    assert 0 < wrong("bare") < 0.7 * alone


@pytest.mark.parametrize("piece", ["<script ", '<div class="', "<a '", "<p>a", "<div><li>x", "</section><div>", "<!--", '<a ">" ', "<b>x<i>", "<td>x", "<svg>x", "<", "&", "<p class="])
def test_broken_pages_end(piece):
    times = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        htmltext.main_text(piece * (n // len(piece)))
        times.append(time.perf_counter() - began)
    assert times[1] < max(0.5, 12 * times[0])


PROSE = "One two three four five six seven eight nine ten words here. And more of it, as prose goes on."
WRAPPERS = [
    '<div class="layout has-sidebar"><article>', '<div class="page no-comments"><main>', '<div id="top"><div class="content">', '<div class="share-enabled"><article class="post">', '<div class="site with-footer"><article>',
    '<article class="tag-social category-news">', '<article id="post-1" class="type-post sidebar-right">', "<form id=aspnetForm><div>", '<article title="the hidden truth">', '<article data-id="x role=menu">',
]


def wrapped(begin):
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", begin)))
    return f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>{begin}<p>{PROSE}</p><p>{PROSE}</p>{ends}<footer><p>&copy; us all</p></footer></body></html>'


@pytest.mark.parametrize("begin", WRAPPERS)
def test_names_round_an_article(begin):
    assert htmltext.main_text(wrapped(begin)) == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("shape", ['<div class="x-{}"><article>', '<div class="{}-x"><main>', '<div id="{}"><article>', '<div class="page-{}"><div>', '<div class="{} page"><div class="entry-content">'])
def test_no_listed_word_loses_an_article(shape):
    assert [w for w in sorted(htmltext.AGAINST_WORDS) if htmltext.main_text(wrapped(shape.format(w))) != f"{PROSE} {PROSE}"] == []


def test_names_beside_an_article_still_tell():
    """Comments, also as articles of their own, sidebars with articles and long notices stay out."""
    comment = f'<article class="comment-body"><p>{PROSE}</p></article>'
    page = wrapped('<div class="has-sidebar"><article>').replace("<footer>", f'<div class="comments">{comment * 3}</div><aside><article><p>{PROSE}</p></article></aside><div class="cookie-notice"><p>{PROSE}</p></div><footer>')
    assert htmltext.main_text(page) == f"{PROSE} {PROSE}"


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = queries.op9_html_extraction(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        plain = " ".join(htmltext.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", article))).split())
        assert r["text"] == plain and r["n_chars"] == len(plain)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in htmltext.extract(odd).collect()] == ["", "", ""]
    assert htmltext.extract(odd.limit(0)).count() == 0
