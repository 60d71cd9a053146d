"""Source divergence against plain integers, and main texts of pages against pages put together from known parts."""

import random
import re
from collections import Counter

import numpy as np

from ridgeline.llm import divergence
from ridgeline.llm.divergence import SCALE, SMOOTH, audit_sources, distances, shares, term_lists
from ridgeline.llm.html_text import EXAMPLES, main_text, text_blocks

DOCS = "doc_id long, text string, lang string, source string, term string, n int"


def plain_audit(rows, min_docs, top):
    """The contract in Python's own integers."""
    docs = [("" if lang is None else lang, "" if source is None else source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in within.items() if n >= min_docs}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + SCALE * (c[t] + SMOOTH) // (n + SMOOTH * len(kept)) for t in kept}

        p, every = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            own = sorted((every[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > every[t])[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(own, 1)]
    return sorted(out)


def documents(seed, n):
    pick = random.Random(seed)
    words = ["Ab", "ab", "cd", "éa", "É", "x'y", "日本", "z" * 300, "Q1r", "k"]
    return [(None if pick.random() < 0.05 else " ".join(pick.choice(words) for _ in range(pick.randint(0, 12))), pick.choice(["en", "de", None]), pick.choice(["a", "b", "c", "", None, "é"])) for _ in range(n)]


def audited(spark, rows, **more):
    table = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r) for r in audit_sources(table, **more).collect())


def test_against_plain_integers(spark, monkeypatch):
    rows = documents(3, 200)
    assert audited(spark, rows, min_docs=5) == plain_audit(rows, 5, 50)
    assert audited(spark, rows, min_docs=5, top=2) == plain_audit(rows, 5, 2)


def test_blocks_of_sources_and_terms(spark, monkeypatch):
    """Tiny blocks: sources of one language lie in several, and so do terms."""
    rows = [(t, "en", s and f"{s}{i % 4}") for i, (t, _, s) in enumerate(documents(4, 150))]
    wanted = audited(spark, rows, min_docs=4)
    monkeypatch.setattr(divergence, "TERMS", 2)
    assert audited(spark, rows, min_docs=4) == wanted == plain_audit(rows, 4, 50)


def test_nothing_kept_one_source_and_no_rows(spark):
    assert audited(spark, [("a b", "en", "x"), ("b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert audited(spark, [("a b", "en", "x")] * 40) == []
    assert audited(spark, []) == []


def test_shares_do_not_overflow():
    count, total = np.array([4_000_000_000_000], np.int64), np.array([8_999_000_000_000_000], np.int64)
    assert shares(count, total, 10).tolist() == [1 + SCALE * (4_000_000_000_000 + SMOOTH) // (8_999_000_000_000_000 + 10 * SMOOTH)]


def test_distances_and_pieces():
    pick = np.random.default_rng(1)
    a, b = pick.integers(0, 99, (5, 200)), pick.integers(0, 99, (3, 200))
    assert distances(a, b).tolist() == [[int(abs(x - y).sum()) for y in b] for x in a]
    text = b"ab cd " * 500_000 + b"x" * 3_000_000 + b" end"
    assert Counter(t for x in term_lists(text) for t in x) == Counter(text.split())


# -- pages ----------------------------------------------------------------------------------------------------------

LINKS = '<nav class="top"><ul><li><a href="/a">Home</a></li><li><a href="/b?x=1&amp;y=2">News</a></li></ul></nav>'
SAYS = "the people of the valley brought boats and food and they worked together for days"


def page(parts, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t='<p>no</p>';</script></head><body>{before}{parts}{after}</body></html>"


def texts(spark, pages):
    table = spark.createDataFrame([(i, f"http://h/{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, blocks string")
    return [r["text"] for r in main_text(table).orderBy("page_id").collect()]


def test_articles_with_all_furniture(spark):
    article = f"<article><header><h1>A &amp; B</h1></header><p>{SAYS}.<p>To.<ul><li>one</li><li>two  of\n them</li></ul><blockquote>{SAYS}</blockquote></article>"
    around = [
        (LINKS, "<footer>&copy; 2020 somebody</footer>"), ('<div class="ad">Buy now, it is good and cheap for you and me.</div>', f'<aside><p>{SAYS}</p></aside>'),
        (f'<div class="cookie-notice"><p>{SAYS}</p></div>', f"<form><label>Name</label><p>{SAYS}</p></form>"), (LINKS, f'<section id="comments"><article class="comment"><p>{SAYS}!</p></article></section>'),
        (f"<header><h1>The Paper</h1><p>{SAYS}</p></header>", f'<div class="sidebar widget"><h3>More</h3><p>{SAYS}</p></div>'),
    ]
    wanted = f"A & B\n{SAYS}.\nTo.\none\ntwo of them\n{SAYS}"
    assert texts(spark, [page(article, *x) for x in around]) == [wanted] * len(around)


def test_pages_without_sections(spark):
    body = f"<div><a href=/>Start</a> <a href=/n>News of today</a></div><div><h2>Title of it all</h2><p>{SAYS}.</p><p>{SAYS} and nights.</p></div><div><a href=/q>Next page</a> <a href=/r>Last</a></div>"
    assert texts(spark, [page(body)]) == [f"Title of it all\n{SAYS}.\n{SAYS} and nights."]


def test_defined_results(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    pages = [None, "", "   ", "<p", LINKS, page(f"<article><p>{long}</p></article>"), f"<article><p>{SAYS} &#233;&nbsp;&lt;b&gt; &am", f"<article><p>{SAYS}</p><!-- cut <p>x</p>", f"<article><p>{SAYS}</p><script>if (a<b) '</p>'"]
    assert texts(spark, pages) == ["", "", "", "", "", long, f"{SAYS} é <b> &am", SAYS, SAYS]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hostile_pages_end():
    for made in ("<" * 200_000, "<a " * 60_000, "<div>" * 100_000, "</p>" * 100_000, "<p title='" * 50_000, "<!--" * 100_000, "<script>" * 50_000, "&" * 200_000, "<p a=b" * 50_000, "<li><p>" * 50_000):
        text_blocks(made)


def test_examples_are_learnt(spark):
    """The tree is right on the table that it was trained on."""
    assert [[x.removeprefix("*") for x in t.split("\n") if x] for t in texts(spark, [e.replace("*", "") for e in EXAMPLES])] == [[t[1:] for t, *_ in text_blocks(e) if t.startswith("*")] for e in EXAMPLES]
