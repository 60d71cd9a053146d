"""N-gram join, line dedup, language, quality, search against brute force, with nulls, ties and hot groups."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import language
from ridgeline.llm import ngram_join as nj
from ridgeline.llm.language import identify, page_evidence
from ridgeline.llm.queries import op6_language_pages
from ridgeline.llm.line_dedup import LINE, dedup_lines
from ridgeline.llm.mih import sign_code, top_k
from ridgeline.llm.quality import held_out_fold, neighbours, score_quality

SCHEMA = "doc_id long, text string, node string, TEXT string, id long, n long"


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute_components(texts, n, p, q):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(60))
    texts = [None, "", "  ", "One", "one", "A b", "a B c d", "w " * 30, "W " * 31]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([6, 7, 9, 14, 40, 150]))]
        for _ in range(rng.choice([2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy))
    hot = [word() for _ in range(200)]
    for k in range(60):  # a chain: each differs a little from the one before
        hot[(3 * k) % 200] = word()
        texts.append(" ".join(hot))
    shared = " ".join(word() for _ in range(80))
    texts += [shared + " " + " ".join(word() for _ in range(150)) for _ in range(20)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("n", "p"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, p):
    texts = near_copies(n)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_components(table(spark, texts), n, p, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, p, 100)


def test_links_equal_brute_force(spark):
    texts = near_copies(4) + near_copies(4)[30:60]  # and exact copies
    sets = [shingles(t, 4) for t in texts]
    want = [sum(bool(x and y) and 100 * len(x & y) >= 85 * len(x | y) for y in sets) - bool(x) for x in sets]
    got = {r["doc_id"]: r for r in nj.similar_components(table(spark, texts), 4, 85, 100, links=True).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == want
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == brute_components(texts, 4, 85, 100)


@pytest.mark.parametrize("links", [False, True])
def test_cut_trees_lose_no_link(spark, monkeypatch, links):
    monkeypatch.setattr(nj, "CELL_SETS", 3)
    texts = near_copies(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_components(table(spark, texts), 4, 85, 100, links=links).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4, 85, 100)


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits[:n])


def test_words_that_plain_polynomial_hashes_take_for_one_another(spark):
    texts = [thue_morse(n, *ab) for n in (8, 64, 1024, 2048, 4096, 8192) for ab in ("ab", "ba")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_components(table(spark, texts), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(texts))] == [(1, i) for i in range(len(texts))]


def test_component_corner_cases(spark):
    same = " ".join(f"w{i}" for i in range(50))
    df = table(spark, [same, same, same, "other words here now", None], [None, 7, 7, 3, None])
    got = sorted(map(tuple, nj.similar_components(df, 4, 85, 100).collect()), key=repr)
    assert got == sorted([(None, 47, 7), (7, 47, 7), (7, 47, 7), (3, 1, 3), (None, 0, None)], key=repr)
    assert nj.similar_components(table(spark, []), 4, 85, 100).count() == 0


def test_near_copies_with_a_null_id_link(spark):
    near = [" ".join(f"w{i}" for i in range(k, k + 200)) for k in (0, 8, 16)]  # each is alike with the next, the ends are not
    sets = [shingles(t, 4) for t in near]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.9
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    got = sorted(map(tuple, nj.similar_components(table(spark, near, [5, None, 3]), 4, 90, 100).collect()), key=repr)
    assert got == [(3, 197, 3), (5, 197, 3), (None, 197, 3)]


@pytest.mark.parametrize("p", [80, 85])
def test_alike_sets_always_share_a_signature(p):
    rng = random.Random(p)
    alike = 0
    for _ in range(1500):
        x = {rng.getrandbits(64) for _ in range(rng.choice([rng.randrange(1, 12), rng.randrange(3, 60), rng.randrange(20, 700)]))}
        y = set(x)
        for _ in range(rng.randrange(0, max(2, len(x) // 5))):
            if rng.random() < 0.5 and len(y) > 1:
                y.pop()
            if rng.random() < 0.6:
                y.add(rng.getrandbits(64))
        if x == y or 100 * len(x & y) < p * len(x | y):
            continue
        alike += 1
        both = [np.array(sorted(s), np.uint64) for s in (x, y)]
        sig, owner = nj.signatures(np.concatenate(both), np.array([len(x), len(y)]), p, 100)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
    assert alike > 300


def test_the_tree_loses_no_partner():
    rng = np.random.default_rng(5)
    base = rng.poisson(3, (40, nj.WIDTH))
    at = np.repeat(base, 6, axis=0) + (rng.random((240, nj.WIDTH)) < 0.05)
    sizes = at.sum(axis=1)
    tree = nj.RTree(at, sizes)
    for i in range(240):
        bound = np.minimum(at, at[i]).sum(axis=1) >= nj.needed(int(sizes[i]), sizes, 85, 100)
        assert set(tree.search(at[i], int(sizes[i]), 85, 100).tolist()) == set(np.flatnonzero(bound).tolist())


def brute_dedup(texts, min_words):
    """Texts without runs of lines with min_words words that occur before; None stays None."""
    seen, out = {}, []
    lines = [[m for m in re.findall(LINE.replace("(?s)", "").replace(r"\z", r"\Z"), t or "", flags=re.S)] for t in texts]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    full = [[(i, strip(x), words(x)) for i, x in enumerate(ls) if words(x)] for ls in lines]
    windows = []
    for d, ls in enumerate(full):
        found = set()
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(w for *_, w in ls[a : b + 1]) >= min_words:
                    found.add((a, b))
                    break
            for b in range(a, -1, -1):
                if sum(w for *_, w in ls[b : a + 1]) >= min_words:
                    found.add((b, a))
                    break
        windows += [(d, a, b, tuple(x for _, x, _ in ls[a : b + 1])) for a, b in sorted(found)]
    gone = defaultdict(set)
    for d, a, b, content in sorted(windows, key=lambda w: w[:2]):
        if seen.setdefault(content, (d, a)) != (d, a):
            gone[d] |= set(range(a, b + 1))
    for d, (t, ls, all_lines) in enumerate(zip(texts, full, lines, strict=True)):
        drop, k = set(), 0
        marks = sorted(gone[d])
        while k < len(marks):
            j = k
            while j + 1 < len(marks) and marks[j + 1] == marks[j] + 1:
                j += 1
            drop |= set(range(ls[marks[k]][0], ls[marks[j]][0] + 1))
            k = j + 1
        out.append(t if not drop else "".join(x for i, x in enumerate(all_lines) if i not in drop))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(rng.choice("abcde") + str(rng.randrange(40)) for _ in range(n)) + "."
    pool = [sentence(rng.randrange(1, 9)) for _ in range(25)]
    passage = "\n".join(sentence(6) for _ in range(4))
    texts = [None, "", "\n\n", "short.", "short.", sentence(60), passage, passage, "intro.\n" + passage + "\n\nend.", (sentence(12) + " ") * 5]
    for _ in range(30):
        parts = [rng.choice(pool) for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts)), passage)
        texts.append("".join(x + rng.choice([" ", "\n", "\n\n", "  \n"]) for x in parts))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(table(spark, texts), min_words=12).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts, 12)


def test_line_dedup_corner_cases(spark):
    long = " ".join(f"w{i}" for i in range(40)) + "."
    df = table(spark, [long, long, long, "x. " + long], [None, 5, 5, 1])
    got = sorted([(r["doc_id"], r["text"]) for r in dedup_lines(df).collect()], key=repr)
    # null ids come first; rows with equal id and text are one document
    assert got == sorted([(None, long), (1, "x. "), (5, ""), (5, "")], key=repr)
    assert dedup_lines(table(spark, [])).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    codes = [rng.getrandbits(16) for _ in range(150)] + [77] * 40 + [None] * 3
    data = [(i, c if c is None else c - (1 << 15), "z") for i, c in enumerate(codes)]
    df = spark.createDataFrame([(i, (c or 0) & 0xFFFF if c is not None else None, z) for i, c, z in data], "id long, code long, distance string")
    known = [(i, c & 0xFFFF) for i, c, _ in data if c is not None]
    got = defaultdict(list)
    for r in top_k(df, df.where("id % 10 = 0"), k=7, bits=16, segments=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    for q, c in known:
        if q % 10 == 0:
            assert got[q] == sorted(((bin(c ^ x).count("1"), i) for i, x in known))[:7]
    few = spark.createDataFrame([(1, 5), (2, 9)], "id long, code long")
    assert top_k(few, few, k=10, bits=16).count() == 4
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    assert top_k(few.limit(0), few).count() == 0


def test_sign_codes_of_odd_vectors(spark):
    """Null, short and long vectors have no code; nulls, zeros and undefined numbers are no positive signs."""
    nan = float("nan")
    rows = [(0, None), (1, [1.0]), (2, [1.0] * 5), (3, [1.0, -1.0, 0.0, 2.0]), (4, [nan, 1.0, None, -0.0]), (5, [float("inf"), float("-inf"), 1e-300, -1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    assert {r["id"]: r["c"] for r in df.select("id", sign_code("v", 4).alias("c")).collect()} == {0: None, 1: None, 2: None, 3: 0b1001, 4: 0b0010, 5: 0b0101}


def test_very_long_and_repeated_texts_in_line_dedup(spark):
    """A text of a megabyte without a line end, and one passage in very many copies of one row."""
    long = " ".join(f"w{i}" for i in range(150_000))
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [(1, long), (2, long), *[(3, passage)] * 400, (4, f"Own words first. {passage} Own words last.")]
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == (1, long) and got[1] == (2, "") and len(got) == 403
    assert sum(t == passage for i, t in got if i == 3) <= 400 and "p7" not in got[-1][1] and got[-1][1].startswith("Own words first.")


def test_language_evidence(spark):
    rng = random.Random(6)
    vocabulary = {"aa": ["lorem", "dolor", "amet", "elit"], "bb": ["zwischen", "durch", "schon", "strasse"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(20)), x.upper() + "-XX", f"{x}{i % 3}.site.{x}") for i in range(120) for x in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "aa1.site.aa"), (901, "", None, None), (902, "12 34 !!", "bb", "bb1.site.bb"), (903, "zwischen durch schon", "aa", None), (904, "q", None, "bb1.site.bb"), (None, "lorem dolor amet", None, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string, id string")
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["language"] == ("aa", "bb")[i % 2] and not got[i]["rejected"] for i in range(120))
    assert all(got[i]["rejected"] and got[i]["language"] is None for i in (900, 901, 902))
    assert got[903]["language"] == "bb"  # the text outweighs what is declared
    assert got[904]["language"] == "bb"  # the host decides for a text that says little
    assert got[None]["language"] == "aa"
    assert identify(df.limit(0)).count() == 0
    assert identify(df.where("lang is null")).where("not rejected").count() == 0


def test_language_rejects_what_fits_none(spark):
    rng = random.Random(14)
    vocabulary = {"en": "the quick brown fox jumps over a lazy dog while many people watch it from their houses near the river".split(), "es": "la ciudad fue fundada por los romanos y su historia es muy larga con calles plazas iglesias mercados".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(25)), x, f"www.site{i % 5}.example.com") for i in range(200) for x in [("en", "es")[i % 2]]]
    foreign = [
        "A magyar nyelv az uráli nyelvek családjába tartozó finnugor nyelvek egyike, rokonai a manysi és a hanti nyelv.",
        "Русский язык является одним из восточнославянских языков и национальным языком русского народа",
        "日本語は日本国内や日本人同士の間で使用されている言語である", " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(20)),
    ]
    rows += [(1000 + i, t, None, "www.site1.example.com") for i, t in enumerate(foreign)]
    rows += [(2000, "the people watch the river", None, None), (2001, "la historia es larga", None, "www.site1.example.com")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[1000 + i]["rejected"] and got[1000 + i]["confidence"] < 0.5 for i in range(len(foreign)))
    assert all(got[i]["language"] == ("en", "es")[i % 2] and not got[i]["rejected"] for i in range(200))
    assert [(got[i]["language"], got[i]["rejected"]) for i in (2000, 2001)] == [("en", False), ("es", False)]


@pytest.mark.parametrize("max_rows", [20_000, 60])
def test_language_learns_rare_languages(spark, max_rows):
    rng = random.Random(15)
    vocabulary = {"aa": ["lorem", "dolor", "amet", "elit"], "bb": ["zwischen", "durch", "schon", "strasse"], "cc": ["hogyan", "nyelv", "mindig", "ember"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(12)), x, "s") for i in range(2400) for x in [("aa", "bb")[i % 2]]]
    rows += [(5000 + i, " ".join(rng.choice(vocabulary["cc"]) for _ in range(12)), "cc", "s") for i in range(3)]
    rows += [(6000, "ember nyelv mindig hogyan", None, "s"), (6001, "12 34", "dd", "s")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), max_rows=max_rows).collect()}
    assert all(got[i]["language"] == "cc" and not got[i]["rejected"] for i in (5000, 5001, 5002, 6000))
    assert all(got[i]["language"] == ("aa", "bb")[i % 2] and not got[i]["rejected"] for i in range(2400))
    assert got[6001]["rejected"]


def test_rare_tags_share_a_profile(spark, monkeypatch):
    """With two profiles of their own, the others are one hypothesis that is never answered; common languages stay right."""
    monkeypatch.setattr(language, "TAGS", 2)
    said = {"en": "the people of the town were walking there", "de": "die leute der stadt gingen dort spazieren", **{f"q{chr(97 + i)}": f"zq{i}x vw{i}k jj{i}y" for i in range(20)}}
    rows = [(k * 100 + i, f"{text} {i}", tag, "h") for k, (tag, text) in enumerate(said.items()) for i in range(40 if k < 2 else 3)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and {r["language"] for r in got.values()} <= {"en", "de"}
    assert all(got[i]["language"] == "en" and not got[i]["rejected"] for i in range(40)) and all(got[100 + i]["language"] == "de" and not got[100 + i]["rejected"] for i in range(40))
    assert sum(got[k * 100 + i]["rejected"] for k in range(2, 22) for i in range(3)) >= 55


def test_language_of_pages(spark, tmp_path):
    rng = random.Random(16)
    vocabulary = {"aa": ["lorem", "dolor", "amet", "&eacute;lit"], "bb": ["zwischen", "durch", "schon", "stra&szlig;e"]}
    page = lambda lang, text: f'<!DOCTYPE html><html class=x lang="{lang}"><head><script>var a = "<p>durch</p>";</script></head><!-- <p> --><body><p>{text}</p></body></html>'
    rows = [(i, f"http://u@www.s{i % 7}.example.{x}:80/en/{i}?q=1", page(x.upper() + "-XX", " ".join(rng.choice(vocabulary[x]) for _ in range(20)))) for i in range(120) for x in [("aa", "bb")[i % 2]]]
    rows += [(500, "https://new.other.bb/#top", "<p>q"), (501, "https://new.other.aa", "<p>q"), (502, None, None), (503, "no address", "<p>12</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = {r["page_id"]: r for r in page_evidence(df).collect()}
    assert (seen[1]["lang"], seen[1]["host"], seen[500]["host"], seen[503]["host"], seen[502]["text"]) == ("BB-XX", "www.s1.example.bb", "new.other.bb", None, None)
    assert not re.search("[<>&]|var", seen[1]["text"])
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in op6_language_pages(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i]["language"] == ("aa", "bb")[i % 2] and not got[i]["rejected"] for i in range(120))
    assert (got[500]["language"], got[501]["language"]) == ("bb", "aa")  # the suffix decides
    assert got[502]["rejected"] and got[503]["rejected"]


def test_quality_learns_from_the_training_fold_only(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30)) for _ in range(50)) + "."
    bad = lambda: "!! BUY *** NOW $$$ " * rng.randrange(5, 20)
    docs = [(i, bad() if i % 4 == 0 else good(), "w") for i in range(400)] + [(None, None, "w"), (1001, "", "w"), (1002, "x" * 200_000, "w"), (5, good(), "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, 0), (9, 5, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]) > 0.97
    flipped = labels.join(df.select("doc_id").distinct(), "doc_id", "left").withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(held_out_fold(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    again = {r["doc_id"]: r["score"] for r in score_quality(df, flipped).collect() if r["doc_id"] != 5}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got if r["doc_id"] != 5)
    assert {r["score"] for r in score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert score_quality(df.limit(0), labels).count() == 0


def test_quality_threshold_is_the_share_marked_bad_of_all_training_rows(spark):
    rng = random.Random(12)
    text = lambda p: " ".join("BUY!" if rng.random() < p else rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(500)) for _ in range(rng.randrange(40, 160))) + "."
    docs = [(i, text(0.35 if i % 10 == 0 else 0.2)) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(1200)], "doc_id long, quality int")
    got = [r for r in score_quality(df, labels, max_rows=40).collect() if not r["held_out"]]
    assert sum(r["predicted"] == 0 for r in got) == sum(r["doc_id"] % 10 == 0 for r in got)


def test_neighbours_of_a_cut_are_exact(spark):
    rng = random.Random(13)
    for values in ([rng.gauss(0, 1) for _ in range(3000)] + [1e9], [2.5] * 40, [1.0] * 30 + [2.0] * 30, [0.0, 5e-324], [1e-300 * rng.random() for _ in range(50)] + [7.0] * 9):
        df, ranked = spark.createDataFrame([(x,) for x in values], "v double"), sorted(values)
        for cut in {1, len(values) // 2, len(values) - 1}:
            assert neighbours(df, cut) == (ranked[cut - 1], ranked[cut])
