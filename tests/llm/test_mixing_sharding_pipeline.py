"""Mixing, sharding and the pipeline's stages against brute force, with nulls, ties, hot groups and clashing names."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm.common import before, connected_components
from ridgeline.llm.mixing import min_cost_flow, mix, source_targets
from ridgeline.llm.sharding import numbered, propagate, shard_documents


def words(n, seed=0):
    rng = random.Random(seed * 1000 + n)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(n))


def target_shares(sizes, weights, most):
    """Quotas by trying every set of capped sources in order of their room: the plain way."""
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for k in range(len(order) + 1):
        free, left = order[k:], sum(sizes) - sum(most * sizes[i] for i in order[:k])
        weight = sum(weights[i] for i in free)
        if all(left * weights[i] / weight <= most * sizes[i] for i in free):
            return [left * weights[i] / weight if i in free else most * sizes[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[600, 0, 1, 10], [100, 100, 100], [5, 0, 0, 3000, 7, 900, 1]])
def test_targets_stop_at_three_times_the_size(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df, (1, 2, 3), 3, sum(sizes)).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(target_shares(sizes, [1 + i % 3 for i in range(len(sizes))], 3))


def best_flow(supplies, members, quotas, repeats):
    """Least cost of the largest flow, by trying every split of small supplies."""
    best = {}

    def go(p, left, cost, flow):
        if p == len(supplies):
            best[flow] = min(best.get(flow, cost), cost)
            return
        options = [()]
        for q in members[p]:
            options = [(*o, x) for o in options for x in range(min(left[q], repeats * supplies[p] - sum(o)) + 1)]
        for o in options:
            used = sum(o)
            now = list(left)
            for q, x in zip(members[p], o, strict=True):
                now[q] -= x
            go(p + 1, now, cost + sum(max(0, used - k * supplies[p]) for k in range(1, repeats)), flow + used)

    go(0, list(quotas), 0, 0)
    return max(best), best[max(best)]


@pytest.mark.parametrize("seed", range(12))
def test_flow_equals_the_best_of_all(seed):
    rng = random.Random(seed)
    supplies, quotas = [rng.randrange(0, 4) for _ in range(3)], [rng.randrange(0, 6) for _ in range(2)]
    members = [rng.choice([[0], [1], [0, 1]]) for _ in supplies]
    given = min_cost_flow(supplies, members, quotas, 3)
    used = [sum(g) for g in given]
    assert all(sum(g[q] for g in given) <= quotas[q] for q in range(2))
    cost = sum(max(0, u - k * s) for u, s in zip(used, supplies, strict=True) for k in (1, 2))
    assert (sum(used), cost) == best_flow(supplies, members, quotas, 3)


def test_flow_repeats_only_where_it_must_and_evenly():
    given = min_cost_flow([100, 100, 50], [[0], [0, 1], [1]], [120, 180], 3)
    assert [sum(x) for x in zip(*given, strict=True)] == [120, 180]
    assert all(sum(g) >= s for g, s in zip(given, [100, 100, 50], strict=True))  # nothing is repeated before all is used
    assert given[0][1] == 0 and given[2][0] == 0
    assert min_cost_flow([10], [[0]], [100], 3) == [[30]]


def test_mix_follows_the_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, words(rng.randrange(1, 40), i), rng.choice(["a", "b", "b", "b", "b", None, "é"]), "x", 0) for i in range(400)]
    rows += [(None, None, "a", "x", 0), (7, "", None, "x", 0), (7, words(5), "zz", "x", 0), (7, words(5), "zz", "x", 0), (9999, words(5000), "b", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size int")
    got = mix(df).collect()
    assert sorted(got, key=repr) == sorted(mix(df.repartition(3)).collect(), key=repr)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, target_shares([sizes[n] for n in names], [1, 2, 3, 1, 2], 3), strict=True))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for n in names:
        assert abs(taken[n] - targets[n]) <= max(25, 0.02 * targets[n])
    assert mix(df.limit(0)).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, words(20, i), [["a"], ["a", "b"], ["b"], [], None][i % 5]) for i in range(200)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1,)).collect()
    assert len(got) == 200 and sum(r["taken"] for r in got) == pytest.approx(4000, rel=0.05)


def test_overlapping_sources_take_what_the_best_flow_gives(spark):
    """Documents of one word each, so that a pattern can take any number: totals and repetition cost are the best there are."""
    kinds = [(["a"], 4), (["a", "b"], 2), (["b"], 1), (["c"], 3), (["c", "d"], 1)]
    rows = [(k * 100 + i, f"w{i}", sources) for k, (sources, n) in enumerate(kinds) for i in range(n)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 5)).collect()
    taken, targets = defaultdict(int), {}
    for r in got:
        taken[r["doc_id"] // 100] += r["taken"]
        targets[r["source"]] = r["target"]
    table = spark.createDataFrame([("a", 6), ("b", 3), ("c", 4), ("d", 1)], "source string, size long")
    quota = {r["source"]: round(r["target"]) for r in source_targets(table, (1, 5), 3, 11).collect()}
    for names, patterns in ((["a", "b"], [0, 1, 2]), (["c", "d"], [3, 4])):
        supplies, members = [kinds[p][1] for p in patterns], [[names.index(s) for s in kinds[p][0]] for p in patterns]
        cost = sum(max(0, taken[p] - k * kinds[p][1]) for p in patterns for k in (1, 2))
        assert (sum(taken[p] for p in patterns), cost) == best_flow(supplies, members, [quota[n] for n in names], 3)


def test_filling_goes_on_as_long_as_a_document_fits(spark):
    """Sizes by powers of two, each a pass of its own: more passes than any fixed number."""
    rows = [(i, words(1 << (i % 11), i), "a") for i in range(66)] + [(1000 + i, words(30, i), "b") for i in range(400)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1)).collect()
    for name in "ab":
        mine = [r for r in got if r["source"] == name]
        gap = mine[0]["target"] - sum(r["taken"] for r in mine)
        low = min(r["copies"] for r in mine)
        assert gap < max(min(r["size"] for r in mine if r["copies"] == low), 0.002 * mine[0]["target"]) + 1


def test_before_is_a_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.getrandbits(63) - (1 << 62), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, i int, v int")
    got = {r["i"]: r["before"] for r in before(df, ["k"], F.col("o"), ["i"], F.col("v"), 300, per_bucket=7).collect()}
    assert got == {i: sum(v2 for k2, o2, _, v2 in rows if k2 == k and o2 < o) for k, o, i, _ in rows}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(300, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}, 200: 200, 300: 200}


def test_shards_are_even_and_keep_equal_texts_together(spark):
    hot, rng = words(12), random.Random(5)
    texts = [hot] * 400 + [words(9, i % 60) for i in range(240)] + [words(11, 1000 + i) for i in range(560)] + [None, "", None]
    rows = [(i % 1150 if i else None, t, "x", 3) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, row int")
    got = shard_documents(df).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    spread = sorted(len(g) for g in groups.values())
    assert spread[-1] <= 12 and sum(x > 1 for x in spread[:-1]) <= 6  # 400 rows need 9 shards of 50
    assert shard_documents(df.limit(0)).count() == 0
    assert {r["shard"] for r in shard_documents(df.limit(2)).collect()} <= {0, 1}


def test_propagation_lowers_the_cut(spark):
    rows, n = numbered(spark.range(600).withColumnRenamed("id", "k"), ["k"])
    links = rows.select("row", (F.col("k") % 150).alias("group")).union(rows.where("k < 300").select("row", (F.col("k") % 30 + 1000).alias("group")))
    placed = propagate(rows, links, n, shards=6)
    counts = [r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert counts == [100] * 6

    def cut(shards):
        return links.join(shards, "row").groupBy("group").agg(F.countDistinct("shard").alias("s")).agg(F.sum(F.col("s") - 1)).first()[0]

    assert cut(placed) < 0.6 * cut(rows.select("row", (F.col("row") % 6).cast("int").alias("shard")))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, TEXT string"


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice(["der", "und", "nicht", "wald", "haus", "baum"]) + rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)) + "."
    base = [line(60) + "\n" + line(20) + " " + line(50) for _ in range(20)]
    texts = base + [base[0], base[0] + " Neu.", base[1].replace("der", "dar", 1)] + [line(rng.randrange(2, 25)) for _ in range(30)] + [None, "", "12 %%", line(4000)]
    rows = [(i, t, ["de", "en", None][i % 3], ["s0", "s1", None][i % 3], len(t or ""), "k", "other") for i, t in enumerate(texts)]
    rows += [(None, base[3], "de", "s0", 1, "k", "other"), rows[30], rows[30]]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.createDataFrame(rows, COLUMNS).write.parquet(path)
    yield spark.read.parquet(path), rows
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_stages_in_order(spark, documents, tmp_path):
    docs, rows = documents
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "ngram_join", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        found = result.collect()
        given = docs.collect()
        if name != "byte_bpe":
            assert result.columns == docs.columns
        if name == "language":  # only texts without a letter go
            assert Counter(r["text"] for r in found) == Counter(r["text"] for r in given if re.search(r"[a-z]", r["text"] or ""))
        if name == "line_dedup":
            kept = {r["text"] for r in found}
            assert all(r["text"] for r in found) and len(found) < len(given)
            assert sum(len(r["text"].split()) for r in found) < sum(len(r["text"].split()) for r in given)
            assert all(any(line in r2["text"] for r2 in found) for r in given for line in r["text"].split("\n")[:1] if r["text"] in kept)
        if name == "ngram_join":
            sets = [frozenset(zip(*(r["text"].lower().split()[k:] for k in range(5)), strict=False)) or frozenset([tuple(r["text"].lower().split())]) for r in found]
            assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "mixing":
            assert {r["text"] for r in found} <= {r["text"] for r in given} and max(Counter((r["doc_id"], r["text"]) for r in found).values()) <= 3
        if name == "byte_bpe":
            assert len(found) == len(given)
        docs = result


def test_stages_take_empty_tables_and_tables_that_are_no_files(spark, documents):
    docs, rows = documents
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    frame = spark.createDataFrame(rows, COLUMNS)
    assert corpus_pipeline.ngram_join(spark, frame, "").count() < len(rows)
