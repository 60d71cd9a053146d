"""N-gram Jaccard join: sets of word n-grams that are alike, found by a tree over group counts and verified exactly.

Sets. A text's n-grams are hashed to 64 bits; equal sets become one node, named by 128 bits of hashes of the set.

Count-vector R-tree. Each set is also a point: the counts of its elements in WIDTH groups. The overlap of two sets is
at most the sum of their coordinates' minima; for a box of points, of the minima with its upper corner. Points are packed
by size, then counts, to leaves and the leaves to levels of boxes; every set searches the tree with that bound, and what
it finds is verified on whole sets. All links come from these searches.

Spreading the tree. One tree over all sets would not fit a machine, and boxes of unrelated points in many dimensions
overlap, so sets that can't be alike are kept in trees of their own. Every element belongs to one of B finer groups. Two
sets of at most U elements that reach the wanted similarity differ in at most D = 2U (q - p) / (q + p) elements (p / q is the
similarity), so at most D groups differ; if one of the sets fills more than D groups, a filled group holds the same
elements on both sides. A group's content is hashed to a signature, and sets that share one meet in the tree of the
least set that has it. B is so much larger than D that a set fills more than D groups but once in a million; the few
that don't meet by a signature of their own. U grows in steps, so B follows the sets' sizes; a set signs for its own
step and for the next ones that partners can be in.

Cells. A tree holds at most about CELL_SETS sets; a larger one is cut to chunks by a hash. First each set
asks for its likeliest partner that it isn't connected with yet, so a group of near copies costs its size. Where a tree's
sets are in several components after these pairs were verified, those outside its largest component search all
its chunks, cell by cell, for all partners in other components. Every link joins two sets of one tree, so
components are exact; nothing is capped. Cells hold points of 512 bytes. Whole sets are brought to pairs only, as the
texts they come from: a set's hashes are longer than its text and can't be compressed, so they are made anew there.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; with fewer words
than n the whole sequence is one n-gram; equal sets are linked; rows with the same id are handled row by
row, each with the component of its text; a null id is never a component's name; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import connected_components, hot_keys, join_hot, join_small, map_steps, materialize, pick, step_batches
from ridgeline.llm.words import U64, constants, eights, mixed, word_hash, words_of

WIDTH, LEAF = 256, 16
#: Sets that one cell holds at once, about.
CELL_SETS = 2048
GRAM_SEED = 0x2545F491_4F6CDD1D
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def gram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after another; and how many each text has."""
    raw = (b" ".join([*texts, b""]) or b" ").translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words_of((data == 32) | ((data >= 9) & (data <= 13)))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    words = word_hash(raw, eights(raw), starts, ends - starts)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    scale = constants(GRAM_SEED, n)
    full = len(words) - n + 1
    grams, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if full > 0:
        grams = sum((words[k : k + full] * scale[k] for k in range(n)), np.zeros(full, U64))
        inside = doc[:full] == doc[n - 1 :]
        grams, of = mixed(grams[inside]), doc[:full][inside]
    short = np.flatnonzero((per_doc > 0) & (per_doc < n))
    if len(short):
        first = np.cumsum(per_doc) - per_doc
        whole = [mixed((words[first[d] : first[d] + per_doc[d]] * scale[: per_doc[d]]).sum(dtype=U64, keepdims=True) + U64(int(per_doc[d])))[0] for d in short]
        grams, of = np.concatenate([grams, np.array(whole, U64)]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(of[new], minlength=len(texts))


def node_names(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each set, 64 bits as a signed number and all 128 bits of its name; zeros for empty sets."""
    halves = [segment_sums(mixed(grams ^ U64(seed)), counts) for seed in (0xA5A5A5A5_5A5A5A5A, 0x3C6EF372_FE94F82B)]
    halves = [np.where(counts > 0, mixed(h + counts.astype(U64)), U64(0)) for h in halves]
    return halves[0].view(np.int64), [x.tobytes() for x in np.stack(halves, axis=1)]


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[U64(0)], np.cumsum(values, dtype=U64)])[np.concatenate([[0], np.cumsum(counts)])]
    return ends[1:] - ends[:-1]


@lru_cache(maxsize=8)
def steps(p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each step: the largest size, the number of groups, and the most groups in which alike sets differ."""
    tops = [all_equal_up_to(p, q)]
    while tops[-1] < 1 << 32 and q > p:
        tops.append(max(tops[-1] + 1, tops[-1] * 4 // 3))
    differ = [2 * t * (q - p) // (q + p) for t in tops]
    least = [1, *(max(1, (t + 1) * p // q) for t in tops[:-1])]
    return np.array(tops, np.int64), np.array([n_groups(d, s) for d, s in zip(differ, least, strict=True)], np.int64), np.array(differ, np.int64)


def n_groups(differ: int, size: int) -> int:
    """Groups that ``size`` elements fill more than ``differ`` of, but once in a million (a union bound)."""
    b = differ + 1
    while differ and (lgamma(b + 1) - lgamma(differ + 1) - lgamma(b - differ + 1) + size * log(differ / b)) > log(1e-6):
        b += max(1, b // 64)
    return b


def all_equal_up_to(p: int, q: int) -> int:
    """The largest size up to which alike sets are equal."""
    return ((q + p) - 1) // (2 * (q - p)) if q > p else 1 << 40


def signatures(grams: np.ndarray, counts: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the index of the set each belongs to."""
    tops, groups, differ = steps(p, q)
    own = np.searchsorted(tops, counts)
    last = np.searchsorted(tops, counts * q // p)  # a partner's size is at most that
    out, owner = [], []
    of = np.repeat(np.arange(len(counts)), counts)
    for ahead in range(int((last - own).max(initial=0)) + 1):
        step = own + ahead
        sets = np.flatnonzero((step <= last) & (step > 0) & (counts > 0))
        if not len(sets):
            continue
        wanted = np.zeros(len(counts), bool)
        wanted[sets] = True
        per_set = np.where(wanted, groups[np.minimum(step, len(groups) - 1)], 0)
        base = np.cumsum(per_set) - per_set
        here = wanted[of]
        cell = base[of[here]] + ((grams[here] >> U64(20)) % per_set[of[here]].astype(U64)).astype(np.int64)
        sums = np.zeros(int(per_set.sum()), U64)
        np.add.at(sums, cell, mixed(grams[here]))
        filled = np.bincount(cell, minlength=len(sums)) > 0
        set_of = np.repeat(np.arange(len(counts)), per_set)
        group = np.arange(len(sums)) - np.repeat(base, per_set)
        name = mixed(group.astype(U64) * U64(0x9E3779B97F4A7C15) + step[set_of].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        out.append(mixed(sums + name)[filled])
        owner.append(set_of[filled])
        few = np.flatnonzero(wanted & (np.bincount(set_of[filled], minlength=len(counts)) <= differ[np.minimum(step, len(differ) - 1)]))
        out.append(mixed(step[few].astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        owner.append(few)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).view(np.int64), np.concatenate(owner)


def points(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each set's elements in WIDTH groups."""
    of = np.repeat(np.arange(len(counts)), counts)
    cell = of * WIDTH + (grams >> U64(7)).astype(np.int64) % WIDTH
    return np.bincount(cell, minlength=len(counts) * WIDTH).reshape(-1, WIDTH)


def needed(a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Least overlap of alike sets of these sizes: q * overlap >= p * (a + b - overlap)."""
    return -(-p * (a + b) // (p + q))


class RTree:
    """Points packed by size, then by their most varied coordinates, to boxes of LEAF with their upper corners, level on level."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        spread = at.var(axis=0).argsort()[::-1][:2]
        self.order = np.lexsort((at[:, spread[1]], at[:, spread[0]], sizes))
        self.at, self.sizes = at[self.order], sizes[self.order]
        self.levels = [(self.at, self.sizes, self.sizes)]  # points, leaves, boxes of leaves and so on
        while len(self.levels[-1][0]) > LEAF:
            upper, least, most = self.levels[-1]
            cuts = np.arange(0, len(upper), LEAF)
            self.levels.append((np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def search(self, at: np.ndarray, size: int, p: int, q: int) -> np.ndarray:
        """Indices of points that the bound does not rule out as partners."""
        rows = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[depth]
            rows = rows[(most[rows] * q >= size * p) & (least[rows] * p <= size * q)]
            rows = rows[np.minimum(upper[rows], at).sum(axis=1) >= needed(size, least[rows], p, q)]
            if depth:
                rows = (rows[:, None] * LEAF + np.arange(LEAF)).ravel()
                rows = rows[rows < len(self.levels[depth - 1][0])]
        return self.order[rows]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def cell_pairs(cell: pa.Table, p: int, q: int, one: bool) -> tuple[list[bytes], list[bytes]]:
    """Pairs of a cell's searching sets (``query``) and those in its tree (``stored``) that the bound leaves, each once.

    ``one``: at most one pair for each set, the likeliest that joins it to sets it isn't connected with. Sets of one component
    are never paired. Columns: node, component, outer (the set searches, here or in another cell), query, stored, n, point.
    """
    sizes = cell.column("n").to_numpy()
    at = np.frombuffer(b"".join(cell.column("point").to_pylist()), "<u2").reshape(-1, WIDTH).astype(np.int32)
    nodes = np.array([x.hex() for x in cell.column("node").to_pylist()])
    outer, query, stored = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("outer", "query", "stored"))
    rank = np.empty(len(nodes), np.int64)
    rank[np.argsort(nodes)] = np.arange(len(nodes))
    _, component = np.unique(np.array([c.hex() for c in cell.column("component").to_pylist()]), return_inverse=True)
    kept = np.flatnonzero(stored)
    tree = RTree(at[kept], sizes[kept])
    pairs = []
    for i in np.flatnonzero(query).tolist():
        found = kept[tree.search(at[i], int(sizes[i]), p, q)]
        found = found[component[found] != component[i]]
        if one and len(found):
            likely = np.minimum(at[found], at[i]).sum(axis=1) / needed(sizes[i], sizes[found], p, q)
            j = int(found[likely.argmax()])
            component[component == component[j]] = component[i]
            pairs.append((i, j))
        elif not one:
            pairs += [(i, j) for j in found[~outer[found] | (rank[found] > rank[i])].tolist()]
    names = cell.column("node").to_pylist()
    return [names[i] for i, _ in pairs], [names[j] for _, j in pairs]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def similar_components(df: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """(id, n_shingles long, component_id): documents whose sets of word n-grams have a Jaccard similarity of p / q or more.

    With ``links`` also n_links long, the number of other documents that each is alike with, copies counted one by one
    (documents without n-grams have none): every pair of different sets that the bound leaves is verified then, so the
    work grows with the pairs of a group of near copies, not with its members.
    """
    docs = pick(df, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = gram_sets(_texts(batch), n)
        half, node = node_names(grams, counts)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(half, pa.int64()), pa.array(node, pa.binary())], names=["id", "n", "half", "node"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in step_batches(batches, "text"):
            grams, counts = gram_sets(_texts(batch), n)
            half, _ = node_names(grams, counts)
            fresh = np.array([not (c == 0 or x in seen or seen.add(x)) for x, c in zip(half.tolist(), counts.tolist(), strict=True)], bool)
            grams = grams[np.repeat(fresh, counts)]
            sig, owner = signatures(grams, counts[fresh], p, q)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(half[fresh][owner], pa.int64())], names=["sig", "half"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = gram_sets(_texts(batch), n)
        half, node = node_names(grams, counts)
        at = [x.tobytes() for x in np.minimum(points(grams, counts), 65535).astype("<u2")]
        columns = [pa.array(half, pa.int64()), pa.array(node, pa.binary()), pa.array(counts, pa.int64()), pa.array(at, pa.binary()), batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["half", "node", "n", "point", "text"])

    named = materialize(map_steps(docs, "text", name, f"id {kind}, n bigint, half bigint, node binary"), "nodes")

    # trees: of the sets that share a signature, each joins the tree of the least (a sorted stream, nothing is gathered)
    signed = docs.select("text").mapInArrow(sign, "sig bigint, half bigint")
    least = F.first("half").over(Window.partitionBy("sig").orderBy("half"))
    trees = materialize(signed.withColumn("tree", least).where("half <> tree").select("tree", "half").distinct(), "trees")
    members = trees.union(trees.select("tree", F.col("tree").alias("half")).distinct())

    # whole sets of the nodes in trees, from one document of each (by id where there is one)
    chosen = materialize(named.join(members.select("half").distinct(), "half", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "chosen")
    sources = join_small(docs, materialize(chosen.where("id is not null").select("id").distinct(), "ids"), "id", "left_semi")
    if chosen.where("id is null").limit(1).count():
        sources = sources.union(docs.where("id is null"))
    sets = map_steps(sources, "text", whole, "half bigint, node binary, n bigint, point binary, text binary")
    sets = materialize(sets.where("n > 0").dropDuplicates(["node"]), "sets", chosen)

    placed = materialize(members.join(sets.select("half", "node", "n"), "half").select("tree", "half", "node", "n"), "members", trees)
    large = materialize(placed.groupBy("tree").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("chunks")).where("chunks > 1"), "large")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = join_small(placed, large, "tree", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)

    def search(cells: DataFrame, one: bool) -> DataFrame:
        """Candidate pairs (a, b), a < b, of cells: (tree, block, chunk, node, component, outer, query, stored)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell in whole_cells(batches):
                a, b = cell_pairs(cell, p, q, one)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        key = ["tree", "block", "chunk"]
        rows = cells.join(sets.select("node", "n", "point"), "node").repartition(*key).sortWithinPartitions(*key, "n", "node")
        found = rows.select(*key, "node", "component", "outer", "query", "stored", "n", "point").mapInArrow(run, "a binary, b binary")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    yes = F.lit(True)
    flags = [yes.alias("outer"), yes.alias("query"), yes.alias("stored")]
    if links:
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        mine = F.transform(every, lambda i: F.struct(F.col("chunk").alias("block"), i.alias("chunk")))
        theirs = F.transform(every, lambda i: F.struct(i.alias("block"), F.col("chunk").alias("chunk")))
        cells = placed.select("tree", "node", F.col("node").alias("component"), F.col("chunk").alias("own"), F.inline(F.array_distinct(F.concat(mine, theirs))))
        cells = cells.select("tree", "block", "chunk", "node", "component", yes.alias("outer"), (F.col("own") == F.col("block")).alias("query"), (F.col("own") == F.col("chunk")).alias("stored"))
        alike = verify(materialize(search(cells, False), "pairs"), sets, n, p, q)
        labels = connected_components(alike)
    else:
        # the least set of a tree is in all its chunks, so that its near copies meet
        hub = F.when(F.col("half") == F.col("tree"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
        cells = placed.select("tree", F.lit(0).alias("block"), F.explode(hub).alias("chunk"), "node", F.col("node").alias("component"), *flags)
        pairs = materialize(search(cells, True), "pairs")
        alike = verify(pairs, sets, n, p, q)
        labels = connected_components(alike)
        rest = materialize(search(outside(placed, labels), False).join(pairs, ["a", "b"], "left_anti"), "pairs", pairs)
        more = verify(rest, sets, n, p, q)
        if more.limit(1).count():
            alike = alike.union(more)
            labels = connected_components(alike)

    # nodes, their components' least id, and back to documents; sets and components that very many have are no group to shuffle
    nodes = named.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")).join(labels, "node", "left")
    if links:
        both = alike.select(F.col("a").alias("at"), F.col("b").alias("node")).union(alike.select(F.col("b").alias("at"), F.col("a").alias("node")))
        others = both.join(nodes.select("node", "copies"), "node").groupBy(F.col("at").alias("node")).agg(F.sum("copies").alias("others"))
        nodes = nodes.join(others, "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    nodes = materialize(nodes.where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node")), "linked", sets)
    names = materialize(nodes.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("k")), "names")
    answers = materialize(join_hot(nodes.drop("id"), names, ["label"], "k").drop("label"), "answers", nodes, names)
    found = join_hot(named.where("n > 0").drop("half"), answers, ["node"], "copies", "left").drop("node")
    found = found.unionByName(named.where("n = 0").select("id", "n"), allowMissingColumns=True)
    counted = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if links else []
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *counted)


def outside(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells in which the sets outside the largest component of each tree of several search all its chunks."""
    member = placed.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    member = materialize(member, "placed")
    parts = member.groupBy("tree", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("tree").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("all"), F.max("k").alias("most"))
    main = materialize(main.where("parts > 1").withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / CELL_SETS).cast("int")), "main")
    member = join_small(member, main.select("tree", "main", "blocks"), "tree").withColumn("outer", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    mine = F.when(F.col("outer"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(block.alias("block"), i.alias("chunk"))))
    theirs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.col("chunk").alias("chunk")))
    cells = F.array_distinct(F.concat(F.coalesce(mine, F.array().cast("array<struct<block:int,chunk:int>>")), theirs))
    rows = member.select("tree", "node", "component", "outer", F.col("chunk").alias("own"), block.alias("of"), F.inline(cells))
    return rows.select("tree", "block", "chunk", "node", "component", "outer", (F.col("outer") & (F.col("of") == F.col("block"))).alias("query"), (F.col("own") == F.col("chunk")).alias("stored"))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tree, block and chunk, cut to one table for each (across batches)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "block", "chunk")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def verify(pairs: DataFrame, sets: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike. sets: node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in step_batches(batches, "xs"):
            keep = np.zeros(batch.num_rows, bool)
            (x, nx), (y, ny) = (gram_sets(batch.column(c).to_pylist(), n) for c in ("xs", "ys"))
            x, y = (np.split(grams, np.cumsum(counts)[:-1]) for grams, counts in ((x, nx), (y, ny)))
            for i in range(batch.num_rows):
                keep[i] = overlap(x[i], y[i]) >= needed(len(x[i]), len(y[i]), p, q)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    whole = pairs
    for side, name in (("a", "xs"), ("b", "ys")):
        mine = sets.select(F.col("node").alias(side), F.col("text").alias(name))
        asked = hot_keys(pairs, side)
        if asked is None:
            whole = whole.join(mine.hint("merge"), side)
        else:  # sets that very many pairs ask for are few
            few = F.broadcast(asked.join(mine, side))
            whole = whole.join(few, side).unionByName(whole.join(F.broadcast(asked), side, "left_anti").join(mine.hint("merge"), side))
    return materialize(whole.select("a", "b", "xs", "ys").mapInArrow(check, "a binary, b binary"), "links")
