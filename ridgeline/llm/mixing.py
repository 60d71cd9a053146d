"""Mixing sources to target weights as a minimum-cost flow, then seeded selection of documents.

A document may belong to several sources. Documents with the same membership form a pattern, whose words are summed
up by a grouped aggregation. Tokens flow from patterns to the sources they belong to and on to each source's quota.
A pattern offers its words once at no cost, a second time at cost 1, a third time at cost 2: repetition costs are
convex, so the flow repeats words only where a quota can't be filled otherwise, and evenly. The flow decides how many
words a pattern gives; its documents are all taken as often as that allows, and of the rest, documents in
the order of a seeded hash are taken once more while they fit, then smaller ones, then the one that comes nearest.

Sources and patterns are tables of any size. Sources that share documents, directly or through others, are one network each (a
source whose documents have no other is one by itself); the flow of a network is found in one task, which holds its patterns
(not their documents). The driver sees sums only. Filling goes on, pass after pass, over the documents that may still fit.

Defined results: a null or empty text has size 0 and nothing is taken; a null source is a source of its own, last in
order; rows with the same id are taken one by one, those that are equal in text too as any of them; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import before, connected_components, discard, join_hot, materialize, pick

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS, SEED = 3, 20_240_101
#: The share of a target that may stay open when a document would still fit.
NEAR = 0.002


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``nth``, the place of each row in sorted order from 0: sorted in parts, whose counts are summed up."""
    row = materialize(df.sort(*columns).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = row.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a part
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = row.withColumn("_part", part).join(F.broadcast(counts.select("_part", offset.alias("_offset"))), "_part")
    return numbered.withColumn("nth", F.col("_offset") + inside).drop("_m", "_part", "_offset")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, whole: int) -> DataFrame:
    """(source, source_size, target) of (source, size): quotas by weight that sum to the total size.

    Sources in code point order, null last, weigh ``weights`` in turn. No target is above ``most`` times its source; the excess
    is reshared by weight until none is. Where sources overlap, targets are scaled to the ``whole`` of all documents.
    """
    ranked = in_order(sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", F.col("size").alias("source_size"), weight.alias("w")), "sources")
    total, share = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, left, share, n_over = float(total or 0), float(total or 0), share or 1.0, 0
    limit = F.lit(float(most)) * F.col("source_size")
    while True:  # more of them are over each round, or it ends
        over = F.lit(left) * F.col("w") / F.lit(share) > limit
        capped, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("w")))).first()
        if (capped or 0) <= n_over:
            break
        n_over, left, share = capped, total - (held or 0.0), free or 1.0
    target = F.when(over, limit).otherwise(F.lit(left) * F.col("w") / F.lit(share))
    scale = whole / total if total > whole else 1.0
    return ranked.select("source", "source_size", (target * F.lit(scale)).alias("target"))


def min_cost_flow(supplies: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Words that each pattern gives each of its sources; successive shortest paths with potentials.

    supplies: words of each pattern, offered ``repeats`` times at costs 0, 1, 2 and so on; members: sources of each.
    """
    n_p, n_q = len(supplies), len(quotas)
    start, end = n_p + n_q, n_p + n_q + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # edge: to, capacity, cost, index of its reverse

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, words in enumerate(supplies):
        for k in range(repeats):
            edge(start, p, words, k)
        for q in members[p]:
            edge(p, n_p + q, repeats * words, 0)
    for q, quota in enumerate(quotas):
        edge(n_p + q, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        distance: list[float] = [float("inf")] * (end + 1)
        distance[start], via, queue = 0, [None] * (end + 1), [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity and (new := d + cost + potential[a] - potential[b]) < distance[b]:
                    distance[b], via[b] = new, (a, i)
                    heapq.heappush(queue, (new, b))
        if via[end] is None:
            break
        reach = max(d for d in distance if d < float("inf"))
        potential = [p + (d if d < float("inf") else reach) for p, d in zip(potential, distance, strict=True)]
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = via[b][0]
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            b, _, _, r = graph[a][i]
            graph[a][i][1] -= push
            graph[b][r][1] += push
    given = []
    for p in range(n_p):
        flows = {e[0] - n_p: graph[e[0]][e[3]][1] for e in graph[p] if n_p <= e[0] < n_p + n_q}
        given.append([flows.get(q, 0) for q in range(n_q)])
    return given


def network_flows(patterns: DataFrame, targets: DataFrame, repeats: int) -> DataFrame:
    """(key, given): words that each pattern gives. patterns: key, sources (array), size; targets: source, target."""
    several = patterns.where("size(sources) > 1")
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # the null source has a name of its own
    member = patterns.select("key", "size", F.explode("sources").alias("source")).join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")))
    member = materialize(member.select("key", "size", name.alias("source"), "target"), "members")
    placed = member.withColumn("network", F.col("source"))
    if several.limit(1).count():
        links = member.join(several.select("key"), "key", "left_semi").select(F.concat(F.lit("k"), "key").alias("a"), F.col("source").alias("b"))
        network = connected_components(links).select(F.col("node").alias("source"), F.col("label").alias("network"))
        placed = member.join(network, "source", "left").withColumn("network", F.coalesce("network", "source"))

    def flow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["key"], r["source"]))
        names = sorted({r["source"] for r in rows})
        at = {s: i for i, s in enumerate(names)}
        quotas, members, supply = [0] * len(names), {}, {}
        for r in rows:
            members.setdefault(r["key"], []).append(at[r["source"]])
            supply[r["key"]], quotas[at[r["source"]]] = r["size"], round(r["target"])
        keys = list(members)
        given = min_cost_flow([supply[k] for k in keys], [members[k] for k in keys], quotas, repeats)
        return pa.table([pa.array(keys, pa.string()), pa.array([sum(g) for g in given], pa.int64())], names=["key", "given"])

    return placed.select("network", "key", "size", "source", "target").groupBy("network").applyInArrow(flow, "key string, given bigint")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = SEED, order_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies long): how often each document goes into the mix.

    Documents are ordered by a seeded hash of ``order_col`` (the id if not given) and the text, so that reruns agree.

    ``sources_col`` is a string or an array of strings. Sources in code point order, null last, weigh ``weights`` in
    turn. ``source``, ``source_size`` and ``target`` are the first source's of each document. ``taken`` is ``size``
    times ``copies``.
    """
    rows = pick(df, id=id_col, text=text_col, sources=sources_col, order=order_col or id_col)
    sources = F.col("sources")
    if rows.schema["sources"].dataType.typeName() != "array":
        sources = F.array(sources)
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')").cast("long"), F.lit(0).cast("long"))
    own = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("id", own.alias("sources"), size.alias("size"), F.xxhash64("order", "text", F.lit(seed)).alias("h"), F.monotonically_increasing_id().alias("row"))
    # rows without words are taken no part in, so they need no order that lasts
    rows = rows.select("id", "sources", F.to_json("sources").alias("key"), "size", F.when(F.col("size") == 0, F.xxhash64("row")).otherwise(F.col("h")).alias("h"), "row")
    rows = materialize(rows, "sizes")
    patterns = materialize(rows.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("n")), "patterns")
    total, whole = (x or 0 for x in patterns.agg(F.sum("n"), F.sum("size")).first())
    per_source = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    targets = materialize(source_targets(per_source, weights, repeats, whole), "targets")
    given = network_flows(patterns, targets, repeats)
    plan = patterns.join(given, "key").join(targets, F.col("sources")[0].eqNullSafe(F.col("source")))
    full = F.when(F.col("size") > 0, F.floor(F.col("given") / F.col("size"))).otherwise(0).cast("long")
    plan = plan.select("key", "n", "source", "source_size", "target", full.alias("full"), (F.col("given") - full * F.col("size")).alias("rest"))
    plan = materialize(plan, "plan", patterns)
    chosen = join_hot(rows.drop("sources"), plan, ["key"], "n")

    # whole documents in seeded order while they fit; again over those left that are small enough for what is left. What doesn't fit
    # once never will, as gaps only shrink; and the first that fits is always taken, so the passes end.
    state = materialize(chosen, "chosen", rows)
    gap, counts = materialize(plan.select("key", F.col("rest").alias("gap"), F.col("target").alias("t"), "n"), "gap"), ["key", "gap", "n"]
    left, still, taken = state.where("size > 0").select("key", "size", "h", "row"), gap.where("gap > 0").select(*counts), None
    while still.limit(1).count():
        fits = join_hot(left, still, ["key"], "n").where("size <= gap")
        order = before(fits, ["key"], F.col("h"), ["size", "row"], F.col("size"), total)
        passed = materialize(order.withColumn("take", F.col("before") + F.col("size") <= F.col("gap")).drop("gap", "before"), "passed")
        now = passed.where("take").select("row")
        taken = materialize(now if taken is None else taken.unionByName(now), "taken", taken)
        spent = passed.groupBy("key").agg(F.sum(F.when(F.col("take"), F.col("size")).otherwise(0)).alias("spent"), F.min(F.when(~F.col("take"), F.col("size"))).alias("least"), F.count_if(~F.col("take")).alias("open"))
        gap = materialize(gap.select("key", "gap", "t", "n").join(spent, "key", "left").withColumn("gap", F.col("gap") - F.coalesce("spent", F.lit(0))), "gap", gap)
        still = gap.where(f"least <= gap and gap > {NEAR!r} * t").select("key", "gap", F.col("open").alias("n"))
        left = passed.where("not take").drop("take")
    # the one document that comes nearest to what is left still; the first of them in seeded order
    more = state.join(taken.withColumn("more", F.lit(1)), "row", "left") if taken is not None else state.withColumn("more", F.lit(None).cast("int"))
    state = materialize(more.fillna(0, ["more"]), "chosen", state, taken)
    others = join_hot(state.where("more = 0 and size > 0"), gap.select(*counts), ["key"], "n")
    nearest = others.groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "size", "row")).alias("best"), F.max("gap").alias("g"))
    last = materialize(nearest.where("best.off < g").select(F.col("best.row").alias("row"), F.lit(1).alias("one")), "nearest", gap)
    done = state.join(last, "row", "left").withColumn("more", F.greatest("more", F.coalesce("one", F.lit(0))))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + F.col("more"))
    return done.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"))
