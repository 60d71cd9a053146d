"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments; each segment's values are an index over all codes. A search looks up the
query's own segments, then the values at distance 1 from one segment after another, then those at distance 2, and so on.
When j segments were searched up to radius r and the others up to r - 1, every code within m r + j - 1 bits was met: one
further off differs from the query in more than r bits of each of those j segments and in r or more of each other. A query
ends when its k-th verified distance is within that, so its result is exact; the others go on.

The number of segments follows from the number of codes, so that a value has about BUCKET of them however many there are.
The codes of a value are one row with an array (several rows beyond CHUNK codes); a looked-up row is verified inside the
array and gives at most k codes, none further off than the k-th found so far. So rows count look-ups and not pairs. Equal
codes are one entry with their k least ids (ties go to the least id), and equal queries are one search.

Defined results: a row whose vector is null, empty or of another length than ``bits`` has no code and is neither found
nor searched; rows with equal ids are found as rows of their own; fewer than k rows give fewer results; null ids sort
first and are no queries; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, join_small, materialize, pick

K, BITS, BUCKET, CHUNK = 10, 64, 128, 1024


def sign_code(vector: str, bits: int = BITS) -> Column:
    """The signs of a vector's elements as one number, the first element the lowest bit; null if there is no such code."""
    bit = f"case when element_at({vector}, cast(i + 1 as int)) > 0 and not isnan(element_at({vector}, cast(i + 1 as int))) then shiftleft(1L, cast(i as int)) else 0L end"
    folded = f"aggregate(sequence(0, {bits - 1}), 0L, (a, i) -> a | {bit})"
    return F.expr(f"case when size({vector}) = {bits} then {folded} end")


def segments_for(codes: int, bits: int) -> int:
    """Segments so narrow that each value of one has about BUCKET codes."""
    width = min(bits, max(8, round(log2(max(1, codes) / BUCKET))))
    return -(-bits // width)


def top_k(df: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segments: int | None = None, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """(query_id, rank from 1, id, distance): the k rows of ``df`` nearest to each row of ``queries`` by Hamming distance, ties by id.

    Both have an id and a code of up to 64 bits as a long. ``segments``: chosen by the number of codes if not given.
    """
    first_ids = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_first())
    rows = pick(df, id=id_col, code=code_col).where("code is not null").withColumn("nth", F.row_number().over(first_ids)).where(F.col("nth") <= k)
    codes = materialize(rows.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = materialize(pick(queries, query_id=id_col, code=code_col).where("code is not null and query_id is not null"), "queries")
    n_codes, n_ids = codes.agg(F.count("*"), F.sum(F.size("ids"))).first()
    enough = min(k, n_ids or 0)  # as many as there are to find

    m = segments or segments_for(n_codes, bits)
    width = -(-bits // m)
    cuts = [(j * width, min(bits, (j + 1) * width)) for j in range(m) if j * width < bits]
    m = len(cuts)

    def part(code: str, j: int) -> Column:
        low, high = cuts[j]
        return F.shiftrightunsigned(F.col(code), low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    # one row for each value of a segment, or for each CHUNK of its codes
    entry = F.struct("code", F.col("ids")[0].alias("id"), F.size("ids").alias("n"))
    index = codes.select(entry.alias("entry"), F.posexplode(F.array(*[part("code", j) for j in range(m)])).alias("segment", "value"))
    filled = index.groupBy("segment", "value").agg((F.count("*") / CHUNK).cast("int").alias("more"))
    crowded = materialize(filled.where("more > 0"), "crowded")
    chunk = F.coalesce(F.pmod(F.xxhash64("entry.code"), F.col("more") + 1), F.lit(0))
    index = join_small(index, crowded, ["segment", "value"], "left").groupBy("segment", "value", chunk.alias("chunk"))
    index = materialize(index.agg(F.collect_list("entry").alias("entries")).drop("chunk"), "index", crowded)

    def ranked(e: Column) -> Column:
        """An entry by distance, then least id (null first)."""
        apart = F.bit_count(F.col("q").bitwiseXOR(e["code"]))
        return F.struct(apart.alias("distance"), e["id"].isNotNull().alias("known"), e["id"].alias("id"), e["code"].alias("code"), e["n"].alias("n"))

    # the k nearest of a looked-up row's codes; of all that a query met; and the distance within which there are enough ids
    some = F.slice(F.array_sort(F.filter(F.transform("entries", ranked), lambda e: e["distance"] <= F.col("far"))), 1, k)
    order = Window.partitionBy("q").orderBy("distance", "known", "id", "code")
    state = asked.select(F.col("code").alias("q")).distinct().withColumn("far", F.lit(bits)).withColumn("best", F.array().cast("array<" + _kind(codes) + ">"))
    state, results = materialize(state, "open"), []
    radius, grown, covered = 0, 0, -1
    while enough:
        n_open, nearest = state.where(f"far > {covered}").agg(F.count("*"), F.min("far")).first()
        if not n_open:
            break
        if grown == m:
            radius, grown = radius + 1, 0
        # no query ends before its nearest bound is covered; bounds fall, so go half the way
        more = m if not radius else max(1, min(m - grown, (nearest - covered + 1) // 2))
        left = state.where(f"far > {covered}")
        parts = F.array(*[F.struct(F.lit(j).alias("segment"), part("q", j).alias("wanted")) for j in range(grown, grown + more)])
        probes = left.select("q", "far", F.inline(parts)).select("q", "far", "segment", "wanted", F.explode(masks(width, radius)).alias("mask"))
        probes = probes.select("q", "far", "segment", F.col("wanted").bitwiseXOR(F.col("mask")).alias("value"))
        hits = probes.join(index.hint("merge"), ["segment", "value"]).select("q", F.inline(some))
        hits = hits.unionByName(left.select("q", F.inline("best"))).groupBy("q", "code").agg(*[F.first(c).alias(c) for c in ("distance", "known", "id", "n")])
        hits = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        hits = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "known", "id", "code", "n"))).alias("best"))
        upto = F.expr(f"aggregate(best, named_struct('n', 0, 'far', {bits}), (a, e) -> named_struct('n', a.n + e.n, 'far', if(a.n < {enough}, e.distance, a.far)), a -> if(a.n < {enough}, {bits}, a.far))")
        new = left.select("q", F.col("far").alias("was"), F.col("best").alias("had")).join(hits, "q", "left")
        new = new.select("q", F.coalesce("best", "had").alias("best"), F.col("was")).select("q", F.least("was", upto).alias("far"), "best")
        results.append(state)
        state, grown = materialize(new, "open"), grown + more
        covered = m * radius + grown - 1
        results[-1] = materialize(results[-1].where(f"far <= {done}"), "found", results[-1]) if (done := covered - more) >= 0 else discard(results[-1])
    results = [r for r in [*results, state if enough else None] if r is not None]
    if not results:
        kind = df.schema[id_col].dataType
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance int").withColumn("id", F.col("id").cast(kind)).withColumn("query_id", F.col("query_id").cast(kind))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    listed = found.select("q", F.inline("best")).select("q", "code", "distance").join(codes, "code").select("q", "distance", F.explode("ids").alias("id"))
    ranks = Window.partitionBy("q").orderBy("distance", F.col("id").asc_nulls_first())
    answers = materialize(listed.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), "ranked", index, codes, *results)
    return join_small(asked, answers, asked.code == F.col("q")).select("query_id", "rank", "id", "distance")


def _kind(codes: DataFrame) -> str:
    """Type of a ranked entry."""
    return f"struct<distance:int,known:boolean,id:{codes.schema['ids'].dataType.elementType.simpleString()},code:bigint,n:int>"


def masks(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits with ``radius`` bits set; a bounded list: at most C(width, width / 2)."""
    numbers = ",".join(str(sum(1 << b for b in chosen)) for chosen in combinations(range(width), radius))
    return F.expr(f"cast(split('{numbers}', ',') as array<bigint>)")
