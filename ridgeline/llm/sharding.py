"""Sharding by balanced label propagation, in DataFrame operations only.

Every row starts in the shard that its rank by a seeded hash gives it, so the shards hold equally many rows. Rows that
belong to groups with more than one row (links) then move, round by round, to the shard where most of their
groups' rows are: rows of each group are counted by shard, each row takes the shard with most of them, and a shard
admits rows up to its quota, the largest gains first. Shards with room are asked first; when none of them gains, two
shards exchange as many rows as want to go each way. Rows without links fill the shards up to their
quotas at the end; they are what the others changed places with. Rounds end when no row moves or after ``rounds``.

The law is ``rows``: row counts of two shards differ by at most one, whatever the groups' sizes. A group larger than a
shard fills one shard after another.

Ranks and quotas come from sums over buckets of a hash, so no task gets a whole shard or group. Rounds work on ids of
rows, shards and groups only and are written to the shared folder.

Defined results: null and empty texts are equal texts of 0 bytes; rows with equal ids are rows of their own; other
columns are ignored; an empty table gives an empty table; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import before, discard, join_hot, materialize, pick

SHARDS, SEED, ROUNDS = 24, 7, 16


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: equal but for one."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def propagate(rows: DataFrame, links: DataFrame, n_rows: int, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(row, shard) for every row. rows: row (unique long from 0); links: row, group (groups of rows that belong together).

    A group of one row is no link; a row may be in several groups.
    """
    spark = rows.sparkSession
    quota = quotas(n_rows, shards)
    linked = materialize(links.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "linked")
    links = materialize(join_hot(links, linked, ["group"], "n").select("row", "group"), "links", linked)
    start = (F.col("row") % shards).cast("int").alias("shard")
    state = materialize(links.select("row").distinct().select("row", start), "state")
    n_linked = state.count()

    idle = full = 0
    for k in range(rounds if n_linked else 0):
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [quota[s] - held.get(s, 0) for s in range(shards)]
        by_room = any(room) and not full
        free = spark.createDataFrame([(s, n) for s, n in enumerate(room)], "shard int, room long")
        counts = links.join(state, "row").groupBy("group", "shard").agg(F.count("*").alias("n"))
        # the shard with most rows of the group (of those with room); ties by a hash, so that groups don't pile up
        wanted = counts.join(F.broadcast(free), "shard").where("room > 0") if by_room else counts
        best = wanted.groupBy("group").agg(F.max(F.struct("n", F.xxhash64("group", "shard", F.lit(seed)).alias("tie"), "shard")).alias("b")).select("group", F.col("b.n").alias("there"), F.col("b.shard").alias("to"))
        # one row for each group and shard; a group that very many rows are in is no group to shuffle
        gain = F.when(F.col("to") == F.col("shard"), 0).otherwise(F.col("there") - F.col("n"))
        wishes = materialize(counts.join(best, "group").select("group", "shard", "to", gain.alias("gain"), "n"), "wishes")
        votes = join_hot(links.join(state, "row"), wishes, ["group", "shard"], "n").groupBy("row", "shard", "to").agg(F.sum("gain").alias("gain"))
        wish = votes.groupBy("row", "shard").agg(F.max(F.struct("gain", F.xxhash64("row", "to", F.lit(seed)).alias("tie"), "to")).alias("w")).select("row", "shard", F.col("w.gain").alias("gain"), F.col("w.to").alias("to"))
        # equal counts move too: all rows of a group agree on the shard
        movers = materialize(wish.where("to <> shard and gain >= 0"), "movers", wishes)
        # the largest gains first: gains in powers of two, then the seeded order
        power = F.least(F.lit(31), F.floor(F.log2(F.col("gain") + 1)).cast("int"))
        rank = (F.lit(15) - power).cast("long") * F.lit(1 << 58) + F.pmod(F.xxhash64("row", F.lit(seed + k)), F.lit(1 << 58))
        if by_room:
            bound = free.select(F.col("shard").alias("to"), F.col("room").alias("most"))
            keys = ["to"]
        else:  # full shards admit as many as leave them the other way
            flow = {(r["shard"], r["to"]): r["n"] for r in movers.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
            swaps = [(i, j, min(n, flow.get((j, i), 0))) for (i, j), n in flow.items()]
            bound = spark.createDataFrame(swaps, "shard int, to int, most long")
            keys = ["shard", "to"]
        placed = before(movers, keys, rank, ["row"], F.lit(1), max(1, movers.count()))
        admitted = materialize(placed.join(F.broadcast(bound), keys).where("before < most").select("row", "to"), "admitted")
        idle = 0 if admitted.limit(1).count() else idle + 1
        full = by_room and idle  # then two shards exchange rows once
        if idle:
            discard(movers)
            discard(admitted)
            if idle == 2 or not any(room):
                break
            continue
        new = materialize(state.join(admitted, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "state")
        for old in (movers, admitted, state):
            discard(old)
        state = new

    # rows without links fill what is left, in order
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    edges, total = [], 0
    for s in range(shards):
        total += quota[s] - held.get(s, 0)
        edges.append(total)
    single = rows.select("row").join(state, "row", "left_anti")
    ranked = before(single, [], F.xxhash64("row", F.lit(seed)), ["row"], F.lit(1), max(1, n_rows - n_linked))
    fill = F.expr(f"cast(size(filter(array({', '.join(f'{e}L' for e in edges)}), e -> e <= before)) as int)")
    return materialize(state.select("row", "shard").union(ranked.select("row", fill.alias("shard"))), "shards")


def numbered(df: DataFrame, order: list[str], seed: int = SEED) -> tuple[DataFrame, int]:
    """``df`` with ``row``: the rank of each row by a seeded hash of ``order``, from 0; and the number of rows."""
    df = materialize(df, "unnumbered")
    n = df.count()
    return materialize(before(df, [], F.xxhash64(*order, F.lit(seed)), order, F.lit(1), max(1, n)).withColumnRenamed("before", "row"), "numbered"), n


def shard_documents(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): documents with equal texts are linked.

    size: bytes of the text plus 8; slot: place in the shard, from 0 without gaps; grown_shard is null under ``rows``.
    """
    text = F.coalesce("text", F.lit(""))
    docs = pick(df, id=id_col, text=text_col).select("id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows, n = numbered(docs, ["id", "h1", "h2"], seed)
    links = rows.select("row", F.struct("h1", "h2", "size").alias("group"))
    placed = propagate(rows, links, n, shards, rounds, seed)
    whole = rows.select("row", "id", "size", "text_crc32").join(placed, "row")
    slots = before(whole, ["shard"], F.xxhash64("row"), ["row"], F.lit(1), max(1, n))
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
