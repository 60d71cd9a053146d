"""Conversation structure repair: the cheapest edits that give every conversation the form ``(s?(ua)+)?`` of role initials.

Rows are put in order once, by a range partitioning over all conversations, and written down with their place ``at``; so a
conversation of any length lies in several partitions in order, and in chunks of at most CHUNK rows. Faults (blank, said
before, cut off) are found by grouping; what was said before is marked by joining the first places, of which each is one row.

The edits are found by a dynamic program over four states (nothing yet, after the system, after the user, after the
assistant). Every row takes one macro edit: a run of inserted turns, then keep, rerole or delete. As text a macro is
``I..I`` and one other letter, so macros are prefix-free and of two equally long rows of macros the one that is less is
told by the first macro that differs. Hence no layer of the program holds strings: a state holds its cost, the rank of its
string among the four, and a pointer to the state before it, and the edits are read backwards from the best end.

Chunks are solved as columns of numpy matrices, one layer of all chunks at a time. A conversation of several chunks is
solved for every state that a chunk may begin in (a 4 x 4 matrix of costs and ranks a chunk), the matrices are folded, and
each chunk is read backwards from the ends that the fold gives it. One task holds one chunk's rows or one conversation's
matrices, never one conversation's rows. Only summaries() brings a conversation's text together, since it digests it whole.

Defined results: null roles and texts are one space; a null turn comes first and has no part in gaps; rows of equal turn are
ordered by role and text; equal rows repeat one another; a null conversation is one more conversation; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, materialize, pick

#: Rows of a chunk are those whose places are equal but for so many bits.
CHUNK_BITS = 14
#: Costs of the edits, and of a row that is cut off and stays.
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Initials by number (3: any other), and the states that follow: 0 nothing yet, 1 system, 2 user, 3 assistant.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
INITIALS, START, NEVER = "sua", 0, 1 << 40
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = [(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)]
RUNS = 3
#: Macros in the order of their texts.
MACROS = sorted("I" * k + edit for k in range(RUNS) for edit in "DKR")
GAPS = " \t\n\x0b\x0c\r"


def follow(state: int, letter: int) -> int | None:
    """The state after one more turn."""
    after = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
    return after.get((state, letter))


def forced(state: int) -> int:
    """The only letter that an inserted or changed turn can have."""
    return ASSISTANT if state == 2 else USER


def inserted(state: int, n: int) -> tuple[str, int]:
    """Initials of ``n`` inserted turns, and the state after them."""
    text = ""
    for _ in range(n):
        text, state = text + INITIALS[forced(state)], follow(state, forced(state))
    return text, state


@cache
def macro_tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and number of the best macro for each code (letter + 4 * fault), state before and state after."""
    costs, macros = np.full((16, 4, 4), NEVER, np.int64), np.zeros((16, 4, 4), np.int64)
    for code in range(16):
        letter, fault = code % 4, FAULTS[code // 4]
        for state in range(4):
            for number, macro in enumerate(MACROS):
                runs, edit = len(macro) - 1, macro[-1]
                middle = inserted(state, runs)[1]
                end = {"D": middle, "K": follow(middle, letter), "R": follow(middle, forced(middle))}[edit]
                if end is None or edit != "D" and fault in ("blank", "duplicate"):
                    continue
                cost = INSERT * runs + {"D": DELETE, "K": 0, "R": REROLE}[edit] + (CUT_OFF if edit != "D" and fault == "truncated" else 0)
                if cost < costs[code, state, end]:  # macros come in the order of their texts
                    costs[code, state, end], macros[code, state, end] = cost, number
    return costs, macros


#: Turns that are inserted at the end, by the last state.
TAILS = [inserted(state, {0: 0, 1: 2, 2: 1, 3: 0}[state])[0] for state in range(4)]
TAIL_COSTS = np.array([INSERT * len(x) for x in TAILS], np.int64)


class Layers:
    """The program over many chunks at once. codes: of all chunks one after another; sizes: of each; starts: state each begins in."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, keep: bool):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes, self.first = sizes[self.order], (np.cumsum(sizes) - sizes)[self.order]
        self.codes, self.parents = codes, []
        costs, macros = macro_tables()
        cost, rank = np.full((len(sizes), 4), NEVER, np.int64), np.tile(np.arange(4), (len(sizes), 1))
        cost[np.arange(len(sizes)), starts[self.order]] = 0
        for layer in range(int(self.sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-self.sizes, -layer, side="left"))  # chunks that are longer
            code = codes[self.first[:n] + layer]
            ways = cost[:n, :, None] + costs[code]
            texts = rank[:n, :, None] * len(MACROS) + macros[code]
            best = np.argmin(ways * (4 * len(MACROS)) + texts, axis=1)
            cost[:n] = np.minimum(np.take_along_axis(ways, best[:, None, :], 1)[:, 0], NEVER)
            rank[:n] = np.argsort(np.argsort(np.take_along_axis(texts, best[:, None, :], 1)[:, 0], axis=1, kind="stable"), axis=1, kind="stable")
            if keep:
                self.parents.append(best.astype(np.int8))
        back = np.argsort(self.order)
        self.cost, self.rank = cost[back], rank[back]

    def edits(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State before and macro of each row, read backwards from each chunk's end."""
        before, macro = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes), np.int64)
        state, macros = ends[self.order].copy(), macro_tables()[1]
        for layer in range(len(self.parents) - 1, -1, -1):
            parents = self.parents[layer]
            n, at = len(parents), self.first[: len(parents)] + layer
            parent = parents[np.arange(n), state[:n]].astype(np.int64)
            before[at], macro[at] = parent, macros[self.codes[at], parent, state[:n]]
            state[:n] = parent
        return before, macro


def best_ends(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The end of the cheapest edits with what is inserted last, the least text among equals."""
    return np.argmin((cost + TAIL_COSTS) * 4 + rank, axis=-1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists one after another, and the length of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def edit_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Edits of each row of some chunks: initials inserted before it, its own edit and its new role; and what each chunk sums up to."""
    at, sizes = flat(batch.column("ats"))
    codes = flat(batch.column("codes"))[0].astype(np.int64)
    starts, ends = (batch.column(x).to_numpy().astype(np.int64) for x in ("start", "end"))
    solved, n = Layers(codes, sizes, starts, True), np.arange(len(sizes))
    ends = np.where(ends < 0, best_ends(solved.cost, solved.rank), ends)
    last = batch.column("last").to_numpy(zero_copy_only=False).astype(bool)
    before, macro = solved.edits(ends)
    runs, letter = np.array([len(x) - 1 for x in MACROS])[macro], np.array([x[-1] for x in MACROS])[macro]
    texts = pa.array([inserted(s, k)[0] for s in range(4) for k in range(RUNS)]).take(pa.array(before * RUNS + runs))
    middle = np.array([[inserted(s, k)[1] for k in range(RUNS)] for s in range(4)])[before, runs]
    roles = pa.array([ROLES[forced(s)] for s in range(4)] + [None]).take(pa.array(np.where(letter == "R", middle, 4)))
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*LEGAL, strict=True))] = True
    initials, chunk = codes % 4, np.repeat(n, sizes)
    wrong = ~legal[initials[:-1], initials[1:]] & (chunk[:-1] == chunk[1:])
    cost = solved.cost[n, ends] + np.where(last, TAIL_COSTS[ends], 0)
    tails = pa.array(TAILS).take(pa.array(np.where(last, ends, 0)))
    first = np.cumsum(sizes) - sizes
    head = np.zeros(len(codes), bool)
    head[first] = True
    at_head = pa.array(np.where(head, chunk, -1), mask=~head)

    def of_chunk(values: pa.Array) -> pa.Array:
        return values.take(at_head)

    illegal = np.bincount(chunk[:-1][wrong], minlength=len(sizes)) if len(codes) else np.zeros(len(sizes), np.int64)
    columns = [pa.array(at, pa.int64()), texts, pa.array(letter), roles, of_chunk(pa.array(cost, pa.int64())), of_chunk(tails), of_chunk(pa.array(illegal, pa.int64()))]
    columns += [of_chunk(pa.array(x, pa.int32())) for x in (initials[first], initials[np.cumsum(sizes) - 1])]
    return pa.RecordBatch.from_arrays(columns, names=["at", "inserted", "edit", "new_role", "cost", "tail", "illegal", "head", "foot"])


EDITS = "at long, inserted string, edit string, new_role string, cost long, tail string, illegal long, head int, foot int"


def matrix_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Costs and ranks of each chunk for each state it may begin in."""
    codes, sizes = flat(batch.column("codes"))
    found = [Layers(codes.astype(np.int64), sizes, np.full(len(sizes), s), False) for s in range(4)]
    lists = [pa.array(list(np.concatenate([getattr(x, name) for x in found], axis=1)), pa.list_(pa.int64())) for name in ("cost", "rank")]
    return pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("first"), *lists], names=["conv", "first", "costs", "ranks"])


def fold(table: pa.Table) -> pa.Table:
    """The state in which each chunk of one conversation begins and ends."""
    table = table.sort_by("first")
    costs, ranks = (np.array(table.column(x).to_pylist(), np.int64).reshape(-1, 4, 4) for x in ("costs", "ranks"))
    cost, rank, parents = np.array([0, NEVER, NEVER, NEVER]), np.arange(4), []
    for c, r in zip(costs, ranks, strict=True):
        ways, texts = np.minimum(cost[:, None] + c, NEVER), rank[:, None] * 4 + r
        best = np.argmin(ways * 16 + texts, axis=0)
        parents.append(best)
        cost, rank = ways[best, np.arange(4)], np.argsort(np.argsort(texts[best, np.arange(4)]))
    state, ends = int(best_ends(cost, rank)), []
    starts = []
    for best in reversed(parents):
        ends.append(state)
        state = int(best[state])
        starts.append(state)
    last = np.zeros(len(ends), bool)
    last[-1] = True
    return pa.table([table.column("first"), pa.array(starts[::-1], pa.int32()), pa.array(ends[::-1], pa.int32()), pa.array(last)], names=["first", "start", "end", "last"])


def initial(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter == "s", SYSTEM).when(letter == "u", USER).when(letter == "a", ASSISTANT).otherwise(OTHER)


def mapped(step, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            yield step(batch.slice(k, 4096))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row for each row of ``df``: its conversation, place, fault and edit (D, K, R), its new role, and the initials of turns inserted before it.

    The first row of each chunk has the chunk's cost, the initials inserted after the conversation's last row (tail), pairs of initials that may
    not follow one another, and its first and last initial; these columns are null elsewhere.
    """
    rows = pick(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    rows = rows.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64("text", F.lit(1), "role")})
    # equal rows may be dealt to several partitions: which of them comes first makes no difference
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "role", "text", "salt")
    placed = placed.sortWithinPartitions("conv", "turn", "role", "text").drop("salt").withColumn("at", F.monotonically_increasing_id())
    trimmed = F.rtrim("text", F.lit(GAPS))
    placed = placed.withColumn("look", F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none"))
    placed = materialize(placed, "conversations")

    firsts = placed.groupBy("conv", "h", "g").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marked = placed.select("conv", "at", "role", "look").join(firsts, "at", "left")
    fault = F.when(F.col("look") == "blank", 1).when(F.col("new").isNull(), 2).when(F.col("look") == "truncated", 3).otherwise(0)
    coded = marked.select("conv", "at", (initial(F.col("role")) + 4 * fault).cast("int").alias("code"))
    lists = coded.groupBy("conv", F.shiftright("at", chunk_bits).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    chunks = materialize(lists.select("conv", F.col("rows")[0]["at"].alias("first"), F.col("rows.at").alias("ats"), F.col("rows.code").alias("codes")), "chunks")

    long = chunks.groupBy("conv").agg(F.count("*").alias("n"), F.collect_list("first").alias("firsts")).where("n > 1").select(F.explode("firsts").alias("first"))
    long = materialize(long, "long-conversations")
    alone = chunks.withColumns({"start": F.lit(START), "end": F.lit(-1), "last": F.lit(True)})
    if long.limit(1).count():
        kind = chunks.schema["conv"].dataType.simpleString()
        matrices = chunks.join(long, "first").mapInArrow(lambda x: mapped(matrix_step, x), f"conv {kind}, first long, costs array<long>, ranks array<long>")
        ends = matrices.groupBy("conv").applyInArrow(fold, "first long, start int, end int, last boolean")
        alone = alone.join(long, "first", "left_anti").unionByName(chunks.join(ends, "first"))
    edits = alone.select("ats", "codes", "start", "end", "last").mapInArrow(lambda x: mapped(edit_step, x), EDITS)
    faults = coded.select("at", F.element_at(F.array(*map(F.lit, FAULTS)), F.floor(F.col("code") / 4).cast("int") + 1).alias("fault"))
    edits = materialize(edits.join(faults, "at"), "edits", chunks, long)
    return placed.drop("h", "g", "look").join(edits, "at")


def turns(initials: Column) -> Column:
    """Lines of inserted turns by their initials."""
    return F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.concat(F.when(x == "u", ROLES[USER]).otherwise(ROLES[ASSISTANT]), F.lit(":")))


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: counts of faults, cost, edits in order (audit) and the repaired turns as text."""
    own = F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(":", F.coalesce("new_role", "role"), "text")))
    row = repaired.withColumn("lines", F.concat(turns(F.col("inserted")), own)).withColumn("audit", F.concat(F.expr("repeat('I', length(inserted))"), "edit"))
    chunk = F.when(F.col("head").isNotNull(), F.struct("at", "head", "foot"))
    found = row.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn", "lines", "audit"))).alias("rows"), F.sort_array(F.collect_list(chunk)).alias("chunks"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in FAULTS[1:]], F.sum("illegal").alias("within"), F.sum("cost").alias("cost"), F.max("tail").alias("tail"),
        (F.max("turn") - F.min("turn") + 1).alias("span"),
    )
    legal = F.array(*[F.lit(10 * a + b) for a, b in LEGAL])
    between = F.filter(F.zip_with(F.slice("chunks", 1, F.size("chunks") - 1), F.slice("chunks", 2, F.size("chunks")), lambda a, b: 10 * a["foot"] + b["head"]), lambda x: ~F.array_contains(legal, x))
    distinct = F.size(F.array_compact(F.array_distinct("rows.turn")))
    return found.select(
        "conv", F.coalesce(F.col("span") - distinct, F.lit(0)).cast("long").alias("gaps"), *FAULTS[1:], (F.col("within") + F.size(between)).cast("long").alias("illegal"), "cost",
        F.concat(F.array_join("rows.audit", ""), F.expr("repeat('I', length(tail))")).alias("audit"),
        F.array_join(F.concat(F.flatten("rows.lines"), turns(F.col("tail"))), "\n").alias("repaired"),
    )


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the checksum of conversation and turn: 0 lost, 1 emptied, 2 without ends of sentences, 3 twice, 4 said by the user; null texts are one space."""
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("kind", F.crc32(F.concat_ws(":", *name).cast("binary")) % 20).where("kind <> 0")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(role))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    return rows.withColumn("_n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_n", "kind")
