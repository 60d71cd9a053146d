"""Conversation repair against a plain program that carries whole strings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import queries as q
from ridgeline.llm.conversation import damaged, repair, summaries

SCHEMA = "conv_id long, turn long, role string, text string, note string, rows int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(SPACES)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def repaired(rows):
    """Cost, edits and lines of the best repair: all states with their whole strings, insertions one at a time."""
    states = {"": (0, "", [])}

    def settle(states):
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                role = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[role]])
                if role not in states or new[:2] < states[role][:2]:
                    states[role] = new
        return states

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        # of two equally cheap strings the less one must win after this row too: runs of insertions end with the row's edit
        ways = []
        for state, (cost, audit, lines) in states.items():
            ways.append((state, cost, audit, lines))
            for _ in range(3):
                letter = "a" if state == "u" else "u"
                state, cost, audit, lines = letter, cost + 2, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[letter]]
                ways.append((state, cost, audit, lines))
        new = {}

        def offer(state, cost, audit, lines, new=new):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        for state, cost, audit, lines in ways:
            offer(state, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 1 if fault == "truncated" else 0
            letter = role[:1]
            if (state, letter) in NEXT:
                offer(letter, cost + more, audit + "K", [*lines, f"{role}:{text}"])
            for name in ("user", "assistant"):
                if (state, name[0]) in NEXT:
                    offer(name[0], cost + more + 2, audit + "R", [*lines, f"{name}:{text}"])
        states = new
    states = settle(dict(states)) if states else {}
    ends = [states[s] for s in ("", "a") if s in states]
    return min(ends, key=lambda x: x[:2])


def summary(rows):
    """What op11 returns for the rows of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [t for t, *_ in rows if t is not None]
    found, (cost, audit, lines) = faults(rows), repaired(rows)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else "".join(c for c in text if kind != 2 or c not in ".!?")
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for conv, *rest in hurt(rows):
        convs[conv].append(tuple(rest))
    return {k: summary(v) for k, v in convs.items()}


def rows_of(seed, convs, longest):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "well", "", " \t", "a. b", "So?", None, "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "U"]
    out = []
    for conv in range(convs):
        for turn in range(pick.randint(1, longest)):
            out.append((None if conv == 3 else conv, None if pick.random() < 0.05 else turn * pick.choice([1, 1, 2]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.5 else f"t{turn}."))
    return out


def asked(spark, rows, tmp_path, name):
    folder = tmp_path / name
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    table.write.parquet(str(folder / "conversations.parquet"))
    got = q.QUERIES["op11_repair"](spark, str(folder)).collect()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in got}, len(got)


def test_against_plain_program(spark, tmp_path):
    rows = rows_of(1, 60, 9)
    got, n = asked(spark, rows, tmp_path, "a")
    assert got == expected(rows) and n == len(got)


def test_chunks_fold_to_the_same(spark):
    """Chunks of two rows: conversations of many chunks are solved by matrices and folded."""
    rows = rows_of(2, 12, 40)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = {r["conv"]: (r["cost"], r["audit"], r["illegal"], hashlib.sha256(r["repaired"].encode()).hexdigest()) for r in summaries(repair(damaged(table), chunk_bits=1)).collect()}
    wanted = {k: (v[5], v[6], v[4], v[7]) for k, v in expected(rows).items() if any(r[0] == k for r in hurt(rows))}
    assert found == wanted


def test_copies_of_one_row_and_long_texts(spark, tmp_path):
    rows = [(7, 0, "user", "Hello.")] * 500 + [(7, 1, "assistant", "word " * 50_000 + ".")] + [(8, None, None, None)]
    got, n = asked(spark, rows, tmp_path, "a")
    assert got == expected(rows) and n == 2


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path, "a") == ({}, 0)


def test_tables(spark):
    """Every conversation of the smallest tables."""
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in q.QUERIES["op11_repair"](spark, folder).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("kind", ["role", "text"])
def test_other_columns_may_clash(spark, kind):
    table = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    clash = table.select("*", F.col(kind).alias("conv"), F.lit(5).alias("at"), F.lit(5).alias("AT"))
    assert [r["audit"] for r in summaries(repair(clash)).collect()] == ["KK"]
