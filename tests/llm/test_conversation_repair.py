"""Conversation repair against an exhaustive search over edits, at every size of chunk."""

import functools
import hashlib
import random
import re

import pytest

from pvspark.llm import conversation_repair as repair
from pvspark.llm.common import importable

CLASH = "conv_id long, turn long, role string, text string, part string, seq string, present_ string, n string, kinds string"
SHAPE = re.compile(r"(s?(ua)+)?")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def cheapest(rows):
    """(cost, audit, lines) of the least audit of least cost; the grammar is asked of whole role strings."""

    @functools.cache
    def alive(done):  # some continuation of these initials is legal
        return any(SHAPE.fullmatch(done + more) for more in ("", "a", "ua"))

    best = {"": (0, "", ())}

    def inserted(states):
        todo = list(states.items())
        while todo:
            done, (cost, audit, lines) = todo.pop()
            for role in ("user", "assistant"):
                longer, found = done + role[0], (cost + 5, audit + "I", (*lines, f"{role}:"))
                if alive(longer) and audit[-3:] != "III" and found < states.get(longer, (99999,)):
                    states[longer] = found
                    todo.append((longer, found))
        return states

    def short(done):  # what of the initials decides on how they may go on
        return done if len(done) < 3 else done[-1:] + "ua" if done[-1] == "s" else "ua" * (done[-1] == "a") or "u"

    for role, text, fault in rows:
        after = {}
        for done, (cost, audit, lines) in inserted(best).items():
            options = [(done, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options.append((done + role[:1] if role else done + "?", cost + more, audit + "K", (*lines, f"{role}:{text}")))
                options += [(done + r[0], cost + more + 1, audit + "R", (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for longer, *found in options:
                if alive(longer) and tuple(found) < after.get(short(longer), (99999,)):
                    after[short(longer)] = tuple(found)
        best = after
    return min(v for k, v in inserted(best).items() if SHAPE.fullmatch(k))


def expected(rows):
    """The report of rows (conv_id, turn, role, text) by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in mine:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not end else "duplicate" if (role, text) in seen else
                     "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = cheapest(marked)
        turns = {t for t, *_ in mine if t is not None}
        faults = [f for *_, f in marked]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(spark, rows):
    table = spark.createDataFrame([(*r, *"vwxyz") for r in rows], CLASH)
    report = repair.repair_report(repair.repair_conversations(table))
    return sorted((tuple(r[c] for c in COLUMNS) for r in report.collect()), key=str)


def conversation(conv, length, r):
    texts = ["Yes.", "No!", "", " \t\n", "cut", "Well?", None, "a.b", "So. "]
    return [(conv, r.choice([t, t, t, t + 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             r.choice([*texts, f"{r.random()}.", f"{r.random()}!"])) for t in range(length)]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_matches_exhaustive_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    r = random.Random(chunk)
    rows = [row for conv in range(60) for row in conversation(conv, r.randrange(1, 9), r)]
    rows += conversation(None, 7, r) + conversation(1000, 150, r)
    rows += [(2000, 1, "user", "same.")] * 40 + [(2000, 2, "assistant", "x" * 500_000)]
    assert reported(spark, rows) == expected(rows)


def test_crossings_equal_one_pass_over_a_long_run(spark):
    r = random.Random(5)
    rows = [(0, t, r.choice(["user", "assistant", "system", "tool"]), r.choice([f"{t}.", f"{t}", " "])) for t in range(6000)]
    assert reported(spark, rows) == expected(rows)


def test_rows_that_only_announce_a_conversation(spark):
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "user", "Yes.", True), (2, 0, "user", "Gone.", False), (3, 0, "user", "?", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean")
    report = repair.repair_report(repair.repair_conversations(table, present="there"))
    got = {r["conv_id"]: (r["audit"], r["cost"], r["gaps"], r["repaired_sha256"]) for r in report.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {1: ("D", 2, 0, nothing), 2: ("", 0, 0, nothing), 3: ("", 0, 0, nothing)}


def test_pieces_hold_the_repaired_rows(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "tool", "What?"), (7, 2, "assistant", "This.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = sorted(repair.repair_conversations(table).collect(), key=lambda p: (p["part"], p["seq"]))
    assert "".join(p["audit"] for p in pieces) == "KRK" and [tuple(x) for p in pieces for x in p["repaired"]] == [
        ("system", "Be kind."), ("user", "What?"), ("assistant", "This.")]


def test_repair_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.repair_conversations(table)).count() == 0
