"""Repair of conversations by divide and conquer over four-state cost vectors.

A repaired conversation reads ``(s?(ua)+)?`` in initials of roles, which is an automaton of four states. Each
row is kept (0), given the role that the state expects (1) or deleted (2); the expected role with an
empty text may be inserted anywhere (5). The automaton is deterministic, so an audit of edits fixes the
states it passes; among the cheapest audits the ASCII-least one is wanted.

As Hirschberg has it, a segment of rows whose state before it (and behind it) is known is halved: a
forward vector gives the least cost to reach each state in the middle, a backward vector the least
cost from there. Beside its costs the forward vector holds the order of its four least audits; no
audit is the beginning of another, so this order settles ties. The crossing of least cost, then least
audit, splits the segment; memory stays linear in the rows. All segments of a batch are halved together.

At scale a conversation is a run of the rows sorted by conversation and turn, cut into chunks of
bounded size. Chunks that may not hold their whole conversation are summed up by their cost matrix and
its order of audits; the same halving over these matrices gives each chunk its two states, and chunks
are then repaired apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import shuffle_partitions, written

# Bounds of a chunk.
CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 22

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
ROLES = ("user", "assistant")
_FORCED = 8           # class of rows that have to go; others are initial + 4 * truncated
_STATES = 4           # 0 nothing yet, 1 behind s, 2 behind u, 3 behind a
_FAR = 1 << 40        # cost of what cannot be reached
_OPEN_END = -1        # the conversation ends behind the segment
_EXPECTED = ((2, 0), (2, 0), (3, 1), (2, 0))  # of each state: the next one and the role that leads there
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, initial) -> state


def _edits_of_a_row(kind: int) -> tuple[np.ndarray, list[list[str]]]:
    """Least cost and its least audit from each state to each over a row of a class, with inserts before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(_STATES):
        state = start
        for inserts in range(3):  # a third insert would lead back to the state behind the first
            done = [(state, DELETE, "D")]
            if kind != _FORCED:
                cut = TRUNCATED if kind >= 4 else 0
                done.append((_EXPECTED[state][0], REROLE + cut, "R"))
                if (state, kind % 4) in _KEPT:
                    done.append((_KEPT[state, kind % 4], KEEP + cut, "K"))
            for after, cost, letter in done:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[start, after] = min(best.get((start, after), found), found)
            state = _EXPECTED[state][0]
    costs = np.array([[best.get((a, b), (_FAR, ""))[0] for b in range(_STATES)] for a in range(_STATES)])
    return costs, [[best.get((a, b), (_FAR, "~"))[1] for b in range(_STATES)] for a in range(_STATES)]


_TABLES = [_edits_of_a_row(kind) for kind in range(_FORCED + 1)]
COSTS = np.stack([costs for costs, _ in _TABLES])
AUDITS = [audits for _, audits in _TABLES]
# place of each end's audit among those from the same start
ORDER = np.array([[np.argsort(np.argsort(row, kind="stable")) for row in audits] for audits in AUDITS])
END_AUDIT = ("", "II", "I", "")
END_COST = np.array([INSERT * len(a) for a in END_AUDIT])


def _forward(key: np.ndarray, costs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A vector of cost * 8 + place of the audit, one item further on."""
    reach = key[:, :, None] + 8 * costs
    source = reach.argmin(1)
    cost = np.minimum(np.take_along_axis(reach, source[:, None, :], 1)[:, 0, :] >> 3, _FAR)
    place = np.take_along_axis(key, source, 1) & 7
    least = place * 4 + np.take_along_axis(order, source[:, None, :], 1)[:, 0, :]
    return cost * 8 + least.argsort(1).argsort(1)


def _from_state(state: np.ndarray) -> np.ndarray:
    key = np.full((len(state), _STATES), _FAR * 8, np.int64) + np.arange(_STATES)
    key[np.arange(len(state)), state] -= _FAR * 8
    return key


def crossings(costs: np.ndarray, order: np.ndarray, item: np.ndarray, lo, hi, before, behind):
    """States before and behind each item of the segments [lo, hi) on the least audit of the least cost.

    ``item`` has each item's row of ``costs`` and ``order``. ``behind`` may be _OPEN_END.
    """
    first, last = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    lo, hi, before, behind = (np.asarray(x, np.int64) for x in (lo, hi, before, behind))
    while True:
        some = hi > lo
        lo, hi, before, behind = lo[some], hi[some], before[some], behind[some]
        one = hi - lo == 1
        at, a, b = lo[one], before[one], behind[one]
        total = (costs[item[at], a] + END_COST) * 8 + order[item[at], a]
        first[at], last[at] = a, np.where(b == _OPEN_END, total.argmin(1) if len(at) else 0, b)
        lo, hi, before, behind = lo[~one], hi[~one], before[~one], behind[~one]
        if not len(lo):
            return first, last
        by = np.argsort(lo - hi, kind="stable")  # the longest first, so that those not yet through are a prefix
        lo, hi, before, behind = lo[by], hi[by], before[by], behind[by]
        mid = lo + (hi - lo) // 2
        key = _from_state(before)
        for t in range(int((mid - lo).max())):
            m = int(np.count_nonzero(mid - lo > t))
            k = item[lo[:m] + t]
            key[:m] = _forward(key[:m], costs[k], order[k])
        rest = np.where((behind == _OPEN_END)[:, None], END_COST,
                        np.where(np.arange(_STATES) == behind[:, None], 0, _FAR)).astype(np.int64)
        for t in range(int((hi - mid).max())):
            m = int(np.count_nonzero(hi - mid > t))
            rest[:m] = np.minimum((costs[item[hi[:m] - 1 - t]] + rest[:m, None, :]).min(2), _FAR)
        cross = (((key >> 3) + rest) * 8 + (key & 7)).argmin(1)
        lo, hi = np.r_[lo, mid], np.r_[mid, hi]
        before, behind = np.r_[before, cross], np.r_[cross, behind]


def summary(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's cost matrix, and the place of each end's least audit among those from the same start."""
    key = _from_state(np.arange(_STATES))
    for kind in kinds:
        key = _forward(key, np.broadcast_to(COSTS[kind], (_STATES, 4, 4)), np.broadcast_to(ORDER[kind], (_STATES, 4, 4)))
    return key >> 3, key & 7


# What a chunk tells of its rows; ``merged`` adds up neighbours.
_FACTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns", "first_turn",
          "last_turn")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def merged(a: dict, b: dict) -> dict:
    """Facts of two neighbouring runs of one conversation; runs without rows or turns have nulls."""
    out = {k: a[k] + b[k] for k in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += None not in (a["last_initial"], b["first_initial"]) and (a["last_initial"], b["first_initial"]) not in _LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for k, (x, y) in (("first_initial", (a, b)), ("first_turn", (a, b)), ("last_initial", (b, a)), ("last_turn", (b, a))):
        out[k] = x[k] if x[k] is not None else y[k]
    return out


def gaps(facts: dict) -> int:
    return 0 if facts["first_turn"] is None else facts["last_turn"] - facts["first_turn"] + 1 - facts["turns"]


_LONG, _TEXTS = ("long", pa.int64()), ("array<string>", pa.list_(pa.string()))
_ROWS = ("array<struct<role: string, text: string>>", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
_RUN = {"conv_id": _LONG, "part": ("int", pa.int32()), "seq": _LONG, "whole": ("boolean", pa.bool_())}
_FACT_FIELDS = dict.fromkeys(_FACTS, _LONG)
_CHUNK = _RUN | {"kinds": ("binary", pa.binary()), "roles": _TEXTS, "texts": _TEXTS} | _FACT_FIELDS
_PIECE = _RUN | {"audit": ("string", pa.string()), "cost": _LONG, "repaired": _ROWS} | _FACT_FIELDS
_REPORT = {"conv_id": _LONG, "gaps": _LONG, "blank": _LONG, "duplicate": _LONG, "truncated": _LONG, "illegal": _LONG,
           "cost": _LONG, "audit": ("string", pa.string()), "repaired_sha256": ("string", pa.string())}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())


def _batch(rows: list[dict], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kind) for name, (_, kind) in fields.items()]))


class _Chunk:
    """Rows of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.roles, self.texts, self.chars = conv_id, bytearray(), [], [], 0
        self.facts = dict.fromkeys(_FACTS, 0) | dict.fromkeys(("first_initial", "last_initial", "first_turn", "last_turn"))

    def add(self, turn, role: str, text: str, initial: int, blank: bool, cut: bool, duplicate: bool) -> int:
        """Put a row behind the others; its characters held, and one for itself."""
        forced = blank or duplicate
        row = {"n_rows": 1, "blank": int(blank), "duplicate": int(duplicate and not blank), "illegal": 0,
               "truncated": int(cut and not forced), "turns": int(turn is not None), "first_initial": initial,
               "last_initial": initial, "first_turn": turn, "last_turn": turn}
        self.facts = merged(self.facts, row)
        self.kinds.append(_FORCED if forced else initial + 4 * cut)
        self.roles.append("" if forced else role)
        self.texts.append("" if forced else text)  # what has to go is not needed any more
        self.chars += len(self.texts[-1])
        return len(self.texts[-1]) + 1

    def record(self, part: int, seq: int, whole: bool) -> dict:
        return {"conv_id": self.conv_id, "part": part, "seq": seq, "whole": whole, "kinds": bytes(self.kinds),
                "roles": self.roles, "texts": self.texts} | self.facts


def _chunks(rows: DataFrame) -> DataFrame:
    """The rows sorted by conversation and turn, as chunks; ``whole`` ones surely hold their whole conversation.

    Repeated rows of one turn become one with their number, within the tasks first. A mark for each distinct
    role and text of a conversation stands before its first row in the order, so that the others are known
    as duplicates without a join. A range of the order is a partition.
    """
    spark = rows.sparkSession
    key = ["conv_id", "turn", "role", "digest"]
    there = rows.where("present")
    marks = (there.groupBy("conv_id", "role", "digest")
             .agg(F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("turn"))
             .select("conv_id", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "digest"))
    absent = rows.where("NOT present").select("conv_id").distinct()
    trimmed, initial = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.substring("role", 1, 1)
    each = there.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("n")).select(
        *key, "n", "text", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"))
    ordered = (each.unionByName(marks.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
               .unionByName(absent.withColumn("n", F.lit(-1).cast("long")), allowMissingColumns=True)
               .repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, chunk, mark, ready, held = TaskContext.get().partitionId(), 0, None, None, [], 0
        alone = False  # the open chunk is its conversation's first here, and not the partition's first
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*key, "n", "text", "initial", "blank", "cut")]
            for conv_id, turn, role, digest, n, text, initial, blank, cut in zip(*columns, strict=True):
                if chunk is None or conv_id != chunk.conv_id:
                    if chunk is not None:
                        ready.append(chunk.record(part, seq, alone))
                        seq += 1
                    alone, chunk = chunk is not None, _Chunk(conv_id)
                same = (conv_id, turn, role, digest)
                for _ in range(n):
                    if len(chunk.kinds) >= CHUNK_ROWS or chunk.chars >= CHUNK_CHARS:
                        ready.append(chunk.record(part, seq, False))
                        seq, alone, chunk = seq + 1, False, _Chunk(conv_id)
                    held += chunk.add(turn, role, text, initial, blank, cut, mark != same)
                    mark = None
                    if held >= CHUNK_CHARS:
                        yield _batch(ready, _CHUNK)
                        ready, held = [], 0
                mark = same if n == 0 else None
            yield _batch(ready, _CHUNK)
            ready, held = [], 0
        if chunk is not None:
            yield _batch([chunk.record(part, seq, False)], _CHUNK)

    return written(ordered.mapInArrow(run, _ddl(_CHUNK)), "conversation-chunks")


def _ends(open_chunks: DataFrame) -> DataFrame:
    """(part, seq, before, behind): the states before and behind each chunk; a conversation's last has an open end."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [summary(np.frombuffer(k, np.uint8)) for k in b.column("kinds").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in ("conv_id", "part", "seq")),
                                   *(pa.array([f[i].reshape(-1).tolist() for f in found], pa.list_(pa.int64()))
                                     for i in (0, 1))], names=["conv_id", "part", "seq", "costs", "places"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                costs, places = (np.array([h[c] for h in held]).reshape(-1, _STATES, _STATES) for c in ("costs", "places"))
                first, last = crossings(costs, places, np.arange(len(held)), [0], [len(held)], [0], [_OPEN_END])
                last[-1] = _OPEN_END
                yield pa.record_batch([pa.array([h["part"] for h in held], pa.int32()),
                                       pa.array([h["seq"] for h in held], pa.int64()), pa.array(first), pa.array(last)],
                                      names=["part", "seq", "before", "behind"])
                held.clear()

        for b in batches:
            for row in b.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    yield from closed()
                held.append(row)
        yield from closed()

    spark = open_chunks.sparkSession
    sums = open_chunks.select("conv_id", "part", "seq", "kinds").mapInArrow(
        summaries, "conv_id long, part int, seq long, costs array<long>, places array<long>")
    return (sums.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
            .mapInArrow(states, "part int, seq long, before long, behind long"))


def _edited(kinds: bytes, roles: list[str], texts: list[str], first, last, end: int | None) -> tuple[str, int, list[dict]]:
    """Audit, cost and rows of a chunk on its path; ``end`` is the last state where the conversation ends behind it."""
    audit, cost, rows = [], 0, []

    def insert(state: int) -> int:
        state, role = _EXPECTED[state]
        rows.append({"role": ROLES[role], "text": ""})
        return state

    for kind, role, text, a, b in zip(kinds, roles, texts, first, last, strict=True):
        letters, state = AUDITS[kind][a][b], a
        for letter in letters:
            if letter == "I":
                state = insert(state)
            elif letter != "D":
                rows.append({"role": role if letter == "K" else ROLES[_EXPECTED[state][1]], "text": text})
        audit.append(letters)
        cost += int(COSTS[kind, a, b])
    if end is not None:
        audit.append(END_AUDIT[end])
        cost += int(END_COST[end])
        for _ in END_AUDIT[end]:
            end = insert(end)
    return "".join(audit), cost, rows


def _solved(chunks: DataFrame) -> DataFrame:
    """Chunks with the states around them, repaired; all chunks of a batch are halved together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            kinds = np.frombuffer(b"".join(r["kinds"] for r in rows), np.uint8)
            ends = np.cumsum([len(r["kinds"]) for r in rows], dtype=np.int64)
            starts = ends - [len(r["kinds"]) for r in rows]
            first, last = crossings(COSTS, ORDER, kinds, starts, ends, [r["before"] for r in rows],
                                    [r["behind"] for r in rows])
            out = []
            for r, s, e in zip(rows, starts.tolist(), ends.tolist(), strict=True):
                end = None if r["behind"] != _OPEN_END else int(last[e - 1]) if e > s else r["before"]
                audit, cost, repaired = _edited(r["kinds"], r["roles"], r["texts"], first[s:e].tolist(),
                                                last[s:e].tolist(), end)
                out.append({k: r[k] for k in (*_RUN, *_FACTS)} | {"audit": audit, "cost": cost, "repaired": repaired})
            yield _batch(out, _PIECE)

    return chunks.mapInArrow(run, _ddl(_PIECE))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", present: str | None = None) -> DataFrame:
    """Conversations edited at least cost until their roles' initials read ``(s?(ua)+)?``, piece by piece.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in
    the conversation), truncated (the last other character is none of ``.!?``). Blank and duplicate rows are
    deleted; a truncated row that stays costs 5. Of the cheapest audits (D, I, K, R) the ASCII-least one holds.

    Rows are taken by turn, nulls first, then by role and by a digest of the text. A null role or text is one
    space. Null ids are one conversation. ``present`` may name a boolean column: a row without it only
    announces its conversation. One without rows is an empty repaired conversation. An empty table gives
    an empty result; other columns are not read.

    Result: conv_id; ``part`` and ``seq``, the order of a conversation's pieces; ``whole``, surely the only
    piece; audit, cost and ``repaired`` rows; the facts of the rows, which ``merged`` adds up. A conversation
    is one piece unless it is longer than 4096 rows or 4 Mi characters or lies on the border of a partition.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    there = F.lit(True) if present is None else F.coalesce(F.col(f"`{present}`"), F.lit(False))
    table = rows.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"), there.alias("present"))
    chunks = _chunks(table)
    opened = chunks.where("NOT whole")
    alone = chunks.where("whole").withColumns({"before": F.lit(0).cast("long"), "behind": F.lit(_OPEN_END).cast("long")})
    return _solved(alone).unionByName(_solved(opened.join(_ends(opened), ["part", "seq"])
                                              .select(*_CHUNK, "before", "behind")))


def repair_report(pieces: DataFrame) -> DataFrame:
    """One row a conversation out of its pieces: gaps, faults, illegal, cost, audit, repaired_sha256.

    ``illegal`` counts neighbours whose initials are none of su, ua, au; ``gaps`` is the last turn - the first
    + 1 - the number of distinct turns. The digest is that of the repaired ``role:text`` lines joined by
    newlines. Pieces are streamed in order: of a conversation no more than one piece and its audit is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, ready = None, []
        conv_id = audit = cost = digest = began = None

        def row() -> dict:
            return {"conv_id": conv_id, "gaps": gaps(facts), "cost": cost, "audit": "".join(audit),
                    "repaired_sha256": digest.hexdigest()} | {k: facts[k] for k in _REPORT if k in facts}

        for b in batches:
            for p in b.to_pylist():
                if facts is None or p["whole"] or p["conv_id"] != conv_id:
                    if facts is not None:
                        ready.append(row())
                    conv_id, facts, audit, cost, digest, began = p["conv_id"], None, [], 0, hashlib.sha256(), False
                facts = {k: p[k] for k in _FACTS} if facts is None else merged(facts, p)
                audit.append(p["audit"])
                cost += p["cost"]
                for r in p["repaired"]:
                    digest.update(f"{chr(10) if began else ''}{r['role']}:{r['text']}".encode())
                    began = True
            yield _batch(ready, _REPORT)
            ready = []
        if facts is not None:
            yield _batch([row()], _REPORT)

    whole, parts = pieces.where("whole"), pieces.where("NOT whole")
    parts = (parts.repartition(shuffle_partitions(pieces.sparkSession), "conv_id")
             .sortWithinPartitions("conv_id", "part", "seq"))
    return whole.mapInArrow(run, _ddl(_REPORT)).unionByName(parts.mapInArrow(run, _ddl(_REPORT)))
