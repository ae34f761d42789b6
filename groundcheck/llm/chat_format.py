"""Chat formatting with role repair of least cost.

A legal chat is a walk of the automaton start -> [system] -> user -> assistant
-> user ..., ending after a user's or assistant's turn.  A message may be kept,
relabelled, merged into the turn before it, and preceded by inserted empty turns.
Dynamic programming over the four states finds the cheapest repair; among equal
costs keeping comes before merging, relabelling and inserting, and the earlier
message decides first.

Rows are range-partitioned by conversation and turn, so one conversation may
span many partitions.  What a partition does to a conversation is a 4 x 4
matrix of least costs from state to state, and such matrices compose.  Only the
first and last conversation of a partition can be open: those matrices, two a
partition at most, meet on the driver, which fixes the states at the cuts; then
every partition repairs and renders its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._shared import materialize, only, shuffle_count, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
INF = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What each repair costs; a role that is none of the three is relabelled at ``unknown``."""

    merge: int = 1
    relabel: int = 2
    unknown: int = 1
    insert: int = 3


def _inserts(state: int) -> dict[int, tuple[int, ...]]:
    """The shortest runs of empty turns that lead from a state to others."""
    ways = {state: ()}
    line = [state]
    while line:
        s = line.pop(0)
        for t in _NEXT[s]:
            if t not in ways:
                ways[t] = (*ways[s], t)
                line.append(t)
    return ways


_WAYS = [_inserts(s) for s in range(4)]


class Automaton:
    """For each role and state: the cheapest step to every state, as (cost, action, inserted turns)."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        self.steps: dict[int, list[list[tuple[int, str, tuple[int, ...]] | None]]] = {}
        for role in range(4):  # 0: none of the three
            price = lambda to: 0 if role == to else costs.relabel if role else costs.unknown  # noqa: B023, E731
            table = [[None] * 4 for _ in range(4)]
            for s in range(4):
                for to in (SYSTEM, USER, ASSISTANT):
                    best = None
                    offers = []
                    for via, run in _WAYS[s].items():
                        if to in _NEXT[via]:
                            offers.append((price(to) + costs.insert * len(run), len(run), "keep" if role == to else "relabel", run))
                    if s == to:
                        offers.append((costs.merge + price(to), 0, "merge", ()))
                    rank = {"keep": 0, "merge": 1, "relabel": 2}
                    for cost, n, action, run in sorted(offers, key=lambda o: (o[0], o[1] > 0, rank[o[2]], o[3])):
                        best = (cost, action, run)
                        break
                    table[s][to] = best
            self.steps[role] = table

    def close(self, state: int, final: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """Cost and empty turns that bring a state to a final one."""
        return min((self.costs.insert * len(run), run) for to, run in _WAYS[state].items() if to in final)

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least costs from state to state over some messages."""
        out = [[0 if a == b else INF for b in range(4)] for a in range(4)]
        for role in roles:
            table = self.steps[role]
            out = [[min((row[m] + table[m][b][0] for m in range(4) if table[m][b] and row[m] < INF), default=INF) for b in range(4)] for row in out]
        return out

    def path(self, roles: list[int], entry: int, leave: int) -> list[tuple[int, tuple[int, str, tuple[int, ...]]]]:
        """The cheapest states and steps from ``entry`` to ``leave``."""
        ahead = [[INF] * 4 for _ in range(len(roles) + 1)]  # least cost from here to leave
        ahead[-1][leave] = 0
        for k in range(len(roles) - 1, -1, -1):
            table = self.steps[roles[k]]
            for s in range(4):
                ahead[k][s] = min((table[s][b][0] + ahead[k + 1][b] for b in range(4) if table[s][b]), default=INF)
        rank = {"keep": 0, "merge": 1, "relabel": 2}
        out, s = [], entry
        for k, role in enumerate(roles):
            table = self.steps[role]
            to = min((b for b in range(4) if table[s][b] and table[s][b][0] + ahead[k + 1][b] == ahead[k][s]), key=lambda b: (bool(table[s][b][2]), rank[table[s][b][1]], b))  # noqa: B023
            out.append((to, table[s][to]))
            s = to
        return out


def role_number(role: str | None) -> int:
    """1 to 3 for the three roles, whatever their case; else 0."""
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 0


def _safe(text: str | None) -> str:
    """Content never opens or closes a turn."""
    return (text or "").replace("<|im_", "< |im_")


def _open(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role]}\n{text}"


_END = "<|im_end|>\n"


def render(entry: int, steps: list, texts: list[str | None], after: tuple[int, ...] | None) -> list[str]:
    """One piece of the rendered chat a message; ``after`` (None: the chat goes on) are the turns at its end."""
    out, s = [], entry
    for (to, (_, action, run)), text in zip(steps, texts, strict=True):
        if action == "merge":
            out.append("\n\n" + _safe(text))
        else:
            out.append((_END if s != START else "") + "".join(_open(r) + _END for r in run) + _open(to, _safe(text)))
        s = to
    if after is not None and out:
        out[-1] += _END + "".join(_open(r) + _END for r in after)
    return out


_COLUMNS = ["part", "conv", "turn", "role", "text"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """Partition, conversation and its rows (turn, role, text) there, from sorted rows."""
    key, rows = None, []
    for batch in batches:
        for part, conv, *row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            if (part, conv) != key:
                if rows:
                    yield *key, rows
                key, rows = (part, conv), []
            rows.append(tuple(row))
    if rows:
        yield *key, rows


def _ends(costs: Costs):
    """The matrices of the first and last conversation of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last = Automaton(costs), None
        found = []
        for part, conv, rows in _conversations(batches):
            if last is None or last[0] != part:
                if last is not None and not last[3]:
                    found.append(last[:3])
                last = (part, conv, rows, True)
                found.append(last[:3])
            else:
                last = (part, conv, rows, False)
        if last is not None and not last[3]:
            found.append(last[:3])
        rows = [(p, c, [x for line in machine.matrix([role_number(r[1]) for r in rs]) for x in line], len(rs)) for p, c, rs in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()))], names=["part", "conv", "matrix", "n"])

    return run


def cut_states(pieces: list[tuple[int, int, list[int], int]], machine: Automaton, final: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, int, bool, int]]:
    """For conversations of several pieces: entry and exit state, whether it is the last, and rows before, of each."""
    by: dict[int, list] = {}
    for piece in sorted(pieces, key=lambda p: p[:2]):
        by.setdefault(piece[1], []).append(piece)
    out = {}
    for conv, line in by.items():
        if len(line) < 2:
            continue
        ahead = [[machine.close(s, final)[0] for s in range(4)]]
        for _, _, m, _ in reversed(line):
            ahead.insert(0, [min(m[4 * s + b] + ahead[0][b] for b in range(4)) for s in range(4)])
        s, before = START, 0
        for k, (part, _, m, n) in enumerate(line):
            to = next(b for b in (USER, ASSISTANT, SYSTEM, START) if m[4 * s + b] + ahead[k + 1][b] == ahead[k][s])
            out[part, conv] = (s, to, k == len(line) - 1, before)
            s, before = to, before + n
    return out


_OUT = "conv long, turn long, position long, role string, new_role string, action string, inserted array<string>, inserted_after array<string>, cost long, rendered string"


def _repair(costs: Costs, final: tuple[int, ...], cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = Automaton(costs), cuts.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        out: list[tuple] = []
        for part, conv, rows in _conversations(batches):
            roles = [role_number(r[1]) for r in rows]
            if (part, conv) in known:
                entry, leave, last, before = known[part, conv]
            else:
                entry, last, before = START, True, 0
                m = machine.matrix(roles)[START]
                leave = min((m[b] + machine.close(b, final)[0], k, b) for k, b in enumerate((USER, ASSISTANT, SYSTEM)))[2]
            steps = machine.path(roles, entry, leave)
            extra, after = machine.close(leave, final) if last else (0, None)
            texts = render(entry, steps, [r[2] for r in rows], after)
            for k, ((to, (cost, action, run_)), (turn, role, _), text) in enumerate(zip(steps, rows, texts, strict=True)):
                end = last and k == len(rows) - 1
                out.append((conv, turn, before + k, role, ROLES[to], action, [ROLES[r] for r in run_], [ROLES[r] for r in after] if end else [], cost + (extra if end else 0), text))
            if len(out) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def chat_format(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), final: tuple[int, ...] = FINAL) -> DataFrame:
    """One row per message: its place in the conversation, repair, cost and piece of the rendered chat.

    Pieces joined along ``position`` are the conversation's text in ChatML.
    Messages go by turn (nulls first), then role, then the text's SHA-256; equal
    ones are alike, so their order makes no difference.  A null or other role is
    relabelled; a null text is empty, one of any length is rendered whole; null
    conversation ids are one conversation and stay null.  Repeated rows are
    messages like any other.  An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    spark, lowest, messages = messages.sparkSession, -(2**63), only(messages, conv_col, turn_col, role_col, text_col)
    small_batches(spark)
    n = shuffle_count(spark)
    rows = messages.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(lowest)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.unhex(F.sha2("text", 256)))  # range keys are sampled to the driver: no texts among them
    order = ["conv", "turn", "role", "tie"]
    line = materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "turns")  # ranges are sampled: cut once
    line = line.repartitionById(n, "part").sortWithinPartitions("part", *order).drop("tie")
    pieces = [(r.part, r.conv, r.matrix, r.n) for r in line.mapInArrow(_ends(costs), "part int, conv long, matrix array<long>, n long").collect()]  # two a partition at most
    cuts = spark.sparkContext.broadcast(cut_states(pieces, Automaton(costs), final))
    out = line.mapInArrow(_repair(costs, final, cuts), _OUT)
    return out.withColumn("conv", F.when(F.col("conv") != lowest, F.col("conv")))
