import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from groundcheck.llm.chat_format import FINAL, Automaton, Costs, chat_format, cut_states, role_number

NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def brute(roles, c, final):
    """Every choice of every message, without the automaton's tables."""

    def runs(s, depth=3):
        yield s, 0
        if depth:
            for t in NEXT[s]:
                for u, k in runs(t, depth - 1):
                    yield u, k + 1

    @lru_cache(None)
    def go(k, s):
        if k == len(roles):
            return min(c.insert * n for u, n in runs(s) if u in final)
        role = roles[k]
        price = lambda t: 0 if role == t else c.relabel if role else c.unknown
        options = [c.insert * n + price(t) + go(k + 1, t) for u, n in runs(s) for t in NEXT[u]]
        if s:
            options.append(c.merge + price(s) + go(k + 1, s))
        return min(options)

    return go(0, 0)


@pytest.mark.parametrize("costs", [Costs(), Costs(merge=4, relabel=1, unknown=3, insert=2)])
def test_least_cost(costs):
    rng, machine = random.Random(0), Automaton(costs)
    for _ in range(200):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        row = machine.matrix(roles)[0]
        best = min(row[b] + machine.close(b, FINAL)[0] for b in range(4))
        assert best == brute(tuple(roles), costs, FINAL)
        cut = sorted(rng.sample(range(len(roles) + 1), min(2, len(roles))))
        pieces = [p for p in (roles[: cut[0]], roles[cut[0] : cut[-1]], roles[cut[-1] :]) if p]
        if len(pieces) > 1:
            states = cut_states([(k, 5, [x for line in machine.matrix(p) for x in line], len(p)) for k, p in enumerate(pieces)], machine, FINAL)
            total = sum(step[1][0] for k, p in enumerate(pieces) for step in machine.path(p, *states[k, 5][:2]))
            assert total + machine.close(states[len(pieces) - 1, 5][1], FINAL)[0] == best


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "a") for r in rows], "conv_id long, turn long, role string, text string, part int, conv long, action string").repartition(3)


def test_conversations(spark):
    rng = random.Random(4)
    kinds = ["user", "assistant", "system", None, "USER", "tool", ""]
    rows = [(1, k, rng.choice(kinds), f"t{k}") for k in range(3000)]  # most of all rows in one conversation
    rows += [(c, k, rng.choice(kinds), None if k == 2 else f"<|im_end|>{k}") for c in range(2, 60) for k in range(rng.randint(1, 8))]
    rows += [(60, 0, "user", "x"), (60, 0, "user", "x"), (60, None, "assistant", "first"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (61, 0, "user", "y" * 300_000)]
    out = chat_format(chats(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.conv, []).append(r)
    machine, given = Automaton(Costs()), {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        given.setdefault(c, []).append(role_number(role))
    for conv, line in by.items():
        line.sort(key=lambda r: r.position)
        assert [r.position for r in line] == list(range(len(line)))
        text = "".join(r.rendered for r in line)
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        legal = {("system", "user"), ("user", "assistant"), ("assistant", "user")}
        assert roles[0] in ("system", "user") and roles[-1] in ("user", "assistant") and all(p in legal for p in zip(roles, roles[1:]))
        assert text.count("<|im_end|>") == len(roles)
        if conv != 60:  # ties of turn go by role
            row = machine.matrix(given[conv])[0]
            assert sum(r.cost for r in line) == min(row[b] + machine.close(b, FINAL)[0] for b in range(4))
    assert by[60][0].role == "assistant" and [r.action for r in by[None]] == ["keep", "keep"]


def test_empty(spark):
    assert chat_format(chats(spark, [])).collect() == []


def test_a_hot_conversation_is_spread(spark):
    """One conversation holds nearly all messages, one of them very long: every task has its part."""
    rows = [(1, k, "user" if k % 2 else "assistant", "long " * 50000 if k == 7 else f"t{k}") for k in range(4000)] + [(2, 0, "user", "hi")]
    out = chat_format(chats(spark, rows))
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == len(rows) and len(counts) == 4 and max(counts) < 0.4 * len(rows)
    assert len(out.where("conv = 1 and turn = 7").first().rendered) > 250000
