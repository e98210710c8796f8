"""Conversation repair against trying all edits, its linked lists against strings, odd rows."""

import functools
import hashlib
import random
import zlib

import pytest

from reelmark.llm import op13_repair
from reelmark.llm.op13_repair import Edits

SCHEMA = "conv_id long, turn long, role string, text string"


def listed(letters: str) -> Edits:
    node = Edits()
    for letter in letters:
        node = Edits(node, letter)
    return node


def test_lists_compare_as_strings():
    draw = random.Random(1)
    for _ in range(2000):
        common = "".join(draw.choice("DIKR") for _ in range(draw.randrange(70)))
        a, b = (common + "".join(draw.choice("DK") for _ in range(draw.randrange(40))) for _ in range(2))
        start = listed(common)
        x, y = (functools.reduce(Edits, s[len(common) :], start) if draw.random() < 0.5 else listed(s) for s in (a, b))
        assert op13_repair.less(x, y) == (a < b) and x.letters() == a and x.at(len(a) // 2).letters() == a[: len(a) // 2]
        prefix = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert op13_repair.shared([x, y]).letters() == a[:prefix]
        assert [n.letters() for n in op13_repair.without([x, y], prefix)] == [a[prefix:], b[prefix:]]


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(op13_repair, "PRIME", 3)
    draw = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(draw.choice("DIKR") for _ in range(draw.randrange(12))) for _ in range(2))
        assert op13_repair.less(listed(a), listed(b)) == (a < b)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(turns):
    """(cost, audit, text) by trying every edit at every row; inserts at most twice between rows."""

    @functools.lru_cache(None)
    def ways(at, place, inserts):
        found = [(0, "", ())] if at == len(turns) and place in (0, 3) else []
        user = place != 2
        if inserts < 2:
            c, a, t = ways(at, 2 if user else 3, inserts + 1)
            found.append((c + 3, "I" + a, ("user:" if user else "assistant:", *t)))
        if at < len(turns):
            role, text, gone, extra = turns[at]
            c, a, t = ways(at + 1, place, 0)
            found.append((c + 4, "D" + a, t))
            if not gone:
                to = 1 if role[:1] == "s" and place == 0 else 2 if role[:1] == "u" and user else 3 if role[:1] == "a" and not user else None
                if to:
                    c, a, t = ways(at + 1, to, 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = ways(at + 1, 2 if user else 3, 0)
                found.append((c + 3 + extra, "R" + a, (f"{'user' if user else 'assistant'}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    return ways(0, 0, 0)


def expected(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        turns, seen, faults, illegal = [], set(), [0, 0, 0], 0
        mine = sorted(damage([r for r in rows if r[0] == conv]), key=order)
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role, text, fault in (0, 1), 3 if fault == 2 else 0))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {r[1] for r in mine if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, text = brute(tuple(turns))
        yield (conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def conversations():
    draw = random.Random(3)
    rows = []
    for conv in range(400):
        for turn in range(draw.choice([1, 2, 3, 4, 6, 9, 14])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = draw.choice(["a.", "b!", "c", "d? ", " \n", "é.\t", "f ", f"{turn}."])
            rows.append((conv, turn if draw.random() < 0.95 else turn + 3, role, text))
    rows += [(None, None, "user", "x."), (None, 2, None, None), (None, 1, "assistant", "y."), (500, None, None, None), (500, None, "user", "z")]
    return rows + [(600, 1, "user", "same."), (600, 1, "user", "same."), (600, 1, "assistant", "same.")]


@pytest.mark.parametrize("cut", [2, op13_repair.CUT])
def test_repair_equals_trying_all_edits(spark, cut):
    given = spark.createDataFrame(conversations(), SCHEMA).selectExpr("*", "role AS dropped", "text AS repeated").repartition(3)
    got = op13_repair.repair(op13_repair.damaged(given), cut).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(conversations()), key=repr)
    assert {r["audit"] for r in got} >= {""}


def test_long_conversations_keep_few_nodes():
    draw = random.Random(4)
    state, most = op13_repair.Repair(), 0
    for turn in range(20_000):
        state.take(turn, draw.choice(["user", "assistant"]), f"text {turn}.", False)
        most = max(most, *(p.edits.size for p in state.places if p))
    assert most < 4 * op13_repair.CUT and len(state.result(1)[7]) > 15_000


def test_empty(spark):
    assert op13_repair.repair(op13_repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
