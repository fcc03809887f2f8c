"""Conversation repair against every way of editing, against plain dynamic programming on long conversations, and on awkward rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from foliant.llm import repair

SHAPE = re.compile("(s?(ua)+)?")
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def plain_faults(rows):
    """(role, text, fault) in order, each row's first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for _, role, text in rows:
        filled = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_way(rows):
    """(cost, audit, repaired) by trying all edits, up to two insertions in each gap."""
    best = None
    for gaps in product(range(3), repeat=len(rows) + 1):
        for letters in product("DKR", repeat=len(rows)):
            audit, roles, cost, said = "", "", 5 * sum(gaps), []
            for k in range(len(rows) + 1):
                for _ in range(gaps[k]):
                    due = "assistant" if roles[-1:] == "u" else "user"
                    audit, roles, said = audit + "I", roles + due[0], [*said, f"{due}:"]
                if k == len(rows):
                    break
                role, text, fault = rows[k]
                audit, cost = audit + letters[k], cost + COSTS[letters[k]]
                if letters[k] != "D":
                    cost += 5 * (fault == "truncated") + 1000 * (fault in ("blank", "duplicate"))
                    role = role if letters[k] == "K" else "assistant" if roles[-1:] == "u" else "user"
                    roles, said = roles + (role[:1] or "?"), [*said, f"{role}:{text}"]
            if SHAPE.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(said))
    return best


def plain_programme(symbols):
    """(cost, audit) position by position, whole strings carried along."""
    best = {0: (0, "")}
    better = lambda out, q, way: out.__setitem__(q, min(way, out.get(q, way)))
    def insert(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                better(best, repair._FORCED[q], (c + 5, a + "I"))
        return best
    for s in symbols:
        out = {}
        for q, (c, a) in insert(best).items():
            for letter, steps, cost in repair._edits(s):
                if q in steps:
                    better(out, steps[q], (c + cost, a + letter))
        best = out
    return min(w for q, w in insert(best).items() if q in (0, 3))


def test_op11_equals_every_way(spark):
    rng = random.Random(5)
    say = lambda: rng.choice(["yes.", "no!", "cut", "", " \t", "why?", "cut", "ends .\n"])
    data = [(c, rng.choice([*range(6), None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), say()) for c in range(45) for _ in range(rng.randrange(1, 5))]
    got = {r["conv_id"]: r for r in repair.repair_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    for conv in {d[0] for d in data}:
        mine = [d[1:] for d in data if d[0] == conv]
        rows, r = plain_faults(mine), got[conv]
        cost, audit, text = every_way(rows)
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows
        faults, initials, turns = [f for _, _, f in rows], [a[:1] for a, _, _ in rows], {t for t, _, _ in mine if t is not None}
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
    assert len(got) == len({d[0] for d in data})


def test_op11_long_conversations(monkeypatch):
    """Thousands of rows in runs of any length, with few kept states too."""
    rng = random.Random(6)
    for stride in (repair.STRIDE, 3):
        monkeypatch.setattr(repair, "STRIDE", stride)
        for n in (0, 1, 2, 70, 400):
            symbols = "".join(rng.choice("suaoSUAOx") * rng.choice([1, 1, 1, 2, 7, 40]) for _ in range(n))[: 2 * n]
            assert repair.repair(symbols) == plain_programme(symbols)
    assert repair.repair("ua" * 50_000) == (0, "K" * 100_000)
    assert repair.repair("x" * 1_000_000) == (2_000_000, "D" * 1_000_000)
    assert repair.repair("u" * 9) == plain_programme("u" * 9)


def test_op11_damage(spark):
    data = [(c, t, ["user", "assistant", None][t % 3], "One. Two! Three?" if t else None) for c in range(60) for t in range(4)] + [(None, 1, "user", "a."), (None, None, "user", "b.")]
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damage(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in data:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if f == 4 else role or " ", text or " "
        want += [] if f == 0 else [(c, t, role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)] * (2 if f == 3 else 1)
    assert got == sorted(want, key=str)


def test_op11_odd_rows(spark):
    """Null ids, turns, roles and texts; long texts; repeated rows; conversations without rows; other columns; no rows."""
    long = "word " * 400_000 + "."
    data = [(None, None, None, None, "x"), (None, 1, "user", long, "x"), (None, 2, "assistant", long, "x"), (7, 1, "user", "a.", "x"), (7, 1, "user", "a.", "x"), (7, 1, "user", "b.", "x")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, seq string")
    ids = spark.createDataFrame([(9,), (7,), (None,)], "conv_id long")
    got = {r["conv_id"]: r for r in repair.repair_conversations(rows, ids).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[None]["audit"], got[None]["blank"], got[None]["repaired_sha256"]) == ("DKK", 1, sha(f"user:{long}\nassistant:{long}"))
    assert (got[7]["audit"], got[7]["duplicate"], got[7]["cost"], got[7]["repaired_sha256"]) == ("KDR", 1, 3, sha("user:a.\nassistant:b."))
    assert tuple(got[9])[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) and len(got) == 3
    assert repair.repair_conversations(rows.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [300, 5000])
def test_op11_one_large_conversation(spark, rows):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(rows)] + [(c, 0, "user", "hello.") for c in range(2, 9)]
    got = {r["conv_id"]: r for r in repair.repair_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["audit"] == "K" * rows and got[1]["cost"] == 0 and got[2]["audit"] == "D"
