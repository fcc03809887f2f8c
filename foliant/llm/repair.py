"""Conversation structure repair: the cheapest edits that make turns alternate, by min-plus powers over runs of equal symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import ship

#: Costs of the edits, and what a truncated turn that is not deleted adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Runs between two kept states of the way back, and conversations' symbols that a task remembers the answers to.
STRIDE, REMEMBERED = 4096, 65_536

# What has been said: 0 nothing, 1 a system turn, 2 a user's turn, 3 an answer. It may end at 0 or 3; users' and assistants' turns lead on so.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FORCED = (2, 2, 3, 2)
_ENDS, _FAR = (0, 3), 1 << 60
Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _reach(moves: dict[tuple[int, int], int]) -> Matrix:
    return tuple(tuple(min(_FAR, moves.get((i, j), _FAR)) for j in range(4)) for i in range(4))


#: Costs of any number of insertions; one is forced in kind by what has been said, and three lead back to where one could be.
_ONE = _reach({(q, q): 0 for q in range(4)} | {(q, _FORCED[q]): INSERT for q in range(4)})
_INSERTED = _times(_ONE, _times(_ONE, _ONE))


def _edits(symbol: str) -> list[tuple[str, dict[int, int], int]]:
    """(letter, states by state, cost) of the edits of one row. Symbols: role initials s, u, a, or o for any other; capitals if truncated; x for what must go."""
    out = [("D", {q: q for q in range(4)}, DELETE)]
    if symbol != "x":
        more, role = TRUNCATED * symbol.isupper(), symbol.lower()
        out.append(("K", {q: n for (q, r), n in _NEXT.items() if r == role}, KEEP + more))
        out.append(("R", dict(enumerate(_FORCED)), REROLE + more))
    return out


@lru_cache(maxsize=None)
def _power(symbol: str, bit: int) -> Matrix:
    """The min-plus transition of 2^bit rows of one symbol, insertions before each row included; there are nine symbols and a few dozen powers."""
    if bit:
        half = _power(symbol, bit - 1)
        return _times(half, half)
    moves: dict[tuple[int, int], int] = {}
    for _, steps, cost in _edits(symbol):
        for q, n in steps.items():
            moves[q, n] = min(cost, moves.get((q, n), _FAR))
    return _times(_INSERTED, _reach(moves))


def _back(symbol: str, times: int, to_go: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go, by state, before a run, from those after it."""
    bit = 0
    while times >> bit:
        if times >> bit & 1:
            m = _power(symbol, bit)
            to_go = tuple(min(m[q][n] + to_go[n] for n in range(4)) for q in range(4))
        bit += 1
    return to_go


def _end() -> tuple[int, ...]:
    return tuple(min(_INSERTED[q][n] for n in _ENDS) for q in range(4))


def _runs(symbols: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


def _unrolled(q: int, before: tuple[int, ...], after: tuple[int, ...], symbol: str) -> tuple[str, int]:
    """The ASCII-least letters of a cheapest way over one row, from state q, and the state reached."""
    letters = ""
    while True:
        for letter, steps, cost in (*_edits(symbol)[:1], ("I", {q: _FORCED[q]}, INSERT), *_edits(symbol)[1:]):
            if q in steps and letter == "I" and before[q] == cost + before[steps[q]]:
                break
            if q in steps and letter != "I" and before[q] == cost + after[steps[q]]:
                return letters + letter, steps[q]
        letters, q = letters + "I", _FORCED[q]


@lru_cache(maxsize=REMEMBERED)
def _short(symbols: str) -> tuple[int, str]:
    return _repaired(symbols)


def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a conversation, a symbol a row: the least cost of edits that leave roles as (s?(ua)+)?, and of the ways of that cost the ASCII-least letters.

    K keeps a row, R gives it the role that is due, D deletes it, I inserts the role that is due. From the end, each run of equal
    symbols is passed by the binary powers of its transition; costs to go are kept at every STRIDE-th run, and
    from there on the choices are unrolled forwards.
    """
    return _short(symbols) if len(symbols) <= 64 else _repaired(symbols)


def _repaired(symbols: str) -> tuple[int, str]:
    runs, to_go = _runs(symbols), _end()
    marks = {len(runs): to_go}
    for k in range(len(runs) - 1, -1, -1):
        to_go = _back(*runs[k], to_go)
        if k % STRIDE == 0:
            marks[k] = to_go
    cost, audit, q = to_go[0], [], 0
    for k in range(0, len(runs), STRIDE):
        stop = min(k + STRIDE, len(runs))
        ends = [marks[stop]]
        for symbol, times in reversed(runs[k:stop]):
            ends.append(_back(symbol, times, ends[-1]))
        for (symbol, times), after in zip(runs[k:stop], reversed(ends[:-1]), strict=True):
            q, said = _run_unrolled(q, symbol, times, after)
            audit += said
    # What is still due at the end.
    while q not in _ENDS:
        audit.append("I")
        q = _FORCED[q]
    return cost, "".join(audit)


def _run_unrolled(q: int, symbol: str, times: int, after: tuple[int, ...]) -> tuple[int, list[str]]:
    """Of a run: in halves, so that costs to go within it come by powers and are held for its depth alone."""
    if times == 1:
        letters, q = _unrolled(q, _back(symbol, 1, after), after, symbol)
        return q, [letters]
    half = times // 2
    q, first = _run_unrolled(q, symbol, times - half, _back(symbol, half, after))
    q, second = _run_unrolled(q, symbol, half, after)
    return q, first + second


FILLED = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it a user's. Nulls are read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _closed(text: Column) -> Column:
    """Whether the last filled character of a text is one of .!? (only the text's tail is looked at after its blanks are cut)."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with initial (of the role) and symbol (see repair). A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated."""
    by_turn = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("seq")) > 1
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    blank = ~F.col("text").rlike(FILLED)
    fault = F.when(blank, "blank").when(seen, "duplicate").when(~_closed(F.col("text")), "truncated")
    placed = rows.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy(*by_turn)))
    return placed.withColumn("fault", fault).select(
        "conv_id", "seq", "turn", initial.alias("initial"), "fault", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role).alias("symbol"))


_JUDGED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (conv_id, seq), a first one of seq 0 for the conversation itself: its figures. A byte is held for a row, as many as its audit has."""
    state: dict = {}

    def answer() -> tuple:
        symbols = state["symbols"].decode()
        cost, audit = repair(symbols) if symbols else (0, "")
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return (state["id"], gaps, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit)

    for b in batches:
        done, kind = [], b.schema.field(0).type
        for conv, seq, turn, initial, fault, symbol in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if seq == 0:
                if state:
                    done.append(answer())
                state = {"id": conv, "symbols": bytearray(), "low": None, "high": None, "turns": 0, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                continue
            if turn is not None and turn != state["high"]:
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"], state["turns"] = turn, state["turns"] + 1
            if fault:
                state[fault] += 1
            if state["symbols"] and state["last"] + initial not in ("su", "ua", "au"):
                state["illegal"] += 1
            state["last"] = initial
            state["symbols"] += symbol.encode()
        if done:
            yield _figures(done, kind)
    if state:
        yield _figures([answer()], kind)


def _figures(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", *[x.split()[0] for x in _JUDGED.split(", ")], "repaired_sha256"][: len(rows[0])]
    kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a conversation's figures, then its rows in order: the figures with the digest of the repaired turns, of which a batch is held at a time."""
    figures = audit = digest = said = None
    at = 0

    def say(role: str, text: str) -> None:
        nonlocal said
        digest.update((b"\n" if said is not None else b"") + role.encode() + b":" + text.encode())
        said = role[:1]

    due = lambda: "assistant" if said == "u" else "user"

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            say(due(), "")
            at += 1

    for b in batches:
        done, kind = [], b.schema.field(0).type
        for *given, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if given[-1] is not None:
                if digest is not None:
                    inserted()
                    done.append((*figures, digest.hexdigest()))
                figures, audit, digest, said, at = given, given[-1], hashlib.sha256(), None, 0
                continue
            inserted()
            letter, at = audit[at], at + 1
            if letter == "K":
                say(role, text)
            elif letter == "R":
                say(due(), text)
        if done:
            yield _figures(done, kind)
    if digest is not None:
        inserted()
        yield _figures([(*figures, digest.hexdigest())], kind)


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), those of one turn by role and text. The edits are the cheapest that leave role initials as
    (s?(ua)+)?: keep a row (0), give it the role that is due, user or assistant (1), delete it (2, a must for blank and
    duplicate rows), insert an empty turn (5); a truncated row that is not deleted adds 5. Of the cheapest ways the one of the
    ASCII-least initials is taken. gaps counts the turn numbers that lack between the least and the largest, illegal the neighbours whose role initials
    aren't su, ua or au; the digest is that of the repaired ``role:text``, newline-joined.

    A conversation has one order and one digest, so its rows go through one task each time, as a sorted stream of which a symbol a row
    is held, like in its audit, and never its texts. ``conversations`` (column conv_id) names conversations that may have no rows
    left; they get zeros, an empty audit and the digest of the empty string. Null ids are one conversation. Null
    roles and texts count as one space; repeated rows are duplicates; other columns are ignored; no rows give no rows.
    """
    ship(rows.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    named = (plain if conversations is None else plain.select("conv_id").unionByName(conversations.select(F.col(conv_col).alias("conv_id")))).select("conv_id").distinct()
    kind = dict(plain.dtypes)["conv_id"]
    none = F.lit(None).cast("string")
    heads = named.select("conv_id", F.lit(0).alias("seq"), F.lit(None).cast("long").alias("turn"), none.alias("initial"), none.alias("fault"), none.alias("symbol"))
    # Dealt out by a hash of the id: where both sides of a union are partitioned by the id itself Spark leaves a repartition by it out, and may then coalesce the sides unlike.
    by_id = F.xxhash64("conv_id")
    judged = marked(plain).unionByName(heads).repartition(by_id).sortWithinPartitions("conv_id", "seq").mapInArrow(_judge, f"conv_id {kind}, {_JUDGED}")
    figures = [x.split() for x in _JUDGED.split(", ")]
    told = judged.select("conv_id", *[n for n, _ in figures], none.alias("role"), none.alias("text"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"))
    turns = plain.select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in figures], "role", "text", F.lit(1).alias("part"), "turn")
    ordered = told.unionByName(turns).repartition(by_id).sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "text").drop("part", "turn")
    return ordered.mapInArrow(_apply, f"conv_id {kind}, {_JUDGED}, repaired_sha256 string")
