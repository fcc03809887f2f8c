"""Chat formatting by schema fingerprints, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_BIG = {"maxStringLen": "2147483647"}
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping of one record layout.

    ``turns``: (list field, role field, text field) of a list of turns, with ``roles`` renaming
    roles; or ``fields``: (field, role) in order, each text field one turn, those in
    ``optional`` may be missing, and ``joined`` ones are added to the turn before after a blank line.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    joined: frozenset[str] = frozenset()
    roles: Mapping[str, str] | None = None

    def paths(self) -> list[list[str]]:
        """The nested field paths of each variant."""
        if self.turns:
            listed, role, text = self.turns
            return [[listed, f"{listed}[].{role}", f"{listed}[].{text}"]]
        names = [f for f, _ in self.fields]
        free = [f for f in names if f in self.optional]
        return [sorted(set(names) - set(gone)) for n in range(len(free) + 1) for gone in combinations(free, n)]


SHAREGPT = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}
LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", turns=("messages", "role", "content")),
    Layout("conversations", turns=("conversations", "from", "value"), roles=SHAREGPT),
    Layout("dialogue", turns=("turns", "speaker", "text"), roles=SHAREGPT),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=frozenset({"system", "input"}), joined=frozenset({"input"})),
    Layout("prompt_completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=frozenset({"system"})),
    Layout("prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=frozenset({"system"})),
    Layout("question_answer", fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), optional=frozenset({"context"})),
)


def _known(layouts: Sequence[Layout]) -> list[str]:
    return sorted({p for x in layouts for v in x.paths() for p in v})


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """A hash of a JSON record's nested field paths, of those that any layout knows: other fields don't matter, nor does order.

    The paths of a list are those of all its elements, so a field that its first turn lacks still counts.
    """
    listed = sorted({(x.turns[0], f) for x in layouts if x.turns for f in x.turns[1:]})
    keys = lambda json: F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    lists = F.from_json(record, ", ".join(f"`{f}` array<map<string,string>>" for f in sorted({f for f, _ in listed})), _BIG)
    has = lambda f, n: F.exists(lists[f], lambda t: F.coalesce(F.map_contains_key(t, n), F.lit(False)))
    inner = [F.when(has(f, n), F.array(F.lit(f"{f}[].{n}"))).otherwise(F.array().cast("array<string>")) for f, n in listed]
    found = F.array_intersect(F.concat(keys(record), *inner), F.array(*[F.lit(p) for p in _known(layouts)]))
    return F.xxhash64(F.array_join(F.array_sort(found), "\n"))


def _listed(record: Column, x: Layout) -> Column:
    """The turns of a layout with a list of them."""
    listed, role, text = x.turns
    names = F.create_map(*[F.lit(y) for kv in x.roles.items() for y in kv]) if x.roles else None
    named = lambda r: F.coalesce(F.element_at(names, F.lower(r)), r) if x.roles else r
    parsed = F.from_json(record, f"`{listed}` array<struct<`{role}`:string,`{text}`:string>>", _BIG)[listed]
    return F.transform(parsed, lambda t: F.struct(named(F.coalesce(t[role], F.lit(""))).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))


def _fielded(record: Column, x: Layout) -> Column:
    """The turns of a layout with a field for each."""
    parsed, there = F.from_json(record, ", ".join(f"`{f}` string" for f, _ in x.fields), _BIG), F.json_object_keys(record)
    made = []
    for k, (f, role) in enumerate(x.fields):
        if f in x.joined:
            continue
        text = F.coalesce(parsed[f], F.lit(""))
        if k + 1 < len(x.fields) and x.fields[k + 1][0] in x.joined:
            more = F.coalesce(parsed[x.fields[k + 1][0]], F.lit(""))
            text = F.concat(text, F.when(more == "", "").otherwise(F.concat(F.lit("\n\n"), more)))
        made.append(F.when(F.array_contains(there, f), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds layout and turns (array of role, text) to JSON records of mixed layouts.

    The fingerprint of a record's field paths selects the mapping. Null texts count as empty,
    null roles too; missing optional fields give no turn. A record that no mapping fits, is null or
    isn't JSON keeps its row, with null layout and turns. An empty list of turns has no
    element to show its fields and fits no mapping either. Columns named layout and turns are replaced,
    all others stay. No rows give no rows.
    """
    variants = [(x.name, F.xxhash64(F.lit("\n".join(sorted(v))))) for x in layouts for v in x.paths()]
    marked = records.withColumn("__print", fingerprint(F.col(record_col), layouts))
    layout = F.coalesce(*[F.when(F.col("__print") == h, F.lit(name)) for name, h in variants])
    out: list[Column] = []
    for x in layouts:
        turns = _listed(F.col(record_col), x) if x.turns else _fielded(F.col(record_col), x)
        out.append(F.when(F.col("layout") == x.name, turns.cast(_TURNS)))
    return marked.withColumn("layout", layout).drop("__print").withColumn("turns", F.coalesce(*out))


def _replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape(c: Column) -> Column:
    """No control string is left in the result; unescape gives the text back."""
    return _replaced(c, (("&", "&amp;"), ("<|", "&lt;|")))


def unescape(c: Column) -> Column:
    return _replaced(c, (("&lt;|", "<|"), ("&amp;", "&")))


def format_chat(turned: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds formatted and loss (array of start, length in code points) to rows with turns.

    Template: <|im_start|>role, a line end, the text, <|im_end|> and a line end for each turn. In texts
    and roles & and <| are escaped, in roles line ends too, so that no text can end its turn or open
    another. The loss mask covers exactly the (escaped) texts of ``loss_roles``. Null turns give
    nulls, no turns an empty text.
    """
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;"))
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    tail = END + "\n"
    spans = F.aggregate(
        "__pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return turned.withColumn("__pieces", pieces).withColumn("formatted", formatted).withColumn("loss", spans).drop("__pieces")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds turns_read (array of role, text) and loss_text, both unescaped and taken from formatted and loss alone.

    The text is split at its turn starts once; what is under the mask is cut from the turn where its span starts
    and lies, as format_chat's spans do, within it. Null formatted or loss give nulls, an empty text no
    turns. Columns named turns_read and loss_text are replaced, all others stay.
    """
    body = lambda p: F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - (len(END) + 1))
    turns = F.transform(F.slice("__parts", 2, F.size("__parts")), lambda p: F.struct(unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(body(p)).alias("text")))
    starts = F.aggregate("__parts", F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + len(START)))

    def under(p: Column, k: Column) -> Column:
        at = F.get("__starts", k)
        spans = F.filter("loss", lambda s: (s["start"] >= at) & (s["start"] < at + F.length(p)))
        return F.transform(spans, lambda s: unescape(F.substring(p, (s["start"] - at + 1).cast("int"), s["length"].cast("int"))))

    placed = formatted.withColumn("__parts", F.split(F.col("formatted"), r"<\|im_start\|>")).withColumn("__starts", starts)
    return placed.withColumn("turns_read", turns).withColumn("loss_text", F.array_join(F.flatten(F.transform("__parts", under)), "")).drop("__parts", "__starts")


def conversation_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mixed: bool = False) -> DataFrame:
    """(conv_id, record): rows by turn as JSON records of the messages layout or, if ``mixed``, of all layouts that can hold them.

    Mixed records are dealt by a hash of the id: conversations of the roles user, assistant and system over the three
    layouts with a list of turns, those that are a user's and an assistant's turn, after a system's or not, over
    the four with a field for each too; other roles keep to messages, as renaming them could not be undone. Null
    roles and texts count as empty; equal turns go by role, then text; null turns come last; rows with a null
    id are one conversation. No rows give no rows.
    """
    turn = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("at"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    as_list = lambda names, renamed: F.transform("t", lambda x: F.struct((F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in renamed.items() for y in kv]), x["role"]), x["role"]) if renamed else x["role"]).alias(names[0]), x["content"].alias(names[1])))
    messages = F.to_json(F.struct(as_list(("role", "content"), {}).alias("messages")))
    if not mixed:
        return grouped.select("conv_id", messages.alias("record"))
    out = [messages, F.to_json(F.struct(as_list(("from", "value"), {"user": "human", "assistant": "gpt"}).alias("conversations"))), F.to_json(F.struct(as_list(("speaker", "text"), {"user": "human", "assistant": "bot"}).alias("turns")))]
    said = lambda role: F.get(F.filter("t", lambda x: x["role"] == role), F.lit(0))["content"]
    for names in (("system", "instruction", "output"), ("system", "prompt", "completion"), ("system", "prompt", "response"), ("context", "question", "answer")):
        out.append(F.to_json(F.struct(*[said(role).alias(n) for role, n in zip(("system", "user", "assistant"), names, strict=True)])))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    dealt = F.when(roles.isin("user,assistant", "system,user,assistant"), F.pmod(F.xxhash64("conv_id"), F.lit(len(out)))).when(~F.exists("t", lambda x: ~x["role"].isin("user", "assistant", "system")), F.pmod(F.xxhash64("conv_id"), F.lit(3))).otherwise(0)
    record = F.coalesce(*[F.when(F.col("__dealt") == k, x) for k, x in enumerate(out)])
    return grouped.withColumn("__dealt", dealt).select("conv_id", record.alias("record"))
