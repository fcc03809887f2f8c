"""Chunking, paging, windows, planting and padding: one context, many rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.order import prefix_sums
from foliant.session import ship

OVERFLOW = 1.2


def _flat_map(rows: DataFrame, each: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """(id, text) rows into (id, *fields) rows: ``each`` turns one text into tuples. No shuffle."""
    ship(rows.sparkSession)
    id_type = rows.dtypes[0][1]
    schema = f"context_id {id_type}, {fields}"
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[x.strip().split()[1]] for x in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                made = list(each(t or ""))
                ids += [i.as_py()] * len(made)
                out += made
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def _paragraphs(text: str) -> Iterator[str]:
    at, found = 0, False
    for m in re.finditer(r"\n\s*\n", text):
        if text[at : m.end()].strip():
            found = True
            yield text[at : m.end()]
        at = m.end()
    if text[at:].strip() or not found:
        yield text[at:]


def chunks_of(text: str, chunk_tokens: int) -> Iterator[tuple[int, str]]:
    """Whole paragraphs packed up to four characters a token; one that is over 1.2 times as long is sliced."""
    target, held, out = 4 * chunk_tokens, "", []
    for unit in _paragraphs(text):
        if len(unit) > int(target * OVERFLOW):
            out += [held, *(unit[k : k + target] for k in range(0, len(unit), target))]
            held = ""
        elif held and len(held) + len(unit) > target:
            out.append(held)
            held = unit
        else:
            held += unit
    yield from enumerate(x for x in (*out, held) if x)


def chunk_contexts(contexts: DataFrame, chunk_tokens: int, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, chunk_index, text): paragraph-packing chunks."""
    if chunk_tokens <= 0:
        raise ValueError("chunk_tokens must be positive")
    return _flat_map(contexts.select(F.col(id_col), F.col(text_col)), lambda t: chunks_of(t, chunk_tokens), "chunk_index int, text string")


def pages_of(text: str, page_tokens: int, overlap_tokens: int) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(page_id, char_start, char_end, line_start, line_end, text): overlapping pages that end at a boundary just after their length, if there is one."""
    size, overlap, n, start, number, line = max(1, 4 * page_tokens), max(0, 4 * overlap_tokens), len(text), 0, 0, 1
    counted = 0
    while start < n or number == 0:
        target = min(n, start + size)
        end = target
        if target < n:
            ahead = text[target : min(n, start + int(size * 1.15))]
            for mark in ("\n\n", "\n", ". ", "? ", "! "):
                if (k := ahead.find(mark)) >= 0:
                    end = target + k + len(mark)
                    break
            else:
                back = text.rfind("\n", max(start, target - 300), target)
                if back >= 0 and target - back < 180:
                    end = max(start + 1, back + 1)
        number += 1
        line += text.count("\n", counted, start)
        counted = start
        body = text[start:end]
        yield number, start, end, line, line + body.count("\n"), body
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def page_contexts(contexts: DataFrame, page_tokens: int, overlap_tokens: int = 0, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, page_id, char_start, char_end, line_start, line_end, text, tokens_est, chars, preview)."""
    rows = _flat_map(contexts.select(F.col(id_col), F.col(text_col)), lambda t: pages_of(t, page_tokens, overlap_tokens), "page_id int, char_start int, char_end int, line_start int, line_end int, text string")
    return rows.withColumns({"tokens_est": T.tokens_est(F.col("text")), "chars": F.length("text"), "preview": T.preview(F.col("text"), 180)})


def unit_array(text: Column, longest: int = 1200) -> Column:
    """A text's sentences and lines in order, longer ones in slices of ``longest``; an empty one if there are none."""
    text = F.coalesce(text, F.lit(""))
    parts = F.filter(F.transform(F.split(text, T.SENTENCE), lambda s: T.strip(s)), lambda s: s != "")
    sliced = F.transform(parts, lambda s: F.when(F.length(s) <= longest, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / longest).cast("int")), lambda k: T.strip(F.substring(s, k * longest + 1, F.lit(longest))))))
    units = F.filter(F.flatten(sliced), lambda s: s != "")
    # Named within a lambda, so that they are made once and not for their size too.
    return F.get(F.transform(F.array(units), lambda u: F.when(F.size(u) == 0, F.array(T.strip(text))).otherwise(u)), F.lit(0))


def sentence_units(contexts: DataFrame, id_col: str = "context_id", text_col: str = "text", longest: int = 1200) -> DataFrame:
    """(context_id, idx, text): sentences and lines, longer ones in slices of ``longest``; idx from 1."""
    return contexts.select(F.col(id_col).alias("context_id"), F.posexplode_outer(unit_array(F.col(text_col), longest)).alias("k", "text")).select("context_id", (F.col("k") + 1).alias("idx"), "text")


def window_chunks(contexts: DataFrame, chars: int = 12_000, overlap: int = 600, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, start, text): fixed windows with overlap."""
    n = F.length(F.coalesce(text_col, F.lit("")))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max(1, chars - overlap)))
    return contexts.select(F.col(id_col).alias("context_id"), F.explode(starts).alias("start"), F.coalesce(text_col, F.lit("")).alias("__t")).select("context_id", "start", F.substring("__t", F.col("start") + 1, F.lit(chars)).alias("text"))


def episode_chunks(contexts: DataFrame, marker: str = r"\[START OF EPISODE\]", chars: int = 18_000, overlap: int = 1200, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, episode, text): parts that start with the marker; fixed windows where a text has none."""
    marked = contexts.where(F.col(text_col).rlike(marker))
    parts = marked.select(F.col(id_col).alias("context_id"), F.posexplode(F.filter(F.split(text_col, f"(?={marker})"), lambda p: T.strip(p) != "")).alias("episode", "text"))
    windows = window_chunks(contexts.where(~F.coalesce(F.col(text_col).rlike(marker), F.lit(False))), chars, overlap, id_col, text_col)
    return parts.unionByName(windows.select("context_id", (F.row_number().over(Window.partitionBy("context_id").orderBy("start")) - 1).alias("episode"), "text"))


def plant_passages(contexts: DataFrame, needles: DataFrame, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, text): needles (context_id, ord, position from 0 to 1, text) appended to the sentence at their position; several at one keep their order."""
    sentences = F.split(F.coalesce(text_col, F.lit("")), r"\. ", -1)
    grouped = needles.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ord", "position", F.col("text").alias("needle")))).alias("needles"))
    rows = contexts.select(F.col(id_col), sentences.alias("s")).join(grouped, id_col, "left")
    n = F.size("s")
    at = lambda x: F.greatest(F.lit(0), F.least(n - 1, F.floor(n * x["position"]).cast("int")))
    told = lambda k: F.filter(F.coalesce("needles", F.array().cast("array<struct<ord:int,position:double,needle:string>>")), lambda x: at(x) == k)
    planted = F.transform("s", lambda s, k: F.array_join(F.concat(F.array(s), F.transform(told(k), lambda x: x["needle"])), " "))
    return rows.select(id_col, F.array_join(planted, ". ").alias("text"))


def splice(short: str, carrier: str, budget: int) -> Column:
    """A short text between the head and the tail of a carrier, ``budget`` characters of it in all."""
    head = budget // 2
    return F.concat(F.substring(carrier, 1, head), F.lit("\n\n"), F.col(short), F.lit("\n\n"), F.right(F.col(carrier), F.lit(budget - head)))


def clean_carrier(text_col: str, terms: list[str], names: list[str], short: int = 240) -> Column:
    """Lines without blanks, those that start with a name, and those of ``short`` characters or fewer that hold a term."""
    starts, holds = r"^\s*(?:" + "|".join(names) + r")\b", r"(?i)\b(?:" + "|".join(terms) + r")\b"
    return F.array_join(F.filter(F.split(text_col, "\n"), lambda x: (T.strip(x) != "") & ~x.rlike(starts) & ~((F.length(x) <= short) & x.rlike(holds))), "\n")


def carrier_ranges(wanted: DataFrame, carriers: DataFrame, rounds: int = 3) -> DataFrame:
    """Adds first and last to tasks (idx, target_chars): the places on the ring of carriers (idx from 0 without gaps, len) that each takes.

    A task begins at its idx, modulo the number of carriers, and goes on around the ring, ``rounds`` times at most, until it has twice its
    target. With the lengths summed up along the ring the place where it has enough is the first whose sum reaches a goal, found by
    an as-of lookup: goals and sums meet in stretches of the ring and are merged there by size. Tasks of one
    start and target ask once. Nothing is made for carriers that a task passes or never comes to. Without characters it goes
    all the way around; without carriers last is before first.
    """
    total = carriers.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars")).first()
    m, chars = total["m"], total["chars"]
    asked = wanted.withColumns({"first": F.pmod("idx", F.lit(max(1, m))).cast("long"), "goal": F.greatest(F.lit(1), 2 * F.col("target_chars")).cast("long")})
    if not chars:
        return asked.withColumn("last", F.col("first") + rounds * m - 1).drop("goal")
    ring = prefix_sums(carriers.select(F.col("idx").cast("long").alias("place"), "len"), ["place"], {"before": "len"})
    sum_due = F.col("before") + F.col("goal")
    goals = asked.select("first", "goal").distinct().join(ring.select(F.col("place").alias("first"), "before"), "first").select("first", "goal", F.floor((sum_due - 1) / F.lit(chars)).alias("turns"), (F.pmod(sum_due - 1, F.lit(chars)) + 1).alias("at"))
    stretch = math.ceil(chars / m)
    lot = lambda c: F.floor((c - 1) / F.lit(stretch))
    sums = ring.where("len > 0").select((F.col("before") + F.col("len")).alias("at"), "place", F.explode(F.sequence(lot(F.col("before") + 1), lot(F.col("before") + F.col("len")))).alias("lot"))
    none = F.lit(None).cast("long")
    both = sums.select("lot", "at", "place", none.alias("first"), none.alias("goal"), none.alias("turns")).unionByName(goals.select(lot(F.col("at")).alias("lot"), "at", none.alias("place"), "first", "goal", "turns"))
    reached = F.last("place", ignorenulls=True).over(Window.partitionBy("lot").orderBy(F.desc("at"), F.asc_nulls_last("place")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("reached", reached).where("first is not null").select("first", "goal", F.least(F.col("turns") * m + F.col("reached"), F.col("first") + rounds * m - 1).alias("last"))
    return asked.join(found, ["first", "goal"]).drop("goal")


def assemble_carriers(tasks: DataFrame, carriers: DataFrame, target_chars: int | str, rounds: int = 3) -> DataFrame:
    """Adds carrier to tasks (idx): carriers (idx from 0 without gaps, text) from the task's idx on around the ring of them, ``rounds`` times at most, until twice the target is had, joined by blank lines.

    ``target_chars`` is a number or a column of tasks. Empty and null carriers are passed over. Null where what there
    is falls short of the target, or without carriers. Rows are made for what tasks take, no more. Tasks that share
    an idx and a target get the same carrier; no tasks give no rows.
    """
    m = carriers.count()
    if not m:
        return tasks.withColumn("carrier", F.lit(None).cast("string"))
    target = (F.lit(target_chars) if isinstance(target_chars, int) else F.col(target_chars)).cast("long")
    wanted = tasks.select("idx", target.alias("target_chars")).distinct()
    taken = carrier_ranges(wanted, carriers.select("idx", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len")), rounds)
    places = taken.select("idx", "target_chars", F.explode(F.sequence("first", "last")).alias("at")).withColumn("place", F.pmod("at", F.lit(m)))
    texts = carriers.where(F.length("text") > 0).select(F.col("idx").cast("long").alias("place"), "text")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("carrier")
    built = places.join(texts, "place").groupBy(F.col("idx").alias("__idx"), F.col("target_chars").alias("__target")).agg(whole).where(F.length("carrier") >= F.col("__target"))
    return tasks.join(built, (F.col("idx") == F.col("__idx")) & (target == F.col("__target")), "left").drop("__idx", "__target")


FILLER = ("The river was quiet that day.", "Someone closed the window softly.", "A list of supplies lay on the desk.", "Nothing else happened before noon.")


def pad_contexts(contexts: DataFrame, target_tokens: int, id_col: str = "context_id", text_col: str = "text", filler: tuple[str, ...] = FILLER) -> DataFrame:
    """Texts padded to ``target_tokens`` with filler sentences chosen by a hash of the id and the place."""
    short = F.greatest(F.lit(0), 4 * F.lit(target_tokens) - F.length(text_col))
    count = F.ceil(short / F.lit(min(map(len, filler)))).cast("int")
    words = F.array(*[F.lit(x) for x in filler])
    picks = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col(id_col), k), F.lit(len(filler))) + 1).cast("int"))))
    tail = F.substring(F.array_join(F.coalesce(picks, F.array().cast("array<string>")), " "), F.lit(1), short.cast("int"))
    return contexts.withColumn(text_col, F.concat(F.col(text_col), tail))
