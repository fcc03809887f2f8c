"""Column expressions over texts: tokens, terms, trimming, answers, dates, JSON tails, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, sentence, value, entity, update and count patterns; stop words.
TOKEN = r"[A-Za-z][A-Za-z0-9_'-]*|\d+(?:\.\d+)?"
LOWER_TOKEN = r"[a-z][a-z0-9_'-]*|\d+(?:\.\d+)?"
SENTENCE = r"(?<=[.!?])\s+|\n+"
VALUE_SIGN = "[-0-9@/_]"  # one of these is in every VALUE
VALUE = r"(\b\d+(?:\.\d+)?\b|\b[A-Z]{2,}[-_A-Z0-9]*\d[-_A-Z0-9]*\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|/[A-Za-z0-9._/:-]+|\b[A-Za-z]+[-_][A-Za-z0-9_-]+\b)"
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
CAPITALISED = r"\b[A-Z][A-Za-z'’]*(?:\s+[A-Z][A-Za-z'’]*){0,3}\b"
UPDATE = r"(?i)\b(changed?|updated?|replaced?|renamed?|correct(?:ed|ion)?|latest|current|now|instead|no longer|should use|must use|final|confirmed|overrides?)\b"
COUNTING = r"(?i)\b(count|total|sum|number of|how many|cumulative|cummulative|percentage|percent)\b"
STOP_UNITS = tuple(
    "a an and are as at be been but by for from had has have he her his i in is it its of on or she that the their there they this to was were with you "
    "what which who where when why how".split()
)
STOP_QUESTION = tuple("a an and are as at did do does for from how i in is it of on or the to was were what when where which who why with".split())
STOP_MEMORY = tuple("answer current days does from have last memory night what when where which user usually".split())


def tokens_est(text: Column) -> Column:
    """Estimated tokens: a quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case tokens: words from a letter on, and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(LOWER_TOKEN), F.lit(0))


def without(words: Column, stop: Sequence[str]) -> Column:
    """Words that aren't stop words, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def flags(text: Column) -> dict[str, Column]:
    """has_value, n_entities (not counting those that start with a stop word), has_update, has_count."""
    entities = F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: ~F.lower(F.regexp_extract(e, r"^\S+", 0)).isin(*STOP_UNITS))
    return {"has_value": text.rlike(VALUE_SIGN) & text.rlike(VALUE), "n_entities": F.size(entities), "has_update": text.rlike(UPDATE), "has_count": text.rlike(COUNTING)}


def capitalised_terms(text: Column, stop: Sequence[str] = STOP_QUESTION) -> Column:
    """Runs of one to four capitalised words, first seen first."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), lambda t: ~F.lower(t).isin(*stop)))


def focus_entities(question: Column) -> Column:
    """Capitalised single words in lower case, first seen first, without stop words."""
    found = F.transform(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_QUESTION)))


def morph_variants(terms: Column) -> Column:
    """Terms with light variants: s added or dropped, ed and ing added; first seen first."""
    def variants(t: Column) -> Column:
        plural = F.when(t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit("s")))
        more = F.array(t, plural, F.when(~t.endswith("ed"), F.concat(t, F.lit("ed"))), F.when(~t.endswith("ing"), F.concat(t, F.lit("ing"))))
        return F.when(F.length(t) < 3, F.array(t)).otherwise(more)

    return F.array_distinct(F.filter(F.flatten(F.transform(terms, variants)), lambda t: t.isNotNull() & (t != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def strip(text: Column, chars: str = r"\s") -> Column:
    """Without leading and trailing characters of a class (white space unless given)."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def trim_answer(text: Column) -> Column:
    """Without surrounding white space, then double quotes, then single ones, then white space."""
    return strip(strip(strip(strip(text), '"'), "'"))


def short_answer(text: Column) -> Column:
    """A short answer bare: no asterisks, no \\boxed{}, no label prefix, no brackets."""
    s = F.regexp_replace(trim_answer(text), r"\*", "")
    s = F.regexp_replace(s, r"\\boxed\{(?:\\text\{)?([^}]*)\}?\}", "$1")
    prefix = F.lower(strip(F.substring_index(s, ":", 1)))
    labelled = F.contains(s, F.lit(":")) & prefix.isin("label", "answer", "user", "date")
    s = F.when(labelled, strip(F.substring(s, F.locate(":", s) + 1, F.length(s)))).otherwise(s)
    return trim_answer(strip(strip(s), r"\[\]"))


def csv_parts(text: Column) -> Column:
    """Parts between commas, bare and in lower case, in input order; blank ones dropped."""
    return F.transform(F.filter(F.split(trim_answer(text), ","), lambda p: strip(p) != ""), lambda p: F.lower(short_answer(p)))


def first_integer(text: Column) -> Column:
    """The first whole number of an answer, as a decimal; null if there is none."""
    return F.regexp_extract(short_answer(text), r"-?\d+", 0).try_cast("decimal(38,0)")


def canonical_date(text: Column) -> Column:
    """yyyy-MM-dd from ISO text, datetime.date(y, m, d) or one of eight written forms; null if none fits."""
    s = short_answer(text)
    iso = F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1)
    call = r"datetime\.date\((\d{4}),\s*(\d{1,2}),\s*(\d{1,2})\)"
    called = F.concat_ws("-", F.regexp_extract(s, call, 1), F.lpad(F.regexp_extract(s, call, 2), 2, "0"), F.lpad(F.regexp_extract(s, call, 3), 2, "0"))
    clean = F.initcap(F.regexp_replace(s, r"(?i)(\d)(st|nd|rd|th)", "$1"))
    forms = ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d")
    written = F.coalesce(*[F.date_format(F.try_to_timestamp(clean, F.lit(f)), "yyyy-MM-dd") for f in forms])
    return F.when(iso != "", iso).when(s.rlike(call), called).otherwise(written)


def canonical_month_year(text: Column) -> Column:
    """'October 2022' from a month's name or its short form before a year; null if there is none."""
    form = r"([A-Za-z]+)\s+(\d{4})"
    s = short_answer(text)
    found = F.initcap(F.concat_ws(" ", F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2)))
    return F.coalesce(*[F.date_format(F.try_to_timestamp(found, F.lit(f)), "MMMM yyyy") for f in ("MMMM yyyy", "MMM yyyy")])


def comparison(text: Column) -> Column:
    """'same frequency', 'more common' or 'less common' if the answer has one of them, in this order; else the answer."""
    s = F.lower(short_answer(text))
    return F.when(F.contains(s, F.lit("same frequency")), "same frequency").when(F.contains(s, F.lit("more common")), "more common").when(F.contains(s, F.lit("less common")), "less common").otherwise(s)


def preview(text: Column, limit: int, rstrip: bool = True) -> Column:
    """One line of ``limit`` characters at most, the last an ellipsis if cut."""
    line = strip(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(line, 1, limit - 1)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(head, r"\s+$", "") if rstrip else head, F.lit("…")))


def sanitise(text: Column, style: str = "underscore", limit: int = 80) -> Column:
    """Ids: each odd character an underscore, cut at ``limit``; or runs of them a dash, none at the ends."""
    if style == "underscore":
        return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9]", "_"), 1, limit)
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._:-]+", "-"), r"^-+|-+$", "")


def answer_tail(raw: Column) -> Column:
    """The answer of the last flat JSON object in a text that has the one field answer; null if there is none."""
    objects = F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0))
    whole = F.filter(objects, lambda o: F.coalesce(F.array_join(F.json_object_keys(o), ",") == "answer", F.lit(False)))
    return F.get_json_object(F.element_at(F.when(F.size(whole) > 0, whole), -1), "$.answer")


def answer_with_fallback(raw: Column, limit: int = 4000) -> tuple[Column, Column]:
    """(answer, mode): of the JSON tail, else of the last line without fences and prefix; modes json, text_fallback, empty, failed."""
    fenced = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    lines = F.filter(F.split(fenced, "\n"), lambda x: strip(x) != "")
    last = F.regexp_replace(strip(F.element_at(F.when(F.size(lines) > 0, lines), -1)), r"(?i)^(?:final\s+)?answer\s*:\s*", "")
    tail = answer_tail(raw)
    mode = F.when(raw.isNull(), "failed").when(strip(raw) == "", "empty").when(tail.isNotNull(), "json").when(last.isNull() | (last == ""), "failed").otherwise("text_fallback")
    return F.substring(F.coalesce(tail, last), 1, limit), mode


def code_answer(raw: Column) -> Column:
    """The answer that finalising code sets: answer["content"] = "…" or submit_answer("…")."""
    forms = (r"""answer\[["']content["']\]\s*=\s*["']([^"']*)["']""", r"""submit_answer\(\s*["']([^"']*)["']\s*\)""")
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, f, 1), F.lit("")) for f in forms])


def json_objects(raw: Column) -> Column:
    """All flat JSON objects of a text that parse."""
    return F.filter(F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.json_object_keys(o).isNotNull())


def judge_verdict(raw: Column) -> Column:
    """true or false from the last JSON object's equivalent, else from the words themselves; null if neither."""
    tail = F.get_json_object(F.element_at(F.when(F.size(json_objects(raw)) > 0, json_objects(raw)), -1), "$.equivalent")
    return F.coalesce(tail.try_cast("boolean"), F.nullif(F.regexp_extract(F.lower(raw), r'"equivalent"\s*:\s*(true|false)', 1), F.lit("")).try_cast("boolean"))


def length_label(task_id: Column) -> Column:
    found = F.regexp_extract(task_id, r"-(\d+k|\d+m|\d+M|\d+ep)-", 1)
    return F.when(found == "", "unknown").otherwise(found)


def error_category(error: Column, parse_ok: Column) -> Column:
    """usage_limit before auth before timeout before runtime_error; parse_only without an error; none."""
    e = F.lower(error)
    return (
        F.when(error.isNull() | (error == ""), F.when(parse_ok, "none").otherwise("parse_only"))
        .when(e.rlike("usage limit|rate limit|quota"), "usage_limit").when(e.rlike("auth|401|403|login"), "auth").when(e.rlike("timeout|timed out"), "timeout").otherwise("runtime_error")
    )


def context_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def requested_age(question: Column) -> Column:
    """Days ago that a question asks for: 1 for last night and yesterday, else 'day N' or 'N days ago'; null if none."""
    q = F.lower(question)
    form = r"day\s*-?\s*(\d+)|\b(\d+)\s+days?\s+ago\b"
    n = F.coalesce(F.nullif(F.regexp_extract(q, form, 1), F.lit("")), F.nullif(F.regexp_extract(q, form, 2), F.lit("")))
    return F.when(q.rlike("last night|yesterday"), 1).otherwise(n.try_cast("int"))


def ranked_terms(question: Column, top: int = 12, stop: Sequence[str] = STOP_QUESTION) -> Column:
    """Query terms by length, +4 if capitalised and +3 with a digit; earlier first among equals."""
    raw = F.filter(F.regexp_extract_all(question, F.lit(TOKEN), F.lit(0)), lambda t: ~F.lower(t).isin(*stop))
    scored = F.transform(raw, lambda t, k: F.struct((-(F.length(t) + F.when(t.rlike("^[A-Z]"), 4).otherwise(0) + F.when(t.rlike(r"\d"), 3).otherwise(0))).alias("s"), k.alias("k"), F.lower(t).alias("t")))
    return F.slice(F.array_distinct(F.transform(F.array_sort(scored), lambda x: x["t"])), 1, top)


def substring_count(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences."""
    return F.when(F.length(part) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")
