"""Scorers as column expressions, and the scoring job."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import ship

Scorer = Callable[[Column, Column], Column]


def _as_score(same: Column) -> Column:
    return F.when(same, 1.0).otherwise(0.0)


def numeric_075(answer: Column, gold: Column) -> Column:
    off = F.abs(T.first_integer(gold) - T.first_integer(answer)).cast("double")
    return F.coalesce(F.pow(F.lit(0.75), off), F.lit(0.0))


def csv_overlap_ci(answer: Column, gold: Column) -> Column:
    wanted = F.array_distinct(T.csv_parts(gold))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, T.csv_parts(answer))) / F.size(wanted))


def multiple_choice(answer: Column, gold: Column) -> Column:
    letter = F.regexp_extract(answer, r"\b([ABCD])\b", 1)
    return _as_score((letter != "") & (letter == F.upper(T.trim_answer(gold))))


#: Scorer name -> expression of (answer, gold); numbers from 0 to 1.
SCORERS: dict[str, Scorer] = {
    "exact": lambda a, g: _as_score(T.trim_answer(a) == T.trim_answer(g)),
    "exact_ci": lambda a, g: _as_score(F.lower(T.trim_answer(a)) == F.lower(T.trim_answer(g))),
    "substring_ci": lambda a, g: _as_score(F.contains(F.lower(a), F.lower(T.trim_answer(g)))),
    "multiple_choice": multiple_choice,
    "csv_set_ci": lambda a, g: _as_score(F.array_sort(T.csv_parts(a)) == F.array_sort(T.csv_parts(g))),
    "numeric_075": numeric_075,
    "csv_overlap_ci": csv_overlap_ci,
    "oolong_text_ci": lambda a, g: _as_score(F.lower(T.short_answer(a)) == F.lower(T.short_answer(g))),
    "oolong_comparison_ci": lambda a, g: _as_score(T.comparison(a) == T.comparison(g)),
    "date_ci": lambda a, g: _as_score(T.canonical_date(a) == T.canonical_date(g)),
    "month_year_ci": lambda a, g: _as_score(T.canonical_month_year(a) == T.canonical_month_year(g)),
}


def score(scorer: Column, answer: Column, gold: Column, aliases: Column | None = None) -> Column:
    """The best score of an answer over gold and its aliases; a null answer scores 0."""
    golds = F.array(gold) if aliases is None else F.concat(F.array(gold), F.coalesce(aliases, F.array().cast("array<string>")))
    each = F.lit(None).cast("double")
    for name, f in SCORERS.items():
        each = F.when(scorer == name, F.array_max(F.transform(golds, _against(f, answer)))).otherwise(each)
    return F.when(answer.isNull(), 0.0).otherwise(F.coalesce(each, F.lit(0.0)))


def _against(f: Scorer, answer: Column) -> Callable[[Column], Column]:
    return lambda g: f(answer, g)


def score_runs(runs: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Adds score and correct (score 1) to runs with scorer, gold_answer and optionally gold_answer_aliases."""
    aliases = F.col("gold_answer_aliases") if "gold_answer_aliases" in runs.columns else None
    scored = runs.withColumn("score", score(F.col("scorer"), F.col(answer_col), F.col("gold_answer"), aliases))
    return scored.withColumn("correct", F.col("score") >= 1.0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def relaxed(answer: Column, gold: Column) -> Column:
    """A lenient score: choice letters A-H, synonyms of unknown, articles ignored, containment from three characters on."""
    clean = lambda c: F.regexp_replace(F.lower(T.short_answer(c)), r"[.!]+$", "")
    none = r"^(?:unknown|none|n/?a|no record|no records|not (?:found|mentioned|available|specified)|no (?:answer|information))\b"
    bare = lambda c: T.strip(F.regexp_replace(c, r"^(?:the|an|a)\s+", ""))

    def alike(x: Column) -> Column:
        a, g = x["a"], x["g"]
        within = (F.length(g) >= 3) & (F.contains(a, g) | ((F.length(a) >= 3) & F.contains(g, a)))
        return F.when(x["cg"].rlike(none), _as_score(x["ca"].rlike(none))).otherwise(_as_score((a == g) | within))

    pair = lambda x: F.struct(x["ca"].alias("ca"), x["cg"].alias("cg"), bare(x["ca"]).alias("a"), bare(x["cg"]).alias("g"))
    letter = F.regexp_extract(answer, r"\b([A-H])\b", 1)
    text = let(let(F.struct(clean(answer).alias("ca"), clean(gold).alias("cg")), pair), alike)
    return F.when(answer.isNull(), 0.0).when(gold.rlike(r"^\s*[A-Ha-h]\s*$"), _as_score(letter == F.upper(T.strip(gold)))).otherwise(text)


_RARE = tuple("the and for that this with from are was were has have not but its can will".split())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for k, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def overlap_scores(reference: str, candidate: str) -> tuple[float, float, float]:
    """(ROUGE-1 F, ROUGE-L F, BLEU-4).

    ROUGE tokens are runs of ASCII letters and digits in lower case; BLEU takes words of any script, counts
    candidate n-grams that the reference has at all, with a floor of 1e-10 and a brevity penalty, and is 0 under four words.
    """
    x, y = (re.findall(r"[a-z0-9]+", s.lower()) for s in (reference, candidate))
    shared = sum((Counter(x) & Counter(y)).values())
    total = len(x) + len(y)
    one, longest = (2.0 * shared / total, 2.0 * common_length(x, y) / total) if x and y else (0.0, 0.0)
    r, c = (re.findall(r"\w+", s.lower()) for s in (reference, candidate))
    if len(r) < 4 or len(c) < 4:
        return one, longest, 0.0
    logs = 0.0
    for n in range(1, 5):
        theirs, mine = set(zip(*(r[k:] for k in range(n)), strict=False)), list(zip(*(c[k:] for k in range(n)), strict=False))
        logs += math.log(max(sum(g in theirs for g in mine) / len(mine), 1e-10)) / 4
    return one, longest, (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs)


def keyword_recall(reference: Column, candidate: Column) -> Column:
    """Share of the reference's words of three letters or more that the candidate has too."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z_]{3,}"), F.lit(0)), lambda t: ~t.isin(*_RARE)))
    r = words(reference)
    return F.when(F.size(r) == 0, 0.0).otherwise(F.size(F.array_intersect(r, words(candidate))) / F.size(r))


def semantic_scores(pairs: DataFrame, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """Adds rouge1, rouge_l, bleu, keywords and combined, their mean. Null texts count as empty."""
    ship(pairs.sparkSession)
    r, c = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(candidate), F.lit(""))

    @F.pandas_udf("rouge1 double, rouge_l double, bleu double")
    def overlaps(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([overlap_scores(x, y) for x, y in zip(a, b, strict=True)], columns=["rouge1", "rouge_l", "bleu"], dtype=float)

    scored = pairs.withColumn("__s", overlaps(r, c)).select(*pairs.columns, "__s.*").withColumn("keywords", keyword_recall(r, c))
    return scored.withColumn("combined", (F.col("rouge1") + F.col("rouge_l") + F.col("bleu") + F.col("keywords")) / 4)
