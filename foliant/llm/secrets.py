"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import ship

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: A value in a credential context: after a name of one (other parts may be joined to it by _ or -), a colon, an equals sign or "is"; up to a blank or its quote.
CONTEXT = re.compile(r"""(?i:(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)(?:[_-][A-Za-z0-9]++)*+(?![A-Za-z0-9_]))["']?(?:\x20*[:=]\x20*|\x20(?i:is)\x20)(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>(){}]{6,}))""", re.ASCII)
#: Decimal digits of guesses from which a value counts as a secret.
LOG10_GUESSES = 8.0
#: Letters of a dictionary's longest word.
LONGEST = 20

# Common words and passwords by rank, date shapes, rows of keys.
WORDS = (
    "password 123456 qwerty letmein admin welcome login master dragon monkey shadow sunshine princess football baseball iloveyou abc123 "
    "secret token changeme default guest root test user pass access system server database example sample demo hello world love summer "
    "winter spring autumn monday friday january march april june july august october december red blue green black white orange purple "
    "the and for that this with you not are from your have was will can all one new more home time about page other none null true false "
    "string value here enter your-password placeholder xxxx todo unknown empty key api name data file temp local office company cloud"
).split()
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("4310$5@7!", "aeiossati")
_NEXT = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(a, b) for up, low in zip(KEY_ROWS[:3], KEY_ROWS[1:4], strict=True) for k, b in enumerate(low) for a in up[k + 1 : k + 3] if k + 1 < len(up)}


@dataclass(frozen=True)
class Dictionary:
    """Words by the rank at which a guesser tries them: the best rank that any list gives."""

    rank: dict[str, int]

    @classmethod
    def of(cls, *lists: Iterable[str]) -> Dictionary:
        rank: dict[str, int] = {}
        for words in (WORDS, *lists):
            for k, word in enumerate(words):
                if 2 <= len(word) <= LONGEST and rank.get(word, k + 2) > k + 1:
                    rank[word] = k + 1
        return cls(rank)


COMMON = Dictionary.of()


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a public tokenizer's vocabulary (a file with word ends), in the order of their ids, which is about that of their frequency."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>") and w[:-4].isalpha() and w[:-4].isascii()]


def _alphabet(value: str) -> int:
    return max(2, 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value))


def _segments(value: str, words: Dictionary) -> list[list[tuple[int, float]]]:
    """By end: (start, log10 of guesses) of what is known about parts of a value."""
    n, low = len(value), value.lower()
    brute, plain = math.log10(_alphabet(value)), low.translate(_LEET)
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for s in range(n):
        for e in range(s + 2, min(n, s + LONGEST) + 1):
            for text, more in ((low[s:e], 0.0), (plain[s:e], 0.6)):
                if text in words.rank:
                    by_end[e].append((s, math.log10(words.rank[text] + 1) + more + (0.0 if value[s:e] == low[s:e] else 0.4)))
                    break
        if low[s].isdigit():
            m = DATE.match(low, s)
            if m:
                by_end[m.end()].append((s, math.log10(365 * 120 if m.end() - s > 4 else 120)))
    s = 0
    while s < n - 2:
        e = s + 1
        while e < n and (low[e - 1], low[e]) in _NEXT:
            e += 1
        for stop in range(s + 3, e + 1):
            by_end[stop].append((s, math.log10(len(KEY_ROWS) * 13 * 2 * (stop - s))))
        s = max(e - 1, s + 1)
    for unit in range(1, min(8, n // 2) + 1):
        s = 0
        while s + 2 * unit <= n:
            e = s + unit
            while e < n and low[e] == low[e - unit]:
                e += 1
            times = (e - s) // unit
            if times * unit >= max(3, 2 * unit):
                by_end[s + times * unit].append((s, unit * brute + math.log10(times)))
            s = max(s + 1, e - unit + 1)
    return by_end


def guess_cost(value: str, words: Dictionary = COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    Segments: a known word (its rank; more if capitals or look-alike digits vary it), a date,
    a unit of up to 8 characters repeated, a walk over neighbouring keys or letters, or a brute-force span over the
    value's own alphabet. Repeats are taken as long as they go, walks from where they start. Every segment after the
    first costs a digit more, for its place. The minimum is found from left to right over the whole value.
    """
    n, brute, by_end = len(value), math.log10(_alphabet(value)), _segments(value, words)
    best, spanned = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for e in range(1, n + 1):
        spanned[e] = min(spanned[e - 1], best[e - 1] + (e > 1)) + brute
        best[e] = min(spanned[e], *(best[s] + c + (s > 0) for s, c in by_end[e])) if by_end[e] else spanned[e]
    return best[n]


def secret_spans(text: str | None, log10_guesses: float = LOG10_GUESSES, words: Dictionary = COMMON) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS.

    assign, access and hex are the fixed patterns, leftmost and non-overlapping per kind; guess is
    the value in a credential context whose guess cost is ``log10_guesses`` digits or more.
    """
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    at = 0
    while m := CONTEXT.search(text, at):
        group = m.lastindex
        secret = guess_cost(m[group], words) >= log10_guesses
        if secret:
            out.append(("guess", *m.span(group)))
        at = m.end() if secret else m.start(group)  # a weak value may be the next context's name
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(log10_guesses: float, words: Dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t.as_py(), log10_guesses, words)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log10_guesses: float = LOG10_GUESSES, words: Dictionary | None = None) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) of every whole text; offsets in code points, end exclusive.

    Guess costs use ``words`` or, if none are given, common passwords alone. The words come from fixed lists and never
    from the texts, which hold the secrets themselves: whether a text holds one depends on that text and on nothing
    else. Nothing is shuffled: each text is scanned where it is read, and the dictionary goes with the task. Null counts as empty; null ids and
    repeated rows are answered like any row; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    words = words or COMMON
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(log10_guesses, words), f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")
