"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ship

BASE = ("email", "ip", "card", "phone")
#: What the field adds: names after a title or the like, postal addresses, identity and account numbers, and ways to be reached that the patterns don't know.
ADDED = ("person", "address", "identity", "contact")
KINDS = BASE + ADDED
LABELS = ["O"] + [f"{b}-{k}" for k in ADDED for b in "BI"]
#: Rows of the labelled table that training takes at most, places of hashed features, cells of a decoded batch, characters of texts that are scored together.
LABELLED, PLACES, CELLS, LOT = 2000, 1 << 13, 1 << 18, 1 << 20

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words that may tell of personal data near them (fixed values).
CUES = frozenset(
    "name named mr mrs ms dr prof dear contact signed sincerely regards born patient resident address lives street road avenue lane drive ssn passport iban identity licence license account "
    "phone tel mobile call fax telephone herr frau heiße anschrift wohnhaft straße ausweis telefon anrufen geboren señor señora sr sra calle avenida nombre llamo dirección teléfono dni pasaporte "
    "monsieur madame mme rue boulevard nom adresse téléphone appelle passeport né née dot".split()
)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
PIECE = re.compile(TOKEN.pattern + r"|\n")
NUMBER = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns in code points, leftmost and non-overlapping for each kind. Every pattern is passed in time linear in the text."""
    out: list[tuple[str, int, int]] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", m.end() if m and start < at else at + 1)
    if NUMBER.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    """x and X for letters, runs cut to two; d and the length of a number up to six; symbols as they are."""
    if token[0].isdigit() and token.isascii():
        return f"d{min(6, len(token))}"
    if not token[0].isalpha():
        return token
    if token.islower():
        return "xx" if len(token) > 1 else "x1"
    if token[0].isupper() and token[1:].islower():
        return "Xxx" if len(token) > 2 else "Xx"
    cut = "".join("X" if c.isupper() else "x" for c in token)
    return re.sub(r"(.)\1+", r"\1\1", cut) + ("1" if len(token) == 1 else "")


@lru_cache(maxsize=100_000)
def _seen(token: str) -> tuple[str, str]:
    """(shape, word): the word itself if it is a cue or short, else nothing, so that texts of any words look alike."""
    low = token.lower()
    return shape(token), low if low in CUES or not token[0].isalpha() and not token[0].isdigit() else low if len(low) <= 3 and low.isalpha() else ""


_FEATURES = 14


def featured(tokens: list[str]) -> np.ndarray:
    """Places of hashed features, a row a token: shapes and words of it and of its neighbours, pairs of shapes, and the nearest cue within four tokens on either side."""
    pad = ("^", "")
    s = [pad] * 4 + [_seen(t) for t in tokens] + [pad] * 4
    out = np.empty((len(tokens), _FEATURES), np.int64)
    for k in range(len(tokens)):
        i = k + 4
        before = next((s[j][1] for j in range(i - 1, i - 5, -1) if s[j][1] in CUES), "")
        after = next((s[j][1] for j in range(i + 1, i + 5) if s[j][1] in CUES), "")
        out[k] = [_place(j, f) for j, f in enumerate((
            s[i][0], s[i][1], s[i - 1][0], s[i - 1][1], s[i + 1][0], s[i + 1][1], s[i - 2][0], s[i - 2][1], s[i + 2][0], s[i - 1][0] + s[i][0], s[i][0] + s[i + 1][0],
            s[i - 2][0] + s[i - 1][0] + s[i][0], before + "<" + s[i][0], after + ">" + s[i][0]))]
    return out


@lru_cache(maxsize=200_000)
def _place(j: int, feature: str) -> int:
    return zlib.crc32(f"{j}:{feature}".encode()) % PLACES


@dataclass(frozen=True)
class Field:
    """Weights of features by label, of first labels and of neighbouring labels."""

    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray

    def decode(self, windows: list[list[str]]) -> list[list[int]]:
        """The best labels of each sequence of tokens, by Viterbi over all of it."""
        length = np.array([len(w) for w in windows], np.int64)
        start = np.cumsum(length) - length
        scores = np.concatenate([np.zeros((0, len(LABELS)), np.float32)] + [self.weights[featured(w)].sum(1) for w in windows if w])
        whole = np.ones(len(windows), bool)
        labels = self.best(scores, start, length, whole, whole)
        return [labels[s : s + n].tolist() for s, n in zip(start, length, strict=True)]

    def best(self, scores: np.ndarray, start: np.ndarray, length: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The best labels of stretches of rows of ``scores``, in batches of about one length; O elsewhere. A stretch that doesn't open or close its sequence has an O before or after it."""
        out = np.zeros(len(scores), np.uint8)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        while len(order):
            longest = int(length[order[-1]])
            n = max(1, CELLS // longest // len(LABELS))
            chosen, order = order[-n:], order[:-n]
            size, at = length[chosen], start[chosen]
            best = scores[at] + np.where(opens[chosen][:, None], self.first, self.steps[0])
            back = np.zeros((longest, len(chosen), len(LABELS)), np.uint8)
            for t in range(1, longest):
                ways = best[:, :, None] + self.steps
                back[t] = ways.argmax(1)
                best = np.where((t < size)[:, None], ways.max(1) + scores[np.minimum(at + t, len(scores) - 1)], best)
            label = (best + np.where(closes[chosen][:, None], 0, self.steps[:, 0])).argmax(1)
            for t in range(longest - 1, -1, -1):
                inside = t < size
                out[at[inside] + t] = label[inside]
                label = np.where(inside & (t > 0), back[t, np.arange(len(chosen)), label], label)
        return out

    def span_steps(self, begin: int) -> tuple[float, float, float]:
        """Of the kind whose labels are ``begin`` and the next: the most that steps give to a span's first token, to each further one and behind it, against O in its place."""
        b, i, steps, gain = begin, begin + 1, self.steps, lambda x, y: x - y if x > -5e3 else -np.inf
        enter = max([gain(self.first[b], self.first[0])] + [gain(a[b], a[0]) for a in steps])
        leave = max([0.0] + [gain(steps[x, c], steps[0, c]) for x in (b, i) for c in range(len(LABELS)) if LABELS[c][0] != "I"])
        return float(enter), float(max(steps[b, i], steps[i, i]) - steps[0, 0]), float(leave)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of labels that can't come first or follow one another: an inner one comes after its own kind only."""
    n = len(LABELS)
    first, steps = np.zeros(n), np.zeros((n, n))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            first[j] = -1e4
            steps[:, j] = [0.0 if a[0] != "O" and a[2:] == b[2:] else -1e4 for a in LABELS]
    return first, steps


def _spread(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit_field(rows: list[tuple[str, list[tuple[str, int, int]]]], passes: int = 60, rate: float = 0.15, decay: float = 0.002) -> Field:
    """Maximise the likelihood of the labels by Adam, expectations by forward and backward sums over all rows at once.

    A row is a text and its spans (kind, start, end) of the kinds in ADDED; a token belongs to the span that it begins in. Without rows
    nothing but O is ever decoded.
    """
    n, first, steps = len(LABELS), *_allowed()
    told = [x for x in ((list(TOKEN.finditer(t)), spans) for t, spans in rows) if x[0]]
    weights = np.zeros((PLACES, n))
    if not told:
        first = first.copy()
        first[0] += 1e3
        return Field(weights.astype(np.float32), first.astype(np.float32), steps.astype(np.float32))
    length = np.array([len(m) for m, _ in told])
    longest = length.max()
    places, gold = np.zeros((longest, len(told), _FEATURES), np.int64), np.zeros((longest, len(told)), np.int64)
    for r, (ms, spans) in enumerate(told):
        places[: length[r], r] = featured([m[0] for m in ms])
        for kind, s, e in spans:
            inside = [k for k, m in enumerate(ms) if s <= m.start() < e]
            for k in inside:
                gold[k, r] = LABELS.index(("B-" if k == inside[0] else "I-") + kind)
    real = (np.arange(longest)[:, None] < length)[:, :, None]
    want = np.eye(n)[gold] * real
    moved = (want[:-1, :, :, None] * want[1:, :, None, :]).sum((0, 1))
    free_first, free_steps = np.zeros(n), np.zeros((n, n))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, free_first, free_steps)]
    flat = places.reshape(-1)
    for t in range(1, passes + 1):
        score = weights[places].sum(2) * real
        f, s = first + free_first, steps + free_steps
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0] + f
        for k in range(1, longest):
            alpha[k] = np.where(real[k], _spread(alpha[k - 1][:, :, None] + s, 1) + score[k], alpha[k - 1])
        for k in range(longest - 2, -1, -1):
            beta[k] = np.where(real[k + 1], _spread(s + (score[k + 1] + beta[k + 1])[:, None, :], 2), 0)
        whole = _spread(alpha[-1], 1)[:, None]
        here = np.exp(alpha + beta - whole) * real
        both = np.zeros((n, n))
        for k in range(longest - 1):
            both += (np.exp(alpha[k][:, :, None] + s + (score[k + 1] + beta[k + 1])[:, None, :] - whole[:, :, None]) * real[k + 1][:, :, None]).sum(0)
        off = (want - here).reshape(-1, n)
        slope = np.stack([np.bincount(flat, np.repeat(off[:, j], _FEATURES), PLACES) for j in range(n)], 1)
        for x, g, (m, v) in zip((weights, free_first, free_steps), (slope, (want[0] - here[0]).sum(0), moved - both), moments, strict=True):
            g = g / len(told) - decay * x
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(weights.astype(np.float32), (first + free_first).astype(np.float32), (steps + free_steps).astype(np.float32))


# Patterns of the labelled table's rows: {person} and the like are spans, {noise} and {n} aren't.
_TOLD = (
    "my name is {person} {noise}", "{noise} name : {person} .", "{noise} Mr {person} {noise}", "{noise} Mrs . {person} {noise}", "Dr . {person} {noise}", "Dear {person} , {noise}", "signed {person}", "{noise} Sincerely , {person}",
    "{noise} contact {person} at {contact}", "patient {person} was {noise}", "ich heiße {person} {noise}", "Herr {person} {noise}", "{noise} Frau {person} .", "me llamo {person} {noise}", "{noise} señor {person} {noise}", "Sra . {person} {noise}", "nombre : {person}",
    "je m ' appelle {person} .", "{noise} monsieur {person} {noise}", "Mme {person} {noise}", "nom : {person} {noise}", "{person} , born {n} {noise}",
    "{noise} lives at {address} {noise}", "address : {address} .", "{noise} address is {address}", "{noise} wohnhaft {address} {noise}", "Anschrift : {address}", "dirección : {address} {noise}", "adresse : {address} {noise}", "{noise} at {address} , {noise}", "{address} {noise}",
    "SSN {identity} {noise}", "{noise} SSN : {identity}", "passport {identity} {noise}", "{noise} passport no . {identity} {noise}", "IBAN {identity} {noise}", "{noise} IBAN : {identity}", "{noise} account {identity} {noise}", "DNI {identity} {noise}", "Ausweis {identity}", "passeport {identity} {noise}", "identity number {identity} .",
    "call {contact} {noise}", "{noise} phone : {contact}", "tel . {contact} {noise}", "{noise} mobile {contact} {noise}", "Telefon : {contact} {noise}", "teléfono {contact} {noise}", "téléphone : {contact}", "{noise} fax {contact} {noise}", "{noise} reach me at {contact} {noise}", "contact : {contact} {noise}",
)
_PLAIN = (
    "{noise} {n} {noise}", "{noise} . {Noise} {noise} , {noise}", "{noise} version {n} . {n}", "Licensed under CC BY - NC {n} . {n} .", "General Public License , version {n} .", "{noise} license {noise} . {Noise} {noise}", "chapter {n} section {n} {noise}", "in {year} {noise} {n} {noise}", "{noise} {n} . {n} {noise}",
    "$ {n} . {n} {noise}", "{noise} {n} % {noise}", "{noise} {long} {noise}", "{noise} {n} . {n} . {n} . {n} {noise}", "{noise} + {n} ( {n} ) {n} - {n} {noise}", "{noise} . {n} @ {noise} . {noise} . com {noise}", '{noise} token = " {hex} " {noise}', "{noise} | {noise} | {n} | {noise}", "{NOISE} !! {n} !! {NOISE} !!", "{noise} &&& {n} *** {noise} %%%",
    "look at the {noise} {n} times", "{noise} at {noise} {n} {noise}", "call the {noise} {noise}", "the name of the {noise} {noise}", "{noise} road to {noise}", "a {noise} street {noise} . {Noise}", "{noise} dot {noise}", "{Noise} {Noise} {noise} {noise}", "the phone {noise} in {n} {noise}", "account of {noise} {year}", "page {n} of {n}", "{year} - {n} - {n} {noise}",
    "{NOISE} {NOISE} = \" {HEX} \" !!", "dr {noise} {noise}", "{noise} at . {Noise} {noise} {n}", "{noise} né {noise} . {Noise} {noise}", "{noise} nom {noise} . {n} {noise}", "{noise} at , {Noise} , {noise}", "{noise} tel {noise} {noise}", "La rue {noise} . {Noise} {noise}", "{noise} at . At . {Noise} {noise} {n}", "At at at at at at {noise} {n}", "{Noise} {Noise} {Noise} {Noise} dot {noise} {noise}",
    # Prose, tables and junk far from any cue.
    "{noise} . * * * {Noise} % % % {noise} & & & {noise}", "{noise} % % % {noise} . # # # {Noise} & & & {noise}", "{noise} . $ $ $ {Noise} $ $ $ {noise} * * * {noise} . % % % {Noise} # # #", "{noise} . {Noise} {noise} . {Noise} , {noise} . {Noise} {noise}",
    "{Same}", "{noise} . {Same}", "{noise} {Same} {noise}", "| {Noise} | {noise} | {Noise} | {noise} |", "{noise} | {Noise} | {noise} . | {Noise}", "{Noise} {noise} {noise} . {Noise} {noise}", "{noise} , {Noise} {noise} ; {Noise} {noise}", "{noise} . The {noise} . The {noise} {noise}",
    "{noise} & & & {Noise} , # # # {noise} . & & & {Noise} , % % % {noise}", "{noise} . * * {Noise} % % {noise}", "* {Noise} {noise}", "- {Noise} {noise} - {noise}", "{Noise} . {Noise} . {Noise} {noise} .",
)


def _filled(slot: str, rng: random.Random) -> str:
    syllables = ["an", "er", "in", "the", "ou", "st", "ré", "lo", "ma", "ti", "be", "ru", "ka", "so", "vi", "ção", "ñe", "ü", "ha", "nd"]
    word = lambda a=1, b=4: "".join(rng.choice(syllables) for _ in range(rng.randint(a, b)))
    name = lambda: word(2, 3).capitalize()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    many = lambda a, b: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(a, b)))
    if slot == "person":
        return rng.choice([f"{name()}", f"{name()} {name()}", f"{name()} {name()}", f"{name()} {name()[0]}. {name()}", f"{name()} {name()}-{name()}"])
    if slot == "address":
        street = rng.choice(["Street", "Road", "Avenue", "Lane", "Drive"])
        tail = rng.choice(["", f", {name()}", f", {digits(5)} {name()}"])
        return rng.choice([f"{digits(rng.randint(1, 3))} {name()} {street}", f"{name()}straße {digits(2)}", f"{name()} Straße {digits(2)}", f"{digits(2)} rue {name()}", f"{digits(2)}, rue de {name()}", f"calle {name()} {digits(2)}", f"Avenida {name()} {digits(3)}", f"{digits(3)} boulevard {name()}"]) + tail
    if slot == "identity":
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{rng.choice('ABCX')}{digits(8)}", f"{digits(8)}{rng.choice('ABCX')}", f"{rng.choice(['DE', 'FR', 'ES'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"{rng.choice(['DE', 'FR', 'ES'])}{digits(20)}"])
    if slot == "contact":
        return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{word(2, 3)} at {word(2, 3)} dot com", f"{word(2, 3)} dot {word(2, 3)} at {word(2, 3)} dot org"])
    return {
        "noise": lambda: many(1, 6), "Noise": lambda: word().capitalize(), "Same": lambda: " ".join([word().capitalize()] * rng.randint(2, 24)), "NOISE": lambda: many(1, 4).upper(), "n": lambda: digits(rng.randint(1, 4)), "year": lambda: rng.choice(["19", "20"]) + digits(2), "long": lambda: digits(rng.randint(12, 18)),
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), "HEX": lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(40)),
    }[slot]()


def labelled_rows(rows: int = 800, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table by rule: texts of each pattern in turn, filled by chance from ``seed``, with the spans of what is personal."""
    rng, out = random.Random(seed), []
    for k in range(rows):
        pattern = (_TOLD + _PLAIN)[k % len(_TOLD + _PLAIN)]
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", pattern):
            value = _filled(part[1:-1], rng) if part[:1] == "{" else part
            if part[:1] == "{" and part[1:-1] in ADDED:
                spans.append((part[1:-1], len(text), len(text) + len(value)))
            text += value
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession, rows: int = 800, seed: int = 1) -> DataFrame:
    """labelled_rows as a table: text, spans."""
    return spark.createDataFrame(labelled_rows(rows, seed), "text string, spans array<struct<kind:string,start:long,end:long>>")


def fit_table(labelled: DataFrame, most: int = LABELLED) -> Field:
    """A field from a labelled table (text, spans as of labelled_table), of which the first ``most`` rows by a hash of the text are taken. Null texts and unknown kinds are left out."""
    rows = labelled.where(F.col("text").isNotNull()).orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return fit_field([(r["text"], [tuple(x) for x in r["spans"] or [] if x["kind"] in ADDED]) for r in rows])


class _Codes(dict):
    """Numbers of what is seen of tokens, in the order they come; a line's end is 0, and so are the places beyond it."""

    def __init__(self) -> None:
        self.seen, self.numbers = [("^", "")], {}
        self["\n"] = 0

    def __missing__(self, token: str) -> int:
        # Long words that are no cues look like one of two, as _seen has it.
        if len(token) > 3 and token.islower() and token not in CUES:
            seen = ("xx", "")
        elif len(token) > 3 and token[0].isupper() and token[1:].islower() and token.lower() not in CUES:
            seen = ("Xxx", "")
        else:
            seen = _seen(token)
        number = self.numbers.get(seen)
        if number is None:
            number = self.numbers[seen] = len(self.seen)
            self.seen.append(seen)
        self[token] = number
        return number


def scored(tokens: list[str], field: Field) -> np.ndarray:
    """Scores of tokens of lines that each end with a line's end: the sums of weights that ``featured`` has for each line alone, a row a token; line ends have rows too.

    A feature is worked out once for each of its values, not for each token.
    """
    codes = _Codes()
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    ends = code == 0
    # Four places beyond each line, so that nothing is seen across its ends.
    c = np.concatenate([np.zeros(4, np.int64), np.repeat(code, np.where(ends, 4, 1)), np.zeros(4, np.int64)])
    here = 4 + np.arange(len(code)) + 3 * (np.cumsum(ends) - ends)
    names = {}
    shape = np.array([names.setdefault(s, len(names)) for s, _ in codes.seen])
    said = list(names)
    cues = [""] + sorted({w for _, w in codes.seen if w in CUES})
    cue = np.array([cues.index(w) if w in CUES else 0 for _, w in codes.seen])
    weight = lambda j, feature: field.weights[_place(j, feature)]
    out = np.zeros((len(code), len(LABELS)), np.float32)
    for off, js in ((0, (0, 1)), (-1, (2, 3)), (1, (4, 5)), (-2, (6, 7)), (2, (8,))):
        out += np.array([sum(weight(j, x[j % 2]) for j in js) for x in codes.seen], np.float32)[c[here + off]]
    s, q, n = shape[c], cue[c], len(said)

    def add(key: np.ndarray, value) -> None:
        met = pa.array(key).dictionary_encode()
        table = np.array([value(k) for k in met.dictionary.to_pylist()], np.float32).reshape(-1, len(LABELS))
        out[:] += table[met.indices.to_numpy(zero_copy_only=False)]

    add((s[here - 2] * n + s[here - 1]) * n + s[here], lambda k: weight(9, said[k // n % n] + said[k % n]) + weight(11, said[k // n // n] + said[k // n % n] + said[k % n]))
    add(s[here] * n + s[here + 1], lambda k: weight(10, said[k // n] + said[k % n]))
    before, after = (np.zeros(len(code), np.int64) for _ in range(2))
    for off in (4, 3, 2, 1):
        before = np.where(q[here - off], q[here - off], before)
        after = np.where(q[here + off], q[here + off], after)
    add(before * n + s[here], lambda k: weight(12, cues[k // n] + "<" + said[k % n]))
    add(after * n + s[here], lambda k: weight(13, cues[k // n] + ">" + said[k % n]))
    return out


def labelled_tokens(tokens: list[str], field: Field) -> np.ndarray:
    """The best labels of all tokens of lines that each end with a line's end, the same as of decoding each line whole.

    Every token is scored. A span that gives less than O in its place is in no best labelling, as taking it away would better that. The
    most that any span over a token gives comes from running sums and maxima; where it is less than nothing the token
    is O, and what lies between such tokens is decoded on its own.
    """
    scores = scored(tokens, field)
    ends = np.fromiter((t == "\n" for t in tokens), bool, len(tokens))
    line = (np.cumsum(ends) - ends) * 1e6  # sets lines apart in running maxima
    plain = np.ones(len(tokens), bool)
    for b in range(1, len(LABELS), 2):
        enter, inner, leave = field.span_steps(b)
        sums = np.cumsum(np.maximum(-1e3, (scores[:, b + 1] - scores[:, 0] + inner).astype(np.float64)))
        begun = np.maximum.accumulate(scores[:, b] - scores[:, 0] + enter - sums + line)
        over = np.maximum.accumulate((sums - line)[::-1])[::-1]
        plain &= begun + over + leave < -1e-2
    plain |= ends
    edge = np.diff(np.concatenate([[True], plain, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    opens = (start == 0) | ends[start - 1]
    closes = (stop >= len(ends)) | ends[np.minimum(stop, len(ends) - 1)]
    return field.best(scores, start, stop - start, opens, closes)


def added_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """By text: (kind, start, end) of what the field finds, line by line, over all tokens."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    lot: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        lot.append(k)
        size += len(text)
        if size >= LOT or k == len(texts) - 1:
            tokens, starts = [], []
            for x in lot:
                starts.append(len(tokens))
                tokens += PIECE.findall(texts[x])
                tokens.append("\n")
            labels = labelled_tokens(tokens, field)
            hits = np.flatnonzero(labels)
            for x in np.unique(np.searchsorted(starts, hits, "right") - 1):
                for m, j in zip(PIECE.finditer(texts[lot[x]]), labels[starts[x] :], strict=False):
                    name = LABELS[j]
                    if name[0] == "B":
                        found[lot[x]].append((name[2:], m.start(), m.end()))
                    elif name[0] == "I":
                        kind, s, _ = found[lot[x]].pop()
                        found[lot[x]].append((kind, s, m.end()))
            lot, size = [], 0
    return found


def pii_spans(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int]]]:
    """By text: (kind, start, end) in code points, by start, then kind as in KINDS. What the field adds gives way to spans of the patterns."""
    whole = [t or "" for t in texts]
    out = []
    for text, more in zip(whole, added_spans(whole, field), strict=True):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        out.append(sorted(base + [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)], key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for s in range(0, max(1, b.num_rows), 256):
                part = b.slice(s, 256)
                found = [[{"kind": k, "start": x, "end": y} for k, x, y in spans] for spans in pii_spans(part.column(1).to_pylist(), field)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def scan_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end) of every whole text; offsets in code points, end exclusive.

    Nothing is shuffled: each text is scanned where it is read, and the field, of a bounded size, goes with the task. Null counts as
    empty; null ids and repeated rows are answered like any row; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_scan(field), f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")
