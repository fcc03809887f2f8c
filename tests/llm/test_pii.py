"""Personal data: fixed patterns against the patterns themselves, the field against sums over all labellings, held-out precision and recall, awkward rows."""

import hashlib
import os
import random
import re
from itertools import product

import numpy as np
import pytest

from foliant.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@pytest.fixture(scope="module")
def field():
    return pii.fit_field(pii.labelled_rows())


def test_op12_base_equals_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@", "x-y", ".", ".com", " ", "-", "+", "+1", "12", "255", "256", "007", "4465758382889437", "4465 7583 8288 9437", "(310) 555-4510", "é", "日", "%", "\n", "1.2.3.4", "1.2.3.4.5", "0" * 30, "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert sorted(pii.base_spans(text), key=lambda x: (x[1], pii.KINDS.index(x[0]))) == plain_base(text), text


def test_op12_long_texts_take_linear_time(field):
    for text in ("a" * 2_000_000, "1" * 2_000_000, "+1 " * 500_000, "a@" * 500_000, "1." * 500_000, "7 " * 300_000):
        pii.base_spans(text)
    assert pii.pii_spans(["x" * 3_000_000, "word " * 400_000 + "Mr. Anou Berin"], field)[0] == []


def test_op12_sums_over_all_labellings(monkeypatch):
    """Viterbi finds the best of all labellings; its likelihood's slope is what training climbs."""
    rng = np.random.default_rng(2)
    first, steps = pii._allowed()
    made = pii.Field(rng.normal(size=(pii.PLACES, len(pii.LABELS))).astype(np.float32), (first + rng.normal(size=len(pii.LABELS))).astype(np.float32), (steps + rng.normal(size=steps.shape)).astype(np.float32))
    windows = [["Mr", "Anou", "7"], ["x"], [], ["call", "12"], ["a", "B", "c"], ["née"]]
    for cells in (pii.CELLS, 1):
        monkeypatch.setattr(pii, "CELLS", cells)
        for tokens, got in zip(windows, made.decode(windows), strict=True):
            if tokens:
                score = made.weights[pii.featured(tokens)].sum(1)
                total = lambda way: made.first[way[0]] + sum(score[k, j] for k, j in enumerate(way)) + sum(made.steps[a, b] for a, b in zip(way, way[1:], strict=False))  # noqa: B023, E731
                best = max(product(range(len(pii.LABELS)), repeat=len(tokens)), key=total)
                assert got == list(best)
            else:
                assert got == []


def test_op12_all_tokens_are_decoded(field):
    """Spans are those of decoding every line whole, cue or none: by a field of any weights, and by the trained one."""
    rng, made = np.random.default_rng(5), random.Random(5)
    first, steps = pii._allowed()
    words = "quiet Anou river Berin 12 , . naïve Mr at 日本 ## The ab ABC né call 078 - McBe ЖУК".split()
    texts = ["\n".join(" ".join(made.choice(words) for _ in range(made.randrange(0, 40))) for _ in range(made.randrange(1, 5))) for _ in range(60)] + ["", "\n", "plain Words only Here", "Mr Anou Berin " * 40]
    odd = pii.Field(rng.normal(size=(pii.PLACES, len(pii.LABELS))).astype(np.float32), (first + rng.normal(size=len(pii.LABELS))).astype(np.float32), (steps + rng.normal(size=steps.shape)).astype(np.float32))
    rare = pii.Field(odd.weights - np.float32(0.6) * (np.arange(len(pii.LABELS)) > 0), odd.first, odd.steps)
    for f in (odd, rare, field):
        for text, got in zip(texts, pii.added_spans(texts, f), strict=True):
            want, at = [], 0
            for line in text.split("\n"):
                found = list(pii.TOKEN.finditer(line))
                for m, j in zip(found, f.decode([[m[0] for m in found]])[0], strict=True):
                    if pii.LABELS[j][0] == "B":
                        want.append((pii.LABELS[j][2:], at + m.start(), at + m.end()))
                    elif pii.LABELS[j][0] == "I":
                        want[-1] = (*want[-1][:2], at + m.end())
                at += len(line) + 1
            assert got == want
    assert any(got for got in pii.added_spans(["quiet river naïve"], odd))


def test_op12_held_out(field):
    """Texts of the same patterns filled otherwise: exact spans, and nothing in what is plain."""
    held = pii.labelled_rows(1500, seed=77)
    hit = wrong = missed = 0
    for (_, spans), got in zip(held, pii.added_spans([t for t, _ in held], field), strict=True):
        told, got = set(spans), set(got)
        hit, wrong, missed = hit + len(told & got), wrong + len(got - told), missed + len(told - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.9


def test_op12_added_in_texts_of_their_own(field):
    """Sentences that no pattern holds."""
    text = "We met yesterday. The patient Mrs. Ellen Fairweather came, SSN 078-05-1120, and said little."
    found = {(k, text[s:e]) for k, s, e in pii.pii_spans([text], field)[0]}
    assert ("identity", "078-05-1120") in found and any(k == "person" and "Fairweather" in t for k, t in found)
    assert pii.pii_spans(["The river was quiet that day and nothing else happened before noon.", "", None], field) == [[], [], []]


def test_op12_odd_rows(spark, field):
    rows = [(1, None, "x"), (None, "a@b.c", "y"), (None, "a@b.c", "y"), (3, "", "z"), (4, "tel. +1 (310) 555-4510 0 190.1.1.1 and a@b.c", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["spans"]]) for r in pii.scan_pii(docs, field).collect()), key=str)
    assert [g for g in got if g[0] in (1, 3)] == [(1, []), (3, [])] and [g for g in got if g[0] is None] == [(None, [("email", 0, 5)])] * 2
    assert pii.scan_pii(docs.limit(0), field).count() == 0
    table = pii.labelled_table(spark, 40)
    assert pii.fit_table(table.limit(0)).decode([["Mr", "Anou", "7"]]) == [[0, 0, 0]]
    assert table.columns == ["text", "spans"] and pii.fit_table(table, most=20).weights.shape == (pii.PLACES, len(pii.LABELS))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_op12_query_equals_plain_patterns(spark):
    """The registered query over the whole table: base spans as the patterns give them, added ones beside and not over them."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op12_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r["doc_id"]])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert [x for x in spans if x[0] in pii.BASE] == base and spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))
