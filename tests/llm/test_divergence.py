"""Source divergence against brute force, in lots and stripes of any size, and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliant.llm import divergence

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(SMALL) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = set()
    for lang, source in groups:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, all_ = share(counts[lang, source]), share(sum((c for (x, _), c in counts.items() if x == lang), Counter()))  # noqa: B023
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                its = share(counts[lang, other])
                pairs.append((-sum(abs(mine[t] - its[t]) for t in kept), other.encode(), other))
        found = [(all_[t] - mine[t], t.encode(), t) for t in kept if counts[lang, source][t] and mine[t] > all_[t]]
        out |= {(lang, source, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pairs))}
        out |= {(lang, source, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:top])}
    return out


def invented(seed=1, n=400):
    rng = random.Random(seed)
    vocab = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(400)] + ["É", "naïve", "日本", "The", "the"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s0"] * 5 + [f"s{k}" for k in range(7)] + [None, "", "é"])
        lean = (len(source) + ord(source[-1])) % 7 * 30 if source else 0
        rows.append((" ".join(vocab[min(404, int(rng.expovariate(1 / 60)) + (lean if rng.random() < 0.3 else 0))] for _ in range(rng.randrange(0, 60))) + rng.choice(["", "!", " 12a34b"]), lang, source))
    return [*rows, (None, "en", "none"), ("", "de", "one"), ("few words", "de", "two"), ("x" * 300_000 + " waku " * 1000, "en", "s0")]


@pytest.mark.parametrize(("lot", "cells"), [(20_000, 4_000_000), (7, 5), (100, 30)])
def test_op13_equals_brute_force(spark, monkeypatch, lot, cells):
    """Small lots merge skybands of a few rows each; few cells deal a language's sources out in stripes."""
    rows = invented()
    monkeypatch.setattr(divergence, "ENTRIES", 50 if lot == 7 else 200_000)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(docs, least_docs=5, top=12, entries_lot=lot, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 12)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "de" and r[4] == 0 for r in got)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_op13_skyband_is_what_fewer_dominate(k):
    rng = np.random.default_rng(k)
    for high in (3, 40, 10_000):
        n = rng.integers(1, high, 900)
        lang_n = n + rng.integers(0, high, 900)
        above = [int(((n[:i] >= n[i]) & (lang_n[:i] <= lang_n[i])).sum()) for i in range(900)]
        assert divergence.skyband(n, lang_n, k).tolist() == [a < k for a in above]


def test_op13_counts_beyond_a_long(spark):
    """Shares are exact where a count times 10^9 no longer fits in 64 bits."""
    from pyspark.sql import functions as F

    big = 10**11 + 7
    row = spark.createDataFrame([(big, 3 * big, 1000)], "n long, total long, kept long").select(divergence._share("n", "total", "kept", 5).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (3 * big + 5000)
    assert spark.range(1).select(F.lit(0).alias("total"), F.lit(0).alias("kept")).select(divergence._share(F.lit(0), "total", "kept", 5).alias("p")).first()["p"] == 1


def test_op13_odd_rows(spark):
    """Other columns, clashing names, repeated rows and empty tables."""
    rows = [("a b", "en", "x", 1)] * 40 + [("a c", "en", "y", 2)] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term long").selectExpr("*", "'clash' AS n", "'clash' AS lot")
    got = {tuple(r) for r in divergence.source_divergence(docs).collect()}
    assert got == brute([r[:3] for r in rows], 30, 50) and len(got) == 4
    assert divergence.source_divergence(docs.limit(0)).collect() == []

