"""Registered queries of the library against their SQL, on the smallest tables."""

import os
import re
from collections import Counter

import pytest
from plain_compare import differences

from foliant.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert not differences(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_answers(spark, name):
    """Queries that SQL does not state give rows, and the same ones again."""
    first, again = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == again and first


def plain_pages(text: str, page_tokens: int, overlap_tokens: int) -> list[tuple]:
    """(page_id, char_start, char_end, line_start, line_end, tokens_est) page by page."""
    size, back, out, start = 4 * page_tokens, 4 * overlap_tokens, [], 0
    while True:
        end = min(len(text), start + size)
        if end < len(text):
            limit, found = min(len(text), start + int(size * 1.15)), None
            for mark in ("\n\n", "\n", ". ", "? ", "! "):
                hits = [k for k in range(end, limit - len(mark) + 1) if text[k : k + len(mark)] == mark]
                if hits:
                    found = hits[0] + len(mark)
                    break
            if found is None:
                hits = [k for k in range(max(start, end - 300), end) if text[k] == "\n"]
                found = max(start + 1, hits[-1] + 1) if hits and end - hits[-1] < 180 else end
            end = found
        lines = 1 + text[:start].count("\n")
        out.append((len(out) + 1, start, end, lines, lines + text[start:end].count("\n"), max(1, (end - start) // 4)))
        if end >= len(text):
            return out
        start = max(start + 1, end - back)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pages_of_documents_equal_plain_paging(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(tuple(r) for r in catalog.QUERIES["pages_of_documents"](spark, SF).select("context_id", "page_id", "char_start", "char_end", "line_start", "line_end", "tokens_est").collect())
    assert got == sorted((d, *p) for d, t in texts.items() for p in plain_pages(t, 200, 20))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_unit_scores_equal_plain_scores(spark):
    """Rarity within a text, from the units and their flags as the library splits and sets them."""
    from pyspark.sql import functions as F

    from foliant.functions import text as T
    from foliant.operators import chunk, compress
    from foliant.plans import views

    docs = views.contexts(spark, SF)
    units = chunk.sentence_units(docs).withColumns(T.flags(F.col("text"))).collect()
    by: dict[int, list] = {}
    for u in units:
        words = [w.lower() for w in re.findall(T.TOKEN, u["text"], re.ASCII)]
        by.setdefault(u["context_id"], []).append((u, [w for w in words if w not in T.STOP_UNITS]))
    want = {}
    for context, rows in by.items():
        seen = Counter(w for _, words in rows for w in set(words))
        for u, words in rows:
            if len(words) < 3 and not u["has_value"] and not u["n_entities"]:
                continue
            score = sum(seen[w] ** -0.5 for w in set(words)) / max(1, len(words) ** 0.5) + 1.5 * u["has_value"] + min(2.0, 0.4 * u["n_entities"]) + 2.5 * (u["has_update"] and len(words) >= 3) + u["has_count"]
            want[context, u["idx"]] = score
    got = {(r["context_id"], r["idx"]): r["base_score"] for r in compress.unit_scores(docs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
