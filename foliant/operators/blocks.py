"""BM25 of a stated set of questions against all pages, a block of pages at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import cut, ship, width

#: Weighted query terms that go with the tasks at most, and cells of a block of pages by questions.
MOST_TERMS, CELLS = 1_000_000, 4_000_000


def _named(contexts: pa.Array, terms: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(contexts, terms, "\0")


def _sparse(names: pa.Array, contexts: pa.Array):
    """Pages as counts of the query terms that they hold: their codes, in order, and how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.record_batch(b).filter(pc.is_in(b.column(0), value_set=contexts))
            words = b.column(2)
            lengths = words.value_lengths().to_numpy(zero_copy_only=False)
            page = np.repeat(np.arange(len(b)), lengths)
            code = pc.index_in(_named(b.column(0).take(pa.array(page)), words.flatten()), value_set=names)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(page[known] * len(names) + code.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(b) + 1) * len(names)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(names)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int32()), *lists], names=["context_id", "page_id", "dl", "codes", "tf"])

    return run


def _best(q: np.ndarray, score: np.ndarray, page: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Places of each question's k best, by score to so many digits and then by page."""
    order = np.lexsort((page, -np.round(score, digits), q))
    new = np.flatnonzero(np.diff(q[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[nth < k]


def _scored(shared, k: int, digits: int, k1: float, b: float, average: float, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, asked, weight, questions, contexts = shared.value
        held_q, held_s, held_p, kind = np.zeros(0, np.int64), np.zeros(0), None, None
        high = max(1, cells // max(1, len(questions)))
        for batch in batches:
            kind = batch.schema.field(1).type
            for s in range(0, batch.num_rows, high):
                part = batch.slice(s, high)
                codes, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
                if not len(codes):
                    continue
                page = np.repeat(np.arange(len(part)), part.column(3).value_lengths().to_numpy(zero_copy_only=False))
                dl = part.column(2).to_numpy(zero_copy_only=False)[page]
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
                # Each term of a page meets the questions that ask for it: its stretch of (asked, weight).
                many = starts[codes + 1] - starts[codes]
                at = np.repeat(starts[codes] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                cell, value = np.repeat(page, many) * len(questions) + asked[at], np.repeat(impact, many) * weight[at]
                if len(part) * len(questions) <= cells:
                    sums = np.bincount(cell, value, len(part) * len(questions))
                    cell = np.flatnonzero(sums > 0)
                    sums = sums[cell]
                else:
                    cell, inverse = np.unique(cell, return_inverse=True)
                    sums = np.bincount(inverse, value)
                pages = part.column(1).to_numpy(zero_copy_only=False)[cell // len(questions)]
                q, score, pages = np.concatenate([held_q, cell % len(questions)]), np.concatenate([held_s, sums]), pages if held_p is None else np.concatenate([held_p, pages])
                best = _best(q, score, pages, k, digits)
                held_q, held_s, held_p = q[best], score[best], pages[best]
        if held_p is not None:
            for s in range(0, len(held_q), 50_000):
                q = held_q[s : s + 50_000]
                columns = [questions.take(pa.array(q)), contexts.take(pa.array(q)), pa.array(held_p[s : s + 50_000], kind), pa.array(held_s[s : s + 50_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["question_id", "context_id", "page_id", "score"])

    return run


def bm25_in_blocks(pages: DataFrame, weights: DataFrame, k: int, k1: float, b: float, average: float, digits: int = 9, most_terms: int = MOST_TERMS, cells: int = CELLS) -> DataFrame | None:
    """(question_id, context_id, page_id, score): of each task's pages the k best for each question by weighted terms (question_id, context_id, term, weight). None if there are more than ``most_terms`` of these.

    Pages are read once, as counts of the query terms in them, which are kept; no word that nobody asks for is shuffled or
    stored, and no posting at all. Frequencies come from the counts, one for each query term. Then every task scores its pages for all questions, a
    block at a time, and passes on the best alone. Score zero isn't returned; null contexts hold no pages.
    """
    spark = pages.sparkSession
    if weights.limit(most_terms + 1).count() > most_terms:
        return None
    ship(spark)
    kinds = dict(weights.dtypes)
    given = weights.select("question_id", F.col("context_id").alias("of"), F.col("context_id").cast("string").alias("context_id"), "term", "weight").where("context_id is not null").toArrow()
    page_id = dict(pages.dtypes)["page_id"]
    schema = f"question_id {kinds['question_id']}, context_id {kinds['context_id']}, page_id {page_id}, score double"
    if not len(given):
        return spark.createDataFrame([], schema)
    named = _named(given["context_id"].combine_chunks().cast(pa.string()), given["term"].combine_chunks().cast(pa.string()))
    names = pc.unique(named)
    code = pc.index_in(named, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    contexts = pc.unique(given["context_id"].combine_chunks()).cast(pa.string())
    terms = F.filter(T.without(T.tokens(F.coalesce("text", F.lit(""))), T.STOP_UNITS), lambda t: F.length(t) >= 2)
    dealt = pages.select(F.col("context_id").cast("string").alias("context_id"), "page_id", "text").repartition(width(spark))
    counted = cut(dealt.select("context_id", "page_id", terms.alias("terms")).mapInArrow(_sparse(names, contexts), f"context_id string, page_id {page_id}, dl int, codes array<int>, tf array<int>"))
    held = counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toPandas()  # at most one row a query term
    sizes = {r["context_id"]: r["n"] for r in counted.groupBy("context_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # the questions' contexts
    df = np.zeros(len(names))
    df[held["code"].to_numpy(np.int64)] = held["df"]
    n = np.array([sizes.get(c, 0) for c in given["context_id"].to_pylist()], float)
    order = np.argsort(code, kind="stable")
    ids = pc.unique(given["question_id"].combine_chunks())
    asked = pc.index_in(given["question_id"].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    of = given["of"].combine_chunks().take(pa.array(np.unique(asked, return_index=True)[1]))
    weight = given["weight"].to_numpy() * (np.log((n + 1) / (df[code] + 0.5)) + 1)
    shared = spark.sparkContext.broadcast((np.searchsorted(code[order], np.arange(len(names) + 1)), asked[order], weight[order], ids, of))
    return counted.mapInArrow(_scored(shared, k, digits, k1, b, average, cells), schema).where("score > 0")
