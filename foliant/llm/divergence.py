"""Source divergence audit: how the words of each source differ from those of its language and of the language's other sources."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut, ship

#: Documents of a language that a kept term is in at least, what is added to every count, ranks of terms that are returned.
LEAST_DOCS, ADDED, TOP = 30, 5, 50
#: Counters that a task holds before it passes them on; rows that a skyband is made of at once; rows of a lot of terms; cells of a matrix of differences.
ENTRIES, LOT, TERMS, CELLS = 200_000, 20_000, 100_000, 4_000_000

# Letters and what is beyond ASCII stay, capitals of ASCII become small, all else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters and of characters beyond ASCII, in which only A-Z are made small."""
    return text.translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(g, t, n, docs[t]) for g, (counts, docs) in held.items() for t, n in counts.items()]
        columns = ([g[0] for g, *_ in rows], [g[1] for g, *_ in rows], [r[1].decode() for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        entries = 0
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms(text.as_py())
            before = len(counts)
            counts.update(words)
            docs.update(set(words))
            entries += len(counts) - before
            if entries > ENTRIES:
                yield out()
                entries = 0
        if sum(len(c) for c, _ in held.values()) > ENTRIES:
            yield out()
    if held:
        yield out()


def skyband(count: np.ndarray, lang_count: np.ndarray, k: int) -> np.ndarray:
    """Which rows, given in UTF-8 order of their terms, fewer than ``k`` others dominate.

    A row dominates a later one if its count is as high or higher and its language count as low or lower. What k rows dominate
    k of the skyband dominate too, so each block is compared with itself and with what stayed before it.
    """
    stays = np.zeros(len(count), bool)
    kept_n, kept_l = count[:0], lang_count[:0]
    for s in range(0, len(count), 256):
        n, lang_n = count[s : s + 256], lang_count[s : s + 256]
        above = ((kept_n >= n[:, None]) & (kept_l <= lang_n[:, None])).sum(1)
        above += np.tril((n >= n[:, None]) & (lang_n <= lang_n[:, None]), -1).sum(1)
        stays[s : s + 256] = above < k
        kept_n, kept_l = np.concatenate([kept_n, n[above < k]]), np.concatenate([kept_l, lang_n[above < k]])
    return stays


def _bands(k: int, lot: int):
    def pruned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        place = {g: i for i, g in enumerate(dict.fromkeys(zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)))}
        group = np.fromiter((place[g] for g in zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)), np.int64, len(rows))
        n, lang_n = rows["n"].to_numpy(), rows["lang_n"].to_numpy()
        words = rows["term"].cast(pa.binary()).to_pylist()
        order = np.array(sorted(range(len(rows)), key=lambda r: (group[r], words[r])), np.int64)
        edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        stays = [order[s:e][skyband(n[order[s:e]], lang_n[order[s:e]], k)] for s, e in zip(edges, edges[1:], strict=False)]
        return rows.take(pa.array(np.concatenate(stays))).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for s in range(0, b.num_rows, lot):
                held.append(b.slice(s, lot))
                if sum(x.num_rows for x in held) >= lot:
                    yield pruned(held)
                    held = []
        if held:
            yield pruned(held)

    return run


def term_skybands(counted: DataFrame, k: int = TOP, lot: int = LOT) -> DataFrame:
    """The rows of (lang, source, term, n, lang_n) that may be among the ``k`` first of their group: each partition's skybands, merged by group.

    Of two terms that with the higher count, the lower language count and the earlier UTF-8 comes first whatever the totals
    are, so what k others dominate has no place among the first k. A group of any size is merged in
    lots of about ``lot`` rows; what is left beyond need is sorted out by the ranks.
    """
    ship(counted.sparkSession)
    counted = counted.select("lang", "source", "term", "n", "lang_n")
    kept = cut(counted.mapInArrow(_bands(k, lot), counted.schema))
    lots = max(1, math.ceil(kept.count() / lot))
    merged = kept.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(lots)))
    return merged.mapInArrow(_bands(k, lot), counted.schema)


def _differences(cells: int):
    """Of rows sorted by (lang, lot, stripe), a source's own row before the terms': the sums of differences of each two sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, base, sums, mine = None, [], None, None, slice(0)
        terms_held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def add() -> None:
            """Fold the held terms in: each a row of all sources' shares, those of sources without it as they are for no occurrence."""
            if terms_held:
                p = np.repeat(base[None], len(terms_held), 0)
                for r, (at, share) in enumerate(terms_held):
                    p[r, at] = share
                for k in range(mine.start, mine.stop):
                    sums[k - mine.start] += np.abs(p - p[:, k : k + 1]).sum(0)
                terms_held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(mine.start, mine.stop):
                columns = ([key[0]] * len(names), [names[k]] * len(names), names, sums[k - mine.start])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),), strict=True)], names=["lang", "source", "item", "value"])

        def table(rows: list[tuple[str, int]], stripe: int) -> None:
            nonlocal names, base, sums, mine
            names, base = [s for s, _ in rows], np.array([b for _, b in rows], np.int64)
            high = max(1, cells // len(names))
            mine = slice(min(stripe * high, len(names)), min((stripe + 1) * high, len(names)))
            sums = np.zeros((mine.stop - mine.start, len(names)), np.int64)

        heads: list[tuple[str, int]] = []
        word, at, share = None, [], []
        for b in batches:
            for lang, lot, stripe, source, idx, term, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, lot, stripe) != key or term != word:
                    if word is not None:
                        terms_held.append((np.array(at, np.int64), np.array(share, np.int64)))
                        if len(terms_held) * len(names) >= cells // 8:
                            add()
                    word, at, share = term, [], []
                if (lang, lot, stripe) != key:
                    if key is not None:
                        if sums is None:
                            table(heads, key[2])
                        add()
                        yield from out()
                    key, heads, sums = (lang, lot, stripe), [], None
                if term is None:
                    heads.append((source, p))
                    continue
                if sums is None:
                    table(heads, stripe)
                at.append(idx)
                share.append(p)
        if key is not None:
            if sums is None:
                table(heads, key[2])
            if word is not None:
                terms_held.append((np.array(at, np.int64), np.array(share, np.int64)))
            add()
            yield from out()

    return run


def _share(count: str | Column, total: str, kept: str, added: int) -> Column:
    """1 + floor(10^9 (count + added) / (total + added * kept)), exactly; 1 if nothing is kept."""
    whole = (F.col(total) + added * F.col(kept)).cast("decimal(20,0)")
    above = (F.col(count) if isinstance(count, str) else count) + added
    top = (above.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(30,0)")
    return F.when(whole > 0, F.call_function("div", top, whole)).otherwise(0) + 1


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, added: int = ADDED, top: int = TOP, entries_lot: int = LOT, cells: int = CELLS) -> DataFrame:
    """What sets the sources of each language apart: lang, source, part, item, value, rank.

    A language keeps the terms in at least ``least_docs`` of its documents. Every group (language, source), whether it has
    terms or not, and the language as a whole give each kept term a smoothed share in parts of 10^9. ``pair``: the sum over all kept terms of
    the differences to each other source's shares, all of them ranked. ``term``: the kept terms that the group has and gives a higher
    share than the language does, by how much, the first ``top`` of them. Ranks count from 1, by value
    from above, then by item in UTF-8.

    Texts are counted where they are read and meet by (language, term), so no language, source or common term is
    one task's. Terms: skybands of partitions are merged, what is left is ranked exactly. Pairs: lots of terms fold their differences into a
    matrix of the language's sources (in stripes of ``cells`` cells), and the matrices are summed; rows of two sources a term never exist.

    Null texts, languages and sources count as empty. Repeated rows are documents of their own, ids aren't looked at. Of
    a language with nothing kept all pairs have value 0. Other columns are ignored. No rows give no rows.
    """
    ship(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    made = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_term = Window.partitionBy("lang", "term")
    counted = (
        made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), F.row_number().over(by_term.orderBy("source")).alias("at"))
        .where(F.col("lang_docs") >= least_docs).drop("lang_docs")
    )
    counted = cut(counted)

    langs = counted.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("at") == 1, 1)).alias("kept"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    of_lang = Window.partitionBy("lang")
    groups = cut(groups.withColumns({"idx": F.row_number().over(of_lang.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(of_lang)}))

    found = term_skybands(counted, top, entries_lot).join(groups, ["lang", "source"])
    found = found.withColumn("value", _share("n", "total", "kept", added) - _share("lang_n", "lang_total", "kept", added)).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    lots = max(16, math.ceil(counted.count() / TERMS))
    stripe = F.explode(F.sequence(F.lit(0), F.ceil(F.col("sources") / F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("sources")))).cast("int") - 1)).alias("stripe")
    shares = counted.join(groups, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.lit(lots)).cast("int").alias("lot"), stripe, F.lit("").alias("source"), "idx", "term", _share("n", "total", "kept", added).alias("p"))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "source", "idx", "sources", _share(F.lit(0), "total", "kept", added).alias("p"))
    heads = heads.select("lang", "lot", stripe, "source", "idx", F.lit(None).cast("string").alias("term"), "p")
    dealt = shares.unionByName(heads).repartition("lang", "lot", "stripe").sortWithinPartitions("lang", "lot", "stripe", F.asc_nulls_first("term"), "idx")
    sums = dealt.mapInArrow(_differences(cells), "lang string, source string, item string, value long").where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(first)
