"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SHINGLE = 13, 5
#: Characters of all distinct item windows up to which they are broadcast (a few times that as rows).
BROADCAST_CHARS = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _WORD_ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case; other letters keep their case. Null: none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """How many words words() gives."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD_ANY_CASE), F.lit(0))).cast("long")


def _shingle(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, at + k) for k in range(n)])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, w, len, item): each distinct window of each item; an item of fewer words, but not none, is one window."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    each = rows.select("item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - window))).alias("s"))
    return each.select("item", F.slice("all", F.col("s") + 1, window).alias("w")).select("item", "w", F.size("w").alias("len"), F.concat_ws(" ", "w").alias("win")).distinct()


def contaminated_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, start, len, win): every occurrence of an item window in a document.

    1. Count over all documents how often each five-word shingle of the windows occurs.
    2. Order a window's shingles by rarity. All of them must occur where the window does, so
       the rarest alone is the prefix that has to be joined; a window with a shingle that
       never occurs is out.
    3. Join documents' shingles with the prefixes; the window would start at the shingle's place less
       its offset: not before the text starts, not so late that the window's length runs over.
    4. Compare all words of the window with the document's.

    The windows are broadcast only if their characters sum up to ``broadcast_chars`` at most; the
    document's words are then at hand for the comparison. Beyond, shingles are joined by
    a shuffle and the candidates fetch the words by another.
    """
    wins = item_windows(items, item_id_col, item_text_col, window).select("win", "w", "len").distinct()
    size, longest, shortest = wins.agg(F.coalesce(F.sum(F.length("win")), F.lit(0)), F.max("len"), F.min("len")).first()
    small = size <= broadcast_chars
    hint = F.broadcast if small else (lambda df: df)
    widths = sorted({min(shingle, n) for n in range(shortest or 1, min(shingle, longest or 1) + 1)}) or [shingle]
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))

    def hashed(frame: DataFrame, w: str, keep: list[str]) -> DataFrame:
        """A row for each shingle: its place (at) and hash (h)."""
        out = None
        for n in widths:
            fits = F.size(w) >= n
            if "len" in frame.columns:
                fits = fits & (F.least(F.lit(shingle), F.col("len")) == n)
            # explode_outer of null: an inner explode would have Spark filter by, and so split, the text once more.
            at = frame.select(*keep, w, F.explode_outer(F.when(fits, F.sequence(F.lit(0), F.size(w) - n))).alias("at")).where("at is not null").withColumn("h", _shingle(F.col(w), F.col("at"), n))
            out = at if out is None else out.unionByName(at)
        return out

    own = hashed(wins, "w", ["win", "len"])
    counts = hashed(text, "words", []).select("h").join(hint(own.select("h").distinct()), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(counts, "h", "left").groupBy("win").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("at", "h", "w", "len"), F.struct(F.coalesce("n", F.lit(0)), "h", "at")).alias("p"))
    prefixes = ranked.where("least > 0").select("win", F.col("p.at").alias("off"), F.col("p.h").alias("h"), F.col("p.w").alias("w"), F.col("p.len").alias("len"))
    bounds = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("size"))
    if small:
        met = hashed(text, "words", ["doc_id", "text_hash"]).join(F.broadcast(prefixes), "h").withColumn("start", F.col("at") - F.col("off")).withColumn("size", F.size("words"))
        return met.where(bounds & (F.slice("words", F.col("start") + 1, F.col("len")) == F.col("w"))).select("doc_id", "text_hash", "start", "len", "win")
    places = hashed(text, "words", ["doc_id", "text_hash"]).withColumn("size", F.size("words")).drop("words")
    met = places.join(prefixes, "h").withColumn("start", F.col("at") - F.col("off")).where(bounds).select("doc_id", "text_hash", "start", "len", "win", "w").distinct()
    met = met.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    fetched = met.join(text.distinct(), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    return fetched.where(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("w")).select("doc_id", "text_hash", "start", "len", "win")


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int, one_in: int, **how) -> DataFrame:
    """As contamination, with text_hash."""
    names = item_windows(items, item_id_col, item_text_col, window).select("win", "item")
    spans = contaminated_spans(docs, items, id_col, text_col, item_id_col, item_text_col, window, **how)
    found = spans.join(names.groupBy("win").agg(F.collect_set("item").alias("items")), "win")
    hits = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))).cast("long").alias("n_hit"),
    ).withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__hash")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("__text"), count_words(F.col(text_col)).alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left").select(
        "doc_id", F.col("__text").alias("text_hash"), "n_words", hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((hit > 0) & (one_in * hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20, **how) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (strings, sorted), contaminated.

    A word is hit if an occurrence of an item window covers it; a document is contaminated if it
    has hits and they are at least one in ``one_in`` of its words. Null texts have no words. Rows
    with equal ids and texts are answered alike, as often as they come; null ids too. An
    item with a null id is named by the empty string. Items that repeat count once for each id.
    Other columns are ignored. No items: no hits; no documents: no rows.
    """
    return _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window, one_in, **how).drop("text_hash")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, as often as they come.

    Decided by (id, hash of the text), as other texts may have the id; null ids and texts as in contamination. Column
    names may be anything. No items: all rows stay; no rows give no rows.
    """
    bad = _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window, one_in, **how).where("contaminated").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    return keyed.join(bad, F.col("id").eqNullSafe(F.col("__gone")) & (F.col("hash") == F.col("__gone_hash")), "left_anti").select("row.*")
