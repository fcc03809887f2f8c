"""Exact dedup by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Group identical texts; of each group the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet in three steps, each of which groups by the full text and not by its digest
    alone. (1) Each map task combines equal texts that it reads itself. (2) Tasks' winners
    meet by (digest, salt), so that a group holding a third of all rows is dealt to
    ``salts`` tasks. (3) At most ``salts`` winners of a text meet by digest. A digest under
    which two different texts meet stops the job, as rows could not be told apart later.
    The answer goes back to the rows by (digest, salt) too.

    Null text counts as empty. A null id is smaller than any other; a group with null ids
    only has keep_id null and all its rows are kept. Repeated rows of the id that stays are
    that same document and are all marked as kept. Other columns are ignored, whatever
    their names. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "text")
    salted = keyed.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    by_text = (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    )
    winners = by_text.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.count(F.lit(1)).alias("texts"),
        F.flatten(F.collect_list("salts")).alias("salts"),
    )
    one_text = F.when(F.col("texts") > 1, F.raise_error(F.concat(F.lit("two texts have the SHA-256 digest "), F.col("digest")))).otherwise(F.col("group_size"))
    answers = winners.select("digest", "keep_id", one_text.alias("group_size"), F.explode("salts").alias("salt"))
    return (
        keyed.drop("text")
        .join(answers, ["digest", "salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts exactly one, that with the largest id.

    Combined in the steps of exact_duplicates, each by the full text; whole rows are carried along,
    so that nothing has to be joined back by an id that other rows may share. Null text counts as empty
    and comes out as it was. A null id is smaller than any other. Rows of one id and text, or of
    null ids and one text, are told apart by a hash of their other columns; rows equal in all columns
    are one. No rows give no rows.
    """
    others = [f.name for f in docs.schema.fields if f.name != text_col]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.col(text_col).isNull().alias("was_null"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
        F.struct(F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("tie")).alias("place"),
    ).select(F.sha2("text", 256).alias("digest"), F.pmod(F.col("place.tie"), F.lit(salts)).alias("salt"), "text", "row", "place")
    best = [F.max_by("row", "place").alias("row"), F.max("place").alias("place")]
    winners = keyed.groupBy("digest", "salt", "text").agg(*best).repartition("digest").groupBy("digest", "text").agg(*best)
    back = {c: F.col(f"row.c{k}") for k, c in enumerate(others)} | {text_col: F.when(~F.col("row.was_null"), F.col("text"))}
    return winners.select(*[back[c].alias(c) for c in docs.columns])
