"""Long files read by byte ranges: lines with their right numbers, and one JSON map entry by entry, however many tasks read a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(path, start, at, value): what lies between ``end`` marks. Spark cuts long files into splits that begin at ``start`` and packs short ones together; ``at`` counts on within a split."""
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", end).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _earlier(splits: DataFrame, *names: str) -> DataFrame:
    """Figures of splits (path, start) summed over the file's earlier ones; a file has one row a split."""
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, blank lines left out but counted. Lines end by LF or CR LF.

    Every split counts its lines; a line's number is its place in its split and the counts of the file's splits before. The lines
    themselves are read where they lie and not shuffled. No files' lines are one row or one task's because of their file.
    """
    rows = _parts(spark, path, "\n")
    splits = _earlier(rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("before")), "before")
    numbered = rows.join(splits, ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered.where(F.trim("value") != "")


def _running(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the sum of ``value`` over all that comes before in the file, by split and then over splits."""
    valued = rows.withColumn("__value", value)
    within = F.coalesce(F.sum("__value").over(Window.partitionBy("path", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = _earlier(valued.groupBy("path", "start").agg(F.sum("__value").alias("__before")), "__before")
    return valued.withColumn(name, within).join(splits, ["path", "start"]).withColumn(name, F.col(name) + F.col("__before")).drop("__value", "__before")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, values) of files of one JSON map from strings to lists of strings each.

    Files are read in parts that end by a closing bracket. A bracket closes a list if the quotes before it are even in number, escaped ones
    not counted; parts that end within a string are joined with what follows, as few as they are. Entries whose value is null or empty
    have no list and an empty one. What is no such map fails.
    """
    bare = F.regexp_replace("value", r"\\.", "")
    rows = _running(_parts(spark, path, "]").withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))), "quotes_before", F.col("quotes"))
    closed = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    entries = _running(rows.withColumn("closed", closed), "entry", F.col("closed").cast("long")).groupBy("path", "entry").agg(F.sort_array(F.collect_list(F.struct("start", "at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "]")
    string = r'"(?:[^"\\]|\\.)*"'
    form = rf"(?s)^[\s,{{]*(?:{string}\s*:\s*null\s*,\s*)*({string})\s*:\s*\[(.*)$"
    listed = entries.select("path", text.alias("text")).where(~F.col("text").rlike(rf"(?s)^[\s,{{]*(?:{string}\s*:\s*null\s*,?\s*)*\}}?\s*$"))
    key, values = (F.regexp_extract("text", form, k) for k in (1, 2))
    good = F.when(key == "", F.raise_error(F.concat(F.lit("not a map of lists: "), "path", F.lit(": "), F.substring("text", 1, 80))).cast("string")).otherwise(key)
    return listed.select("path", F.get(F.from_json(F.concat(F.lit("["), good, F.lit("]")), "array<string>"), F.lit(0)).alias("key"), F.from_json(F.concat(F.lit("["), values, F.lit("]")), "array<string>").alias("values"))
