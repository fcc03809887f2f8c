"""The first rows of buckets from many files: an index of what files hold decides which are opened, in rounds until all buckets are full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.panel import first_n
from foliant.session import cut


def index_files(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(file, keys, rows, low, high): of each file and bucket how many rows there are and the first and last ``order``. Only keys and order are read. To be kept beside the files."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col("_metadata.file_path").alias("file"), *keys, F.struct(*order).alias("at"))
    return rows.groupBy("file", *keys).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"))


def rows_before(index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds before: how many rows of the bucket lie wholly before the file's first one, in files that end earlier."""
    index = cut(index)  # so that both sides below are of the same partitions
    ends = index.select(*keys, F.lit(None).cast("string").alias("file"), F.col("high").alias("at"), F.col("rows").alias("add"), F.lit(1).alias("kind"))
    begins = index.select(*keys, "file", F.col("low").alias("at"), F.lit(0).cast("long").alias("add"), F.lit(0).alias("kind"))
    so_far = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return ends.unionByName(begins).withColumn("before", F.sum("add").over(so_far)).where("kind = 0").select(*keys, "file", F.col("at").alias("low"), "before")


def read_buckets(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], order: Sequence[str], n_col: str = "n", index: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """The first n rows, by a unique ``order``, of each wanted bucket (keys, n), of those that meet ``where``, with all columns.

    The index (index_files; made first if none is given) tells for each file how many rows come before it for certain. A round
    opens the files before which fewer than n are known, for keys and order alone. Where a condition leaves
    a bucket short and unopened files could still add to it, the next round goes four times as far. Files that hold no wanted bucket, or only rows
    behind full ones, are never opened. Lastly the other columns are read, from the files of the rows chosen. Rows with null keys are in no bucket.
    """
    named = wanted.select(*keys, F.col(n_col).alias("__n"))
    held = cut(rows_before((index_files(spark, path, keys, order) if index is None else index).join(named, list(keys), "left_semi"), keys).join(named, list(keys)))
    found, opened, far, schema = None, set(), 1, spark.read.parquet(path).schema
    while True:
        near = [r["file"] for r in held.where(F.col("before") < F.col("__n") * far).select("file").distinct().collect()]  # the files that are opened
        fresh = sorted(set(near) - opened)
        if fresh:
            rows = spark.read.schema(schema).parquet(*fresh)
            slim = (rows if where is None else rows.where(where)).select(*keys, *order, F.col("_metadata.file_path").alias("__file")).join(named, list(keys))
            slim = cut(first_n(slim, keys, order, "__n"))
            found = slim if found is None else cut(first_n(found.unionByName(slim), keys, order, "__n"))
            opened |= set(fresh)
        if where is None or found is None:
            break
        last = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__had"), F.max(F.struct(*order)).alias("__last"))
        ahead = held.where(F.col("before") >= F.col("__n") * far).join(last, list(keys), "left").where((F.coalesce("__had", F.lit(0)) < F.col("__n")) | (F.col("low") < F.col("__last")))
        if ahead.isEmpty():
            break
        far *= 4
    if found is None:
        return spark.read.parquet(path).limit(0)
    files = [r["__file"] for r in found.select("__file").distinct().collect()]
    if not files:
        return spark.read.parquet(path).limit(0)
    return spark.read.schema(schema).parquet(*files).join(found.select(*keys, *order), [*keys, *order], "left_semi").select(*schema.names)
