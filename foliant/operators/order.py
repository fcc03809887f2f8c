"""Running figures in an order, over range partitions: what a row needs of rows before it goes on from one range to the next as one figure, so neither a table nor a hot key is one task's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut, width

PART = "__part"


def deal(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt out by ranges of ``order``, with a column that numbers the ranges. Computed once and kept, as ranges are drawn from samples."""
    return cut(rows.repartitionByRange(width(rows.sparkSession), *order).withColumn(PART, F.spark_partition_id()))


def scan(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] = {}, lasts: Mapping[str, Column] = {}) -> DataFrame:
    """Adds to rows dealt out by ranges of keys and order: for each of ``sums`` the sum over the key's rows before, for each of ``lasts`` its last value there that isn't null.

    Within a range windows give both. Of each range and key the sum and the last value are a function of what comes in: add, or replace or keep. Such
    functions are composed along the ranges of a key; only the key that a range begins with can have earlier ones, so what
    is joined back has at most one row a range. Sums of nothing are 0, lasts null. Null keys are keys.
    """
    before = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    named = dealt.withColumns({f"__of_{n}": c for n, c in {**sums, **lasts}.items()})
    place = F.struct(*order)
    ranges = named.groupBy(PART, *keys).agg(*[F.sum(f"__of_{n}").alias(f"__in_{n}") for n in sums], *[F.max_by(f"__of_{n}", F.when(F.col(f"__of_{n}").isNotNull(), place)).alias(f"__in_{n}") for n in lasts])
    comes = ranges.select(F.col(PART).alias("__at"), *[F.col(k).alias(f"__key_{k}") for k in keys], *[F.sum(f"__in_{n}").over(earlier).alias(f"__in_{n}") for n in sums], *[F.last(f"__in_{n}", ignorenulls=True).over(earlier).alias(f"__in_{n}") for n in lasts])
    comes = comes.where(" or ".join(f"`__in_{n}` is not null" for n in [*sums, *lasts]))
    within = named.withColumns({f"__own_{n}": F.sum(f"__of_{n}").over(before) for n in sums} | {f"__own_{n}": F.last(f"__of_{n}", ignorenulls=True).over(before) for n in lasts})
    same = F.col(PART) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    zero = F.lit(0)
    made = [(F.coalesce(f"__own_{n}", zero) + F.coalesce(f"__in_{n}", zero)).alias(n) for n in sums] + [F.coalesce(f"__own_{n}", f"__in_{n}").alias(n) for n in lasts]
    kept = [c for c in dealt.columns if c not in sums and c not in lasts]
    return within.join(F.broadcast(comes), same, "left").select(*kept, *made)  # comes: at most one row a range


def prefix_sums(rows: DataFrame, order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``rows`` with a column for each of ``sums`` (name: column), the sum of that column over all rows before in the whole table's order. Rows equal in ``order`` stand in any one order. No rows give no rows."""
    return scan(deal(rows.withColumn("__all", F.lit(0)), *order), ["__all"], order, {n: F.col(c) for n, c in sums.items()}).drop(PART, "__all")
