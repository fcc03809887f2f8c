"""Panels, matrices and set operations: first-N per group, keep-last, allow-lists, examples, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``. An aggregate, so a hot key is combined before the shuffle."""
    return _kept(rows, keys, order, F.max_by)


def keep_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return _kept(rows, keys, order, F.min_by)


def _kept(rows: DataFrame, keys: Sequence[str], order: str, pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*rest)
    return rows.groupBy(*keys).agg(pick(whole, F.struct(order, F.xxhash64(whole))).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | str) -> DataFrame:
    """The first ``n`` (a number or a column) of each group in order; ranks beyond are pruned before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= (F.lit(n) if isinstance(n, int) else F.col(n))).drop("__rank")


def shortfall(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], n_col: str = "n") -> DataFrame:
    """Wanted buckets that have too few rows: keys, n, have. ``wanted`` is a table of a few buckets."""
    have = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    return wanted.join(have, list(keys), "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < F.col(n_col))


def balanced_panel(rows: DataFrame, spec: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first n rows (n of ``spec``) of each stratum that the spec names."""
    return first_n(rows.join(F.broadcast(spec.limit(100_000)) if _small(spec) else spec, list(keys)), keys, order, "n").drop("n")


def _small(spec: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has at most ``most`` rows, found by reading so many."""
    return spec.limit(most + 1).count() <= most


def cross_panel(rows: DataFrame, priority: Column, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows by (priority, order): other families first, preferred tasks next, then the rest."""
    return rows.withColumn("__priority", priority).orderBy("__priority", *order).limit(most).drop("__priority")


def experiment_matrix(dims: Mapping[str, Sequence[str]], spark) -> DataFrame:
    """Every combination of a few lists of settings (job numbers from 1 in order of the lists)."""
    frames = [spark.createDataFrame([(k, x) for k, x in enumerate(v)], f"__{n} int, {n} string") for n, v in dims.items()]
    every = reduce(lambda a, b: a.crossJoin(b), frames)  # settings, not data: a few hundred rows
    number = F.lit(0)
    for n, v in dims.items():
        number = number * len(v) + F.col(f"__{n}")
    return every.withColumn("job", number + 1).select("job", *dims)


def skip_existing(jobs: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def allow_list(rows: DataFrame, ids: DataFrame, key: str, deny: bool = False) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti" if deny else "left_semi")


def union_roots(roots: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several roots; a later root's row replaces an earlier one's of the same keys."""
    tagged = [r.withColumn("__root", F.lit(k)) for k, r in enumerate(roots)]
    return keep_last(reduce(lambda a, b: a.unionByName(b), tagged), keys, "__root").drop("__root")


def missing_types(wanted: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    return wanted.select(col).distinct().join(rows.select(col).distinct(), col, "left_anti")


def example_rows(rows: DataFrame, target: str, other: str, key: str = "task", n: int = 4) -> DataFrame:
    """Up to ``n`` tasks each where only the target arm, only the other arm, or a lenient score alone was right: class, key."""
    score = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    wide = rows.groupBy(key).agg(score(target, "correct").alias("t"), score(other, "correct").alias("o"), score(target, "relaxed").alias("tr")).where("t is not null and o is not null")
    kind = F.when(F.col("t") & ~F.col("o"), "target_only").when(~F.col("t") & F.col("o"), "other_only").when(~F.col("t") & F.col("tr"), "formatting")
    return first_n(wide.withColumn("class", kind).where("class is not null"), ["class"], [key], n).select("class", key)


def evenly_spaced(rows: DataFrame, keys: Sequence[str], place: str, n: int) -> DataFrame:
    """``n`` evenly spaced rows of each group (places rounded half to even); the whole group if it isn't larger. ``place`` runs from 1."""
    size = F.max(place).over(Window.partitionBy(*keys))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("__size") - 1) / F.lit(max(1, n - 1))) + 1)
    return rows.withColumn("__size", size).where((F.col("__size") <= n) | F.array_contains(at, F.col(place).cast("double"))).drop("__size")


def sampled_manifest(rows: DataFrame, panel: str, order: Sequence[str], n: int, columns: Sequence[str] = ("task_id", "source_benchmark", "source_task", "scorer")) -> DataFrame:
    """The first ``n`` rows of each panel with the columns that a manifest shows."""
    return first_n(rows, [panel], order, n).select(panel, *[c for c in columns if c != panel])
