"""Evaluation aggregates over scored runs: summaries, paired comparison, retention, quotes, judge merges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foliant.functions import text as T
from foliant.operators.bloom import filter_bits, may_hold
from foliant.operators.panel import keep_last
from foliant.session import ship


def _share(part: Column, whole: Column) -> Column:
    """A ratio, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def run_summary(scored: DataFrame, keys: Sequence[str] = ("harness", "model", "condition"), detail: str = "source_benchmark") -> DataFrame:
    """One pass over scored runs by ``keys`` and by keys with ``detail`` (null in rows of the former).

    Runs contaminated by tools count in the totals and in accuracy_all, not in accuracy.
    """
    clean = ~F.col("contaminated")
    agg = [
        F.count(F.lit(1)).alias("n_total"), F.count_if(clean).alias("n_clean"), F.count_if(clean & F.col("correct")).alias("correct_clean"), F.count_if("correct").alias("correct_all"),
        F.avg(F.when(clean, F.col("score"))).alias("avg_score"), F.avg("score").alias("avg_score_all"), F.count_if("parse_ok").alias("parse_ok"), F.count_if("contaminated").alias("contaminated"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("compactions").alias("compaction_events"), F.avg("duration_s").alias("avg_duration"),
    ]
    out = scored.groupingSets([[*keys], [*keys, detail]], *keys, detail).agg(*agg, F.grouping_id().alias("level"))
    return out.withColumns({
        "level": F.when(F.col("level") == 0, detail).otherwise("all"), "accuracy": _share(F.col("correct_clean"), F.col("n_clean")), "accuracy_all": _share(F.col("correct_all"), F.col("n_total")),
        "parse_ok_rate": _share(F.col("parse_ok"), F.col("n_total")), "contaminated_rate": _share(F.col("contaminated"), F.col("n_total")), "avg_score": F.coalesce("avg_score", F.lit(0.0)),
    })


def batch_stats(rows: DataFrame, sets: Sequence[Sequence[str]] = ((), ("model",), ("model", "length"), ("model", "task"), ("length",), ("task",))) -> DataFrame:
    """Totals and resolved rows (no error) with accuracies, compactions and judge results by several key sets, the empty one being overall; set names its keys."""
    names = list(dict.fromkeys(k for s in sets for k in s))
    resolved = F.col("error").isNull()
    out = rows.groupingSets([list(s) for s in sets], *names).agg(
        F.concat_ws(",", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in names]).alias("set"), F.count(F.lit(1)).alias("n_total"), F.count_if(resolved).alias("n_resolved"), F.count_if("correct").alias("n_correct"),
        F.count_if(F.col("correct") | F.coalesce("judge_equivalent", F.lit(False))).alias("n_correct_judged"), F.sum("compactions").alias("compactions"), F.count_if(F.col("compactions") > 0).alias("n_compacted"),
    )
    return out.withColumns({
        "accuracy_total": _share(F.col("n_correct"), F.col("n_total")), "accuracy_resolved": _share(F.col("n_correct"), F.col("n_resolved")), "accuracy_judged": _share(F.col("n_correct_judged"), F.col("n_resolved")),
    })


def error_counts(rows: DataFrame) -> DataFrame:
    """error_category, n and rate over all rows."""
    counted = rows.groupBy(T.error_category(F.col("error"), F.col("parse_ok")).alias("error_category")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("error_category", "n", _share(F.col("n"), F.col("total")).alias("rate"))  # total: one row


def best_and_worst(stats: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n best and the n worst keys by (accuracy_resolved, n_resolved); ties by key. end says which."""
    best = stats.orderBy(F.desc("accuracy_resolved"), F.desc("n_resolved"), key).limit(n).withColumn("end", F.lit("best"))
    worst = stats.orderBy("accuracy_resolved", "n_resolved", key).limit(n).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def compare_batches(batches: Mapping[str, DataFrame], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Batches side by side: keys, then measure_label for each label."""
    all_rows = None
    for label, df in batches.items():
        one = df.select(*keys, *measures, F.lit(label).alias("batch"))
        all_rows = one if all_rows is None else all_rows.unionByName(one)
    out = all_rows.groupBy(*keys).pivot("batch", list(batches)).agg(*[F.first(m).alias(m) for m in measures])
    return out if len(measures) > 1 else out.select(*keys, *[F.col(b).alias(f"{b}_{measures[0]}") for b in batches])


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Adds arm, original_task_id and evidence_tokens from JSON metadata, each with its fallbacks."""
    meta = lambda path: F.get_json_object("metadata", path)
    return runs.withColumns({
        "arm": F.coalesce(meta("$.arm"), F.col("condition")), "original_task_id": F.coalesce(meta("$.original_task_id"), meta("$.task.original_task_id"), F.col("task_id")),
        "evidence_tokens": F.coalesce(meta("$.evidence_tokens_est"), meta("$.packet.evidence_tokens_est"), meta("$.virtual_context.evidence_tokens_est"), F.lit("0")).try_cast("int"),
    })


def arm_summary(rows: DataFrame, details: Sequence[str]) -> DataFrame:
    """By arm and by arm with each of ``details``: n, n_resolved, n_correct, accuracy, avg_score; detail and value name the group."""
    resolved = F.col("error").isNull()
    out = rows.groupingSets([["arm"], *[["arm", d] for d in details]], "arm", *details).agg(
        F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in details], F.lit("all")).alias("detail"), F.coalesce(*[F.col(d).cast("string") for d in details]).alias("value"),
        F.count(F.lit(1)).alias("n"), F.count_if(resolved).alias("n_resolved"), F.count_if("correct").alias("n_correct"), F.avg("score").alias("avg_score"),
    )
    return out.select("arm", "detail", "value", "n", "n_resolved", "n_correct", _share(F.col("n_correct"), F.col("n")).alias("accuracy"), "avg_score")


def paired_comparison(rows: DataFrame, base: str, key: str = "task", details: Sequence[str] = ()) -> DataFrame:
    """``base`` against every other arm on the tasks that both ran: n_pairs, wins, losses, ties, both, base_only, other_only, neither.

    One row for each arm and task is taken for granted (keep_last before). Grouped overall and by each of ``details``.
    """
    first = rows.where(F.col("arm") == base).select(key, F.col("score").alias("base_score"), F.col("correct").alias("base_correct"), *details)
    other = rows.where(F.col("arm") != base).select(key, "arm", "score", "correct")
    pairs = first.join(other, key)
    b, o = F.col("base_correct"), F.col("correct")
    out = pairs.groupingSets([["arm"], *[["arm", d] for d in details]], "arm", *details).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("base_score") > F.col("score")).alias("wins"), F.count_if(F.col("base_score") < F.col("score")).alias("losses"),
        F.count_if(F.col("base_score") == F.col("score")).alias("ties"), F.count_if(b & o).alias("both"), F.count_if(b & ~o).alias("base_only"), F.count_if(~b & o).alias("other_only"), F.count_if(~b & ~o).alias("neither"),
    )
    return out.withColumn("base", F.lit(base))


def retention(runs: DataFrame, by: Sequence[str] = (), preview_chars: int | None = None, count_goldless: bool = True) -> DataFrame:
    """Share of runs whose lower-case gold stands in any turn (its first ``preview_chars`` only, if given), accuracy, and the gap in points.

    Runs without a gold never retain it; they stay in the denominator only if ``count_goldless``.
    """
    rows = runs if count_goldless else runs.where(F.coalesce(F.length("gold_answer"), F.lit(0)) > 0)
    gold = F.lower("gold_answer")
    seen = (lambda t: F.lower(t)) if preview_chars is None else (lambda t: F.lower(F.substring(t, 1, preview_chars)))
    kept = F.coalesce((F.length(gold) > 0) & F.exists("turns", lambda t: F.contains(seen(t), gold)), F.lit(False))
    grouped = rows.withColumn("kept", kept).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_retained"), F.count_if("correct").alias("n_correct"))
    return grouped.withColumns({"retention": _share(F.col("n_retained"), F.col("n")), "accuracy": _share(F.col("n_correct"), F.col("n"))}).withColumn("gap_points", 100 * (F.col("retention") - F.col("accuracy")))


def exact_aggregate_ratio(rows: DataFrame, floor: float = 0.001) -> DataFrame:
    """Accuracy on exact over accuracy on aggregate tasks (column kind), with a floor below the line."""
    exact, agg = (F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("correct").cast("double"))), F.lit(0.0)) for k in ("exact", "aggregate"))
    return rows.agg(exact.alias("exact_accuracy"), agg.alias("aggregate_accuracy")).withColumn("ratio", F.col("exact_accuracy") / F.greatest(F.col("aggregate_accuracy"), F.lit(floor)))


def merge_verdicts(runs: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("task_id", "model", "harness", "condition"), order: str = "ord") -> DataFrame:
    """Runs with the last verdict of each key; judge_applied and final_correct. Eligible are runs that are wrong, parsed, clean and answered."""
    last = keep_last(verdicts, keys, order).select(*keys, "judge_equivalent")
    eligible = ~F.col("correct") & F.col("parse_ok") & ~F.col("contaminated") & (F.coalesce(F.length(T.strip(F.col("answer"))), F.lit(0)) > 0)
    return runs.join(last, list(keys), "left").withColumn("judge_applied", eligible & F.col("judge_equivalent").isNotNull()).withColumn("final_correct", F.col("correct") | (F.col("judge_applied") & F.coalesce("judge_equivalent", F.lit(False))))


def judge_summary(merged: DataFrame, keys: Sequence[str] = ("harness", "model", "condition")) -> DataFrame:
    """n, n_judged, accuracies before and after, and overturns."""
    return merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("judge_applied").alias("n_judged"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("final_correct").cast("double")).alias("judge_accuracy"),
        F.count_if(F.col("final_correct") & ~F.col("correct")).alias("overturns"),
    )


def context_statistics(contexts: DataFrame, by: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """Counts and least, largest, mean and total estimated tokens."""
    t = T.tokens_est(F.col(text_col))
    return contexts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.avg(t).alias("avg_tokens"), F.sum(t).alias("total_tokens"))


def composition(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts by each key and overall: detail, value, n."""
    return rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys], F.lit("all")).alias("detail"), F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("value"), F.count(F.lit(1)).alias("n")
    ).select("detail", "value", "n")


#: Keys whose strings are quotes (a fixed value).
QUOTED = re.compile(r"(^|_)(source_)?quote(s)?$|citation|evidence", re.IGNORECASE)


def keyed_strings(text: str | None) -> Iterator[tuple[str, str]]:
    """(nearest key, string) of all strings of a JSON text, in its order; lists hand on the key that they stand under. Nothing of what isn't JSON."""
    try:
        todo = [("", json.loads(text or "null"))]
    except (ValueError, RecursionError):
        return
    while todo:
        key, node = todo.pop()
        if isinstance(node, str):
            yield key, node
        elif isinstance(node, (dict, list)):
            inner = node.items() if isinstance(node, dict) else ((key, x) for x in node)
            todo += reversed(list(inner))


def quotes_from_json(proofs: DataFrame, json_col: str = "proof", keep: int = 80) -> DataFrame:
    """(…, ord, quote): the distinct strings of 8 to 2000 characters, blanks around them cut, whose nearest key speaks of quotes, citations or evidence, up to ``keep`` a row, in order.

    Found in the row, in Arrow batches: a variant sorts its keys, so an order of the text can't be had from one. Null and broken JSON has none.
    """
    ship(proofs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            cut = (s.strip() for k, s in keyed_strings(text) if QUOTED.search(k))
            found.append(list(islice(dict.fromkeys(s for s in cut if 8 <= len(s) <= 2000), keep)))
        return pa.array(found, pa.list_(pa.string()))

    return proofs.select("*", F.posexplode(F.arrow_udf(run, ArrayType(StringType()))(json_col)).alias("ord", "quote"))


def verify_quotes(quotes: DataFrame, contexts: DataFrame, key: str = "context_id", text_col: str = "text") -> DataFrame:
    """Adds exact and normalised (white space folded) containment of each quote in its context."""
    fold = lambda c: T.strip(F.regexp_replace(c, r"\s+", " "))
    joined = quotes.join(contexts.select(key, F.col(text_col).alias("__text")), key, "left")
    return joined.withColumns({"exact": F.coalesce(F.contains("__text", F.col("quote")), F.lit(False)), "normalised": F.coalesce(F.contains(fold(F.col("__text")), fold(F.col("quote"))), F.lit(False))}).drop("__text")


def verbatim_passages(corpus: DataFrame, passages: DataFrame, head: int = 8, id_col: str = "doc_id", text_col: str = "text", passage_id: str = "item_id", broadcast_chars: int = 8_000_000) -> DataFrame:
    """(passage_id, doc_id): which passages stand verbatim (case and white space folded) in which texts.

    Texts and passages meet by the hash of ``head`` consecutive tokens, the passage's first, so no text is
    compared with passages that it shares no such run with; then the whole passage is looked for. Passages
    of fewer tokens meet by all they have. Passages are broadcast up to ``broadcast_chars`` characters in all;
    beyond, the hashes that a Bloom filter of the passages' heads lets through are shuffled, and each candidate fetches its text and passage.
    """
    fold = lambda c: T.strip(F.lower(F.regexp_replace(c, r"\s+", " ")))
    items = passages.select(passage_id, fold(F.col(text_col)).alias("passage")).where("passage <> ''").withColumn("n", F.least(F.lit(head), F.size(F.split("passage", " "))))
    items = items.withColumn("h", F.xxhash64("n", F.array_join(F.slice(F.split("passage", " "), F.lit(1), F.col("n")), " ")))
    measured = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars"), F.collect_set("n").alias("sizes")).first()  # sizes: at most ``head`` numbers
    docs = corpus.select(id_col, fold(F.col(text_col)).alias("folded"))
    split = docs.withColumn("w", F.split("folded", " "))
    runs = None
    for n in measured["sizes"]:
        # explode_outer of null, as an inner explode would have Spark fold and split the text once more to filter by it.
        at = split.select(id_col, "folded", "w", F.explode_outer(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))).alias("at")).where("at is not null")
        one = at.select(id_col, "folded", F.xxhash64(F.lit(n), F.concat_ws(" ", *[F.get("w", F.col("at") + k) for k in range(n)])).alias("h"))
        runs = one if runs is None else runs.unionByName(one)
    if runs is None:
        return docs.select(F.lit(None).cast(dict(passages.dtypes)[passage_id]).alias(passage_id), id_col).limit(0)
    holds = F.contains(F.concat(F.lit(" "), "folded", F.lit(" ")), F.concat(F.lit(" "), "passage", F.lit(" ")))
    if measured["chars"] <= broadcast_chars:
        return runs.join(F.broadcast(items), "h").where(holds).select(passage_id, id_col).distinct()
    # A filter of the heads, of bounded size, goes to the texts first, so that hardly a hash is shuffled which no passage begins with.
    heads = items.select("h").distinct()
    begins = may_hold(heads, "h", filter_bits(heads.count()))
    met = runs.drop("folded").where(begins(F.col("h"))).join(items.select("h", passage_id), "h").select(passage_id, id_col).distinct()
    return met.join(docs, id_col).join(items.select(passage_id, "passage"), passage_id).where(holds).select(passage_id, id_col).distinct()


def gold_retention(corpus: DataFrame, golds: DataFrame, by: Sequence[str]) -> DataFrame:
    """By ``by`` and overall: texts, texts that hold any gold passage, distinct passages held, and the share of texts."""
    found = verbatim_passages(corpus, golds)
    per_doc = found.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    rows = corpus.select("doc_id", *by).join(per_doc, "doc_id", "left")
    exploded = rows.select("doc_id", *by, F.explode_outer("items").alias("item_id"))
    return exploded.groupingSets([[], list(by)], *by).agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("item_id").isNotNull(), F.col("doc_id"))).alias("n_hit"), F.countDistinct("item_id").alias("n_items")).withColumn("retention", _share(F.col("n_hit"), F.col("n_docs")))


def compactions_by_length(runs: DataFrame, by: Sequence[str] = ("length",)) -> DataFrame:
    """Runs, mean compaction events and the share of runs with any."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("compactions").alias("avg_compactions"), F.avg((F.col("compactions") > 0).cast("double")).alias("any_share"))


def context_groups(tasks: DataFrame, order: str = "ord", context_col: str = "context") -> DataFrame:
    """Adds context_hash, group (ordinal by first appearance), place (in the group) and group_size.

    Groups are numbered over one row for each context; the tasks' own rows are never sorted in one task.
    """
    hashed = tasks.withColumn("context_hash", T.context_hash(F.col(context_col)))
    groups = hashed.groupBy("context_hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    numbered = global_rank(groups, "first", "group").drop("first")
    place = F.row_number().over(Window.partitionBy("context_hash").orderBy(order))
    return hashed.withColumn("place", place).join(numbered, "context_hash")


def global_rank(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds a dense number from 1 by a unique ``order``: a range sort, a count a partition, a number within it."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from foliant.session import cut

    dealt = cut(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    counts, before = [], 0
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # at most n rows
        counts.append((r["__part"], before))
        before += r["count"]
    if not counts:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__part")
    base = F.element_at(F.create_map(*[F.lit(x) for p in counts for x in p]), F.col("__part"))
    return dealt.withColumn(name, (F.row_number().over(Window.partitionBy("__part").orderBy(order)) + base).cast("long")).drop("__part")


def call_metrics(calls: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per run and call kind, and per run: starts, token and duration sums, and whether a sub-call came without a start."""
    return calls.groupingSets([[run_col], [run_col, "kind"]], run_col, "kind").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("phase") == "start").alias("starts"), F.sum("tokens").alias("tokens"), F.sum("duration_s").alias("duration_s"),
        (F.count_if(F.col("phase") == "end") > F.count_if(F.col("phase") == "start")).alias("violation"),
    )
