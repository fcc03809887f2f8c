"""Registered queries: scoring and evaluation aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import scoring
from foliant.functions import text as T
from foliant.operators import evaluate as E
from foliant.operators.panel import example_rows, keep_last
from foliant.plans import views as V
from foliant.session import table


def gold_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gold_retention(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["lang"])


def passage_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verbatim_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_summary(V.runs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_score", "avg_score_all", "avg_duration", "accuracy", "accuracy_all", "parse_ok_rate", "contaminated_rate")})


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_stats(V.runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("accuracy_total", "accuracy_resolved", "accuracy_judged")})


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_counts(V.runs(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def best_and_worst_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = E.batch_stats(V.runs(spark, sf_dir), (("task",),))
    return E.best_and_worst(stats.withColumn("accuracy_resolved", F.round("accuracy_resolved", 6)), "task").select("end", "task", "accuracy_resolved", "n_resolved")


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.arm_summary(V.runs(spark, sf_dir), ["source_benchmark", "length"]).withColumns({"accuracy": F.round("accuracy", 6), "avg_score": F.round("avg_score", 6)})


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = keep_last(V.runs(spark, sf_dir).select("task", "arm", "run_id", "score", "correct", "model"), ["task", "arm"], "run_id")
    return E.paired_comparison(one, "click", "task", ["model"])


def batch_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.runs(spark, sf_dir)
    by = {f"b{k}": E.batch_stats(rows.where(F.col("source_benchmark") == f"b{k}"), (("model",),)).select("model", "n_total", "n_correct") for k in range(5)}
    return E.compare_batches(by, ["model"], ["n_total", "n_correct"])


def conversation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is what the assistant said last to be found in earlier turns' openings of 160 characters? Gold: the whole last turn."""
    rows = V.turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"]).alias("said"))
    runs = rows.select("conv_id", F.slice("said", F.lit(1), F.size("said") - 1).alias("turns"), F.element_at("said", -1).alias("gold_answer"), (F.size("said") % 2 == 0).alias("correct"), F.least(F.size("said"), F.lit(6)).alias("n_turns"))
    return E.retention(runs, ["n_turns"], 160).withColumns({c: F.round(c, 6) for c in ("retention", "accuracy", "gap_points")})


def judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.runs(spark, sf_dir)
    runs = rows.withColumn("task_id", F.col("run_id"))
    verdicts = rows.where("judge_equivalent is not null").select(F.col("run_id").alias("task_id"), "model", "harness", "condition", "judge_equivalent", F.col("ts").alias("ord"))
    return E.judge_summary(E.merge_verdicts(runs.drop("judge_equivalent"), verdicts)).withColumns({"accuracy": F.round("accuracy", 6), "judge_accuracy": F.round("judge_accuracy", 6)})


def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.context_statistics(V.contexts(spark, sf_dir), ["lang", "source"]).withColumn("avg_tokens", F.round("avg_tokens", 6))


def panel_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.composition(V.runs(spark, sf_dir), ["source_benchmark", "arm", "length"])


def compactions_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compactions_by_length(V.runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_compactions", "any_share")})


def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.context_groups(V.contexts(spark, sf_dir).withColumn("ord", F.col("context_id")), "ord", "text").select("context_id", "context_hash", "group", "place", "group_size")


def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = V.runs(spark, sf_dir).select(F.col("task").alias("run_id"), F.col("arm").alias("kind"), F.when(F.col("run_id") % 3 == 0, "end").otherwise("start").alias("phase"), F.col("compactions").alias("tokens"), "duration_s")
    return E.call_metrics(calls).withColumn("duration_s", F.round("duration_s", 4))


def exact_aggregate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.runs(spark, sf_dir).withColumn("kind", F.when(F.col("length").isin("128k", "256k"), "exact").otherwise("aggregate"))
    return E.exact_aggregate_ratio(rows).select(*[F.round(c, 6).alias(c) for c in ("exact_accuracy", "aggregate_accuracy", "ratio")])


def example_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_rows(V.runs(spark, sf_dir), "view", "purchase")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as answers to eleven kinds of question: the form of answer and gold follows the scorer."""
    e = table(spark, sf_dir, "events")
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    s, m, d = k.cast("string"), ((k + n % 3) % 100).cast("string"), F.lpad((1 + n % 28).cast("string"), 2, "0")
    names = list(scoring.SCORERS)
    forms = {
        "exact": (F.concat(F.lit(' "'), m, F.lit('" ')), s), "exact_ci": (F.concat(F.lit("K"), m), F.concat(F.lit("k"), s)), "substring_ci": (F.concat(F.lit("it is K"), m, F.lit(" then")), F.concat(F.lit("k"), s, F.lit(" "))),
        "multiple_choice": (F.concat(F.lit("I pick "), F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1)), F.lit(".")), F.substring(F.lit("abcd"), (k % 4 + 1).cast("int"), F.lit(1))),
        "csv_set_ci": (F.concat(F.lit("Apple, k"), m), F.concat(F.lit("K"), s, F.lit(",apple"))), "numeric_075": (F.concat(F.lit("Answer: "), m), s), "csv_overlap_ci": (F.concat(F.lit("k"), m, F.lit(", beta")), F.concat(F.lit("K"), s, F.lit(",Beta,gamma"))),
        "oolong_text_ci": (F.concat(F.lit("Label: [K"), m, F.lit("]")), F.concat(F.lit("*k"), s, F.lit("*"))), "oolong_comparison_ci": (F.when(n % 2 == 0, "Answer: x is more common than y").otherwise("the same frequency as z"), F.when(k % 2 == 0, "more common").otherwise("same frequency")),
        "date_ci": (F.concat(F.lit("Date: October "), (1 + n % 28).cast("string"), F.lit(", 2023")), F.concat(F.lit("2023-10-"), d)), "month_year_ci": (F.concat(F.lit("Answer: Oct "), (2020 + n % 3).cast("string")), F.concat(F.lit("October "), (2020 + k % 3).cast("string"))),
    }
    scorer = F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    pick = lambda j: F.coalesce(*[F.when(F.col("scorer") == x, forms[x][j]) for x in names])
    return e.withColumn("scorer", scorer).withColumns({"answer": pick(0), "gold_answer": pick(1)}).select("event_id", "scorer", "answer", "gold_answer")


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_runs(answers(spark, sf_dir)).select("event_id", "scorer", F.round("score", 6).alias("score"), "correct")


def relaxed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.sum(scoring.relaxed(F.col("answer"), F.col("gold_answer"))).alias("relaxed"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators.normalize import conversation_pairs

    return conversation_pairs(V.turns(spark, sf_dir), False).select("conv_id", "turn", F.col("question").alias("reference"), F.col("gold").alias("candidate"))


def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike are what users say and what they are told?"""
    return scoring.semantic_scores(_replies(spark, sf_dir)).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge_l", "bleu", "keywords", "combined")])


def answer_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers wrapped as models give them: last JSON object, or a last line."""
    raw = answers(spark, sf_dir).withColumn("raw", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('first {"answer": "no"} then '), F.to_json(F.struct("answer")), F.lit("\nend"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("thinking\n"), F.lit("Final answer: x"), F.col("event_id").cast("string"))).otherwise(F.lit("")))
    text, mode = T.answer_with_fallback(F.col("raw"))
    return raw.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.count_if(text == F.col("answer")).alias("n_same"), F.count_if(text == F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("n_line"))


def json_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as proofs in nested JSON whose quotes are looked for in what the assistant said."""
    t = V.turns(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    said = t.groupBy("conv_id").agg(listed.alias("t"))
    item = lambda x: F.struct(F.concat(F.lit("a source ] that is no quote: "), x["role"]).alias("source"), F.struct(F.concat(F.lit(" "), x["text"], F.lit("\n")).alias("quote"), F.array(F.lit("some other note")).alias("notes")).alias("found"))
    proof = F.to_json(F.struct(F.lit("an answer of some length").alias("answer"), F.transform("t", item).alias("evidence"), F.struct(F.transform("t", lambda x: F.array(F.concat(F.lit("again: "), x["text"]))).alias("citation_list")).alias("more")))
    contexts = said.select(F.col("conv_id").alias("context_id"), F.array_join(F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: x["text"]), " ").alias("text"))
    quotes = E.quotes_from_json(said.select(F.col("conv_id").alias("context_id"), proof.alias("proof")), keep=6)
    return E.verify_quotes(quotes, contexts).select("context_id", "ord", F.sha1(F.col("quote").cast("binary")).alias("quote_sha1"), "exact")


QUERIES = {
    f.__name__: f
    for f in (
        gold_retention, passage_quotes, json_quotes, run_summary, batch_stats, error_counts, best_and_worst_tasks, arm_summary, paired_arms, batch_comparison, conversation_retention, judge_merge, context_statistics,
        panel_composition, compactions_by_length, context_groups, call_metrics, exact_aggregate_ratio, example_triples, scored_answers, relaxed_scores, semantic_scores, answer_parsing,
    )
}

_R = f"WITH runs AS ({V.RUNS_SQL})"
_SAFE = lambda a, b: f"coalesce(round(({a})::DOUBLE / nullif({b}, 0), 6), 0)"
_FOLD = "trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))"

ORACLES = {
    "passage_quotes": f"SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {_FOLD} AS p FROM benchmark) b JOIN (SELECT doc_id, {_FOLD} AS t FROM documents) d ON p <> '' AND contains(' ' || t || ' ', ' ' || p || ' ')",
    "gold_retention": f"""
        WITH hit AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {_FOLD} AS p FROM benchmark) b JOIN (SELECT doc_id, {_FOLD} AS t FROM documents) d ON p <> '' AND contains(' ' || t || ' ', ' ' || p || ' ')),
        j AS (SELECT d.doc_id, lang, item_id FROM documents d LEFT JOIN hit USING (doc_id))
        SELECT lang, count(DISTINCT doc_id) AS n_docs, count(DISTINCT CASE WHEN item_id IS NOT NULL THEN doc_id END) AS n_hit, count(DISTINCT item_id) AS n_items,
          count(DISTINCT CASE WHEN item_id IS NOT NULL THEN doc_id END)::DOUBLE / count(DISTINCT doc_id) AS retention
        FROM j GROUP BY GROUPING SETS ((), (lang))""",
    "run_summary": f"""{_R}
        SELECT harness, model, "condition", source_benchmark, CASE WHEN grouping(source_benchmark) = 0 THEN 'source_benchmark' ELSE 'all' END AS level, count(*) AS n_total, count(*) FILTER (NOT contaminated) AS n_clean,
          count(*) FILTER (NOT contaminated AND correct) AS correct_clean, count(*) FILTER (correct) AS correct_all, coalesce(round(avg(score) FILTER (NOT contaminated), 6), 0) AS avg_score, round(avg(score), 6) AS avg_score_all,
          count(*) FILTER (parse_ok) AS parse_ok, count(*) FILTER (contaminated) AS contaminated, count(error) AS errors, sum(compactions)::BIGINT AS compaction_events, round(avg(duration_s), 6) AS avg_duration,
          {_SAFE("count(*) FILTER (NOT contaminated AND correct)", "count(*) FILTER (NOT contaminated)")} AS accuracy, {_SAFE("count(*) FILTER (correct)", "count(*)")} AS accuracy_all,
          {_SAFE("count(*) FILTER (parse_ok)", "count(*)")} AS parse_ok_rate, {_SAFE("count(*) FILTER (contaminated)", "count(*)")} AS contaminated_rate
        FROM runs GROUP BY GROUPING SETS ((harness, model, "condition"), (harness, model, "condition", source_benchmark))""",
    "batch_stats": f"""{_R}
        SELECT model, length, task, concat_ws(',', CASE WHEN grouping(model) = 0 THEN 'model' END, CASE WHEN grouping(length) = 0 THEN 'length' END, CASE WHEN grouping(task) = 0 THEN 'task' END) AS "set",
          count(*) AS n_total, count(*) FILTER (error IS NULL) AS n_resolved, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct OR coalesce(judge_equivalent, false)) AS n_correct_judged,
          sum(compactions)::BIGINT AS compactions, count(*) FILTER (compactions > 0) AS n_compacted, {_SAFE("count(*) FILTER (correct)", "count(*)")} AS accuracy_total,
          {_SAFE("count(*) FILTER (correct)", "count(*) FILTER (error IS NULL)")} AS accuracy_resolved, {_SAFE("count(*) FILTER (correct OR coalesce(judge_equivalent, false))", "count(*) FILTER (error IS NULL)")} AS accuracy_judged
        FROM runs GROUP BY GROUPING SETS ((), (model), (model, length), (model, task), (length), (task))""",
    "error_counts": f"""{_R}
        SELECT CASE WHEN error IS NULL THEN CASE WHEN parse_ok THEN 'none' ELSE 'parse_only' END WHEN error LIKE '%usage limit%' THEN 'usage_limit' WHEN error LIKE '%401%' THEN 'auth' WHEN error LIKE '%timed out%' THEN 'timeout' ELSE 'runtime_error' END AS error_category,
          count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM runs), 6) AS rate FROM runs GROUP BY 1""",
    "best_and_worst_tasks": f"""{_R}, s AS (SELECT task, {_SAFE("count(*) FILTER (correct)", "count(*) FILTER (error IS NULL)")} AS accuracy_resolved, count(*) FILTER (error IS NULL) AS n_resolved FROM runs GROUP BY 1)
        SELECT * FROM (SELECT 'best' AS "end", * FROM s ORDER BY accuracy_resolved DESC, n_resolved DESC, task LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS "end", * FROM s ORDER BY accuracy_resolved, n_resolved, task LIMIT 5)""",
    "arm_summary": f"""{_R}
        SELECT arm, CASE WHEN grouping(source_benchmark) = 0 THEN 'source_benchmark' WHEN grouping(length) = 0 THEN 'length' ELSE 'all' END AS detail, coalesce(source_benchmark, length) AS value, count(*) AS n,
          count(*) FILTER (error IS NULL) AS n_resolved, count(*) FILTER (correct) AS n_correct, {_SAFE("count(*) FILTER (correct)", "count(*)")} AS accuracy, round(avg(score), 6) AS avg_score
        FROM runs GROUP BY GROUPING SETS ((arm), (arm, source_benchmark), (arm, length))""",
    "paired_arms": f"""{_R}, one AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY task, arm ORDER BY run_id DESC) = 1),
        p AS (SELECT b.model, o.arm, b.score AS bs, o.score AS os, b.correct AS bc, o.correct AS oc FROM one b JOIN one o USING (task) WHERE b.arm = 'click' AND o.arm <> 'click')
        SELECT arm, model, count(*) AS n_pairs, count(*) FILTER (bs > os) AS wins, count(*) FILTER (bs < os) AS losses, count(*) FILTER (bs = os) AS ties, count(*) FILTER (bc AND oc) AS both, count(*) FILTER (bc AND NOT oc) AS base_only,
          count(*) FILTER (NOT bc AND oc) AS other_only, count(*) FILTER (NOT bc AND NOT oc) AS neither, 'click' AS base FROM p GROUP BY GROUPING SETS ((arm), (arm, model))""",
    "batch_comparison": f"{_R} SELECT model, " + ", ".join(f"count(*) FILTER (source_benchmark = 'b{k}') AS b{k}_n_total, count(*) FILTER (source_benchmark = 'b{k}' AND correct) AS b{k}_n_correct" for k in range(5)) + " FROM runs GROUP BY 1",
    "conversation_retention": """
        WITH g AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS said FROM conversations GROUP BY 1),
        r AS (SELECT least(len(said), 6) AS n_turns, lower(said[-1]) AS gold, said[1:len(said) - 1] AS t, len(said) % 2 = 0 AS correct FROM g),
        k AS (SELECT *, length(gold) > 0 AND len(list_filter(t, lambda x: contains(lower(x[1:160]), gold))) > 0 AS kept FROM r)
        SELECT n_turns, count(*) AS n, count(*) FILTER (kept) AS n_retained, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (kept)::DOUBLE / count(*), 6) AS retention, round(count(*) FILTER (correct)::DOUBLE / count(*), 6) AS accuracy,
          round(100 * (count(*) FILTER (kept)::DOUBLE / count(*) - count(*) FILTER (correct)::DOUBLE / count(*)), 6) AS gap_points FROM k GROUP BY 1""",
    "judge_merge": f"""{_R}, m AS (SELECT *, NOT correct AND parse_ok AND NOT contaminated AND length(answer) > 0 AND judge_equivalent IS NOT NULL AS applied FROM runs)
        SELECT harness, model, "condition", count(*) AS n, count(*) FILTER (applied) AS n_judged, round(avg(correct::INT), 6) AS accuracy, round(avg((correct OR (applied AND judge_equivalent))::INT), 6) AS judge_accuracy,
          count(*) FILTER (applied AND judge_equivalent AND NOT correct) AS overturns FROM m GROUP BY ALL""",
    "context_statistics": "SELECT lang, source, count(*) AS n, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 6) AS avg_tokens, sum(t)::BIGINT AS total_tokens FROM (SELECT lang, source, greatest(1, length(text) // 4) AS t FROM documents) GROUP BY ALL",
    "panel_composition": f"""{_R} SELECT CASE WHEN grouping(source_benchmark) = 0 THEN 'source_benchmark' WHEN grouping(arm) = 0 THEN 'arm' WHEN grouping(length) = 0 THEN 'length' ELSE 'all' END AS detail, coalesce(source_benchmark, arm, length) AS value, count(*) AS n
        FROM runs GROUP BY GROUPING SETS ((), (source_benchmark), (arm), (length))""",
    "compactions_by_length": f"{_R} SELECT length, count(*) AS n, round(avg(compactions), 6) AS avg_compactions, round(avg((compactions > 0)::INT), 6) AS any_share FROM runs GROUP BY 1",
    "context_groups": """
        WITH h AS (SELECT doc_id AS context_id, substring(sha1(text), 1, 16) AS context_hash FROM documents), g AS (SELECT *, min(context_id) OVER (PARTITION BY context_hash) AS first, count(*) OVER (PARTITION BY context_hash) AS group_size FROM h)
        SELECT context_id, context_hash, dense_rank() OVER (ORDER BY first) AS "group", row_number() OVER (PARTITION BY context_hash ORDER BY context_id) AS place, group_size FROM g""",
    "call_metrics": f"""{_R} SELECT task AS run_id, arm AS kind, count(*) AS events, count(*) FILTER (run_id % 3 <> 0) AS starts, sum(compactions)::BIGINT AS tokens, round(sum(duration_s), 4) AS duration_s,
        count(*) FILTER (run_id % 3 = 0) > count(*) FILTER (run_id % 3 <> 0) AS violation FROM runs GROUP BY GROUPING SETS ((task), (task, arm))""",
    "exact_aggregate_ratio": f"""{_R}, a AS (SELECT avg(correct::INT) FILTER (length IN ('128k', '256k')) AS e, avg(correct::INT) FILTER (length NOT IN ('128k', '256k')) AS g FROM runs)
        SELECT round(e, 6) AS exact_accuracy, round(g, 6) AS aggregate_accuracy, round(e / greatest(g, 0.001), 6) AS ratio FROM a""",
    "example_triples": f"""{_R}, w AS (SELECT task, bool_or(correct) FILTER (arm = 'view') AS t, bool_or(correct) FILTER (arm = 'purchase') AS o, bool_or(relaxed) FILTER (arm = 'view') AS tr FROM runs GROUP BY 1)
        SELECT class, task FROM (SELECT task, CASE WHEN t AND NOT o THEN 'target_only' WHEN NOT t AND o THEN 'other_only' WHEN NOT t AND tr THEN 'formatting' END AS class FROM w WHERE t IS NOT NULL AND o IS NOT NULL)
        WHERE class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY class ORDER BY task) <= 4""",
    "scored_answers": """
        WITH e AS (SELECT event_id, event_id % 11 AS j, json_extract_string(props, '$.k')::BIGINT AS k, (json_extract_string(props, '$.k')::BIGINT + event_id % 3) % 100 AS m FROM events),
        s AS (SELECT event_id, ['exact', 'exact_ci', 'substring_ci', 'multiple_choice', 'csv_set_ci', 'numeric_075', 'csv_overlap_ci', 'oolong_text_ci', 'oolong_comparison_ci', 'date_ci', 'month_year_ci'][j + 1] AS scorer,
          CASE WHEN j IN (0, 1, 4, 7) THEN (k = m)::INT::DOUBLE WHEN j = 2 THEN contains(m::VARCHAR, k::VARCHAR)::INT * (starts_with(m::VARCHAR, k::VARCHAR))::INT::DOUBLE WHEN j = 3 THEN (event_id % 4 = k % 4)::INT::DOUBLE WHEN j = 5 THEN pow(0.75, abs(k - m))
            WHEN j = 6 THEN (1 + (k = m)::INT) / 3.0 WHEN j = 8 THEN (event_id % 2 = k % 2)::INT::DOUBLE WHEN j = 9 THEN 1.0 ELSE (event_id % 3 = k % 3)::INT::DOUBLE END AS score FROM e)
        SELECT event_id, scorer, round(score::DOUBLE, 6) AS score, score >= 1 AS correct FROM s""",
    "answer_parsing": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'text_fallback' ELSE 'empty' END AS mode, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS n_same, count(*) FILTER (event_id % 3 = 1) AS n_line FROM events GROUP BY 1""",
    # Of these answers, lists, dates and months are never contained in one another; k and m are equal for every third event.
    "relaxed_scores": """
        WITH e AS (SELECT event_id AS n, event_id % 11 AS j, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
        SELECT ['exact', 'exact_ci', 'substring_ci', 'multiple_choice', 'csv_set_ci', 'numeric_075', 'csv_overlap_ci', 'oolong_text_ci', 'oolong_comparison_ci', 'date_ci', 'month_year_ci'][j + 1] AS scorer, count(*) AS n,
          sum(CASE WHEN j IN (0, 1, 5, 7) THEN n % 3 = 0 WHEN j = 2 THEN n % 3 = 0 AND k >= 10 WHEN j = 3 THEN n % 4 = k % 4 WHEN j = 8 THEN n % 2 = k % 2 ELSE false END::INT)::DOUBLE AS relaxed FROM e GROUP BY j""",
}
_CUT = lambda c: f"regexp_replace({c}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
ORACLES["json_quotes"] = f"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    q AS (SELECT conv_id, 0 AS part, turn, role, text, {_CUT("text")} AS s FROM t UNION ALL SELECT conv_id, 1, turn, role, text, {_CUT("'again: ' || text")} FROM t),
    f AS (SELECT conv_id, s, min((part, turn, role, text)) AS place FROM q WHERE length(s) BETWEEN 8 AND 2000 GROUP BY ALL),
    r AS (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS ord FROM f),
    c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS ctx FROM t GROUP BY 1)
    SELECT conv_id AS context_id, ord, sha1(s) AS quote_sha1, contains(ctx, s) AS exact FROM r JOIN c USING (conv_id) WHERE ord < 6"""
