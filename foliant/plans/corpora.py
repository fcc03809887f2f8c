"""Registered queries: raw corpora, as the given tables make them up, normalised into tasks; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import normalize as N
from foliant.operators import retrieve as R
from foliant.operators import story as S
from foliant.plans import views as V
from foliant.plans.memory import _events, _story
from foliant.session import table

_KEY = ("task_id", "source_task", "gold_answer", "scorer")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def needle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 2 == 0, "niah_single_1").otherwise("vt").alias("task"), F.col("n_chars").alias("length"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\nQuestion: what is "), F.col("doc_id").cast("string"), F.lit("? ")).alias("input"), F.array("lang", "source").alias("outputs"),
    )
    return N.needle_tasks(raw, min_length=100).select(*_KEY, "question", F.sha1(F.col("context").cast("binary")).alias("context_sha1"), F.array_join("gold_answer_aliases", ",").alias("aliases"))


def story_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, "qa8").otherwise("qa1").alias("task"), F.col("text").alias("input"), F.lit("Where?").alias("question"), F.col("lang").alias("target"), F.col("doc_id").cast("string").alias("id"))
    return N.story_tasks(raw).select(*_KEY)


def synthetic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("LABEL", "NUMERIC", "COMPARISON", "DATE", "MONTH_YEAR")
    answer = F.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("[datetime.date(2023, 1, "), (1 + F.col("doc_id") % 28).cast("string"), F.lit(")]"))).otherwise(F.concat(F.lit("['a"), F.col("doc_id").cast("string"), F.lit("']")))
    raw = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("int").alias("context_len"), F.col("lang").alias("dataset"), F.col("source").alias("task_group"), F.lit("count").alias("task"), F.col("text").alias("context_window_text"), F.lit("q").alias("question"), answer.alias("answer"), F.concat(F.lit("ANSWER_TYPE."), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("answer_type"))
    return N.synthetic_aggregation_tasks(raw, min_length=200, max_length=5000, datasets=["en", "de"]).select(*_KEY)


def real_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "a, b").otherwise("word")
    raw = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("context_window_text"), F.lit("q").alias("question"), answer.alias("answer"), F.col("lang").alias("question_type"), F.lit("['x', 'y']").alias("episodes"), F.col("source").alias("campaign"))
    return N.real_aggregation_tasks(raw, ["en", "fr"]).select(*_KEY, F.get_json_object("metadata", "$.episodes").cast("int").alias("episodes"))


#: As many questions of a type as there are.
EVERY = 2**31 - 1


def memory_question_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions whose haystacks are documents; every third trajectory is missing."""
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("t"), (F.col("item_id") % 4).cast("string")).alias("question_type"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "a, b").otherwise("300").alias("answer"), F.lit("d").alias("domain"), F.lit("e").alias("environment"))
    haystack = items.select(F.col("item_id").cast("string").alias("question_id"), F.posexplode(F.array(F.col("item_id"), F.col("item_id") + 7, F.col("item_id") + 1_000_000_000)).alias("pos", "t")).select("question_id", "pos", F.col("t").cast("string").alias("traj_id"))
    rendered = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("traj_id"), F.coalesce("text", F.lit("")).alias("rendered"))
    out = N.memory_questions(questions, haystack, rendered, EVERY)
    return out.select(*_KEY, F.sha1(F.col("context").cast("binary")).alias("context_sha1"), F.get_json_object("metadata", "$.missing").cast("int").alias("missing"))


def rendered_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trajectories of states, the middle left out."""
    state = F.struct(F.col("turn").alias("state_index"), F.lit("u").alias("url"), F.col("text").alias("thought"), F.col("role").alias("action"), F.lit("").alias("accessibility_tree"))
    rows = V.turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("traj_id")).agg(F.sort_array(F.collect_list(state)).alias("states")).withColumns({c: F.lit(c) for c in ("domain", "environment", "goal", "outcome", "start_url")})
    shown = N.render_trajectories(rows)
    return shown.select("traj_id", F.regexp_count("rendered", F.lit(r"\[state \d+\]")).alias("n_states"), F.coalesce(F.regexp_extract("rendered", r"… (\d+) intermediate", 1).try_cast("int"), F.lit(0)).alias("n_omitted"))


def episode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("repo"), F.col("doc_id").alias("sequence_rank"), F.coalesce("text", F.lit("")).alias("patch"), F.split(F.coalesce("text", F.lit("")), "\n").alias("tests"), F.col("doc_id").cast("string").alias("instance_id"), F.col("lang").alias("problem"))
    return N.episode_pairs(rows).select("repo", "sequence_rank", "task", "question", F.length("context_patch").alias("patch_chars"), F.size("context_tests").alias("n_tests"), F.sha1(F.col("gold").cast("binary")).alias("gold_sha1"))


def expanding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("ord"), F.col("event_type").alias("id"), F.col("user_id").alias("value"))
    return N.expanding_history(rows, 5)


def sliding_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as scans whose peaks are users' event counts: how many lines of past and future each episode has."""
    per_day = table(spark, sf_dir, "events").groupBy(F.datediff("ts", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ord"), (F.col("user_id") % 5).alias("freq")).agg(F.count(F.lit(1)).alias("power"))
    scans = per_day.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("freq", "power"))).alias("peaks"))
    out = N.sliding_scans(scans)
    lines = lambda c: F.size(F.split(c, "\n"))
    return out.select("episode", lines("history").alias("n_history"), lines("future").alias("n_future"), F.substring("future", 1, 20).alias("next"))


def story_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each story that bear on a question, the 220 best."""
    story = _story(spark, sf_dir)
    asked = story.select(F.col("context_id").cast("string").alias("context_id"), F.col("context_id").alias("question_id"), F.lit("Where was Mary before the kitchen with the milk?").alias("question")).distinct()
    return R.fact_evidence(story, asked, 220, part_col="event_id")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of turns around the words of a conversation's first question and their relatives."""
    domain = spark.createDataFrame([("the", ["that", "this"]), ("der", ["die", "das"])], "term string, expansions array<string>")
    return R.event_windows(V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir), domain).select("question_id", "page_id", "score", F.length("window").alias("chars"))


def story_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    asked = events.select("context_id").distinct().select(F.col("context_id").alias("question_id"), "context_id", F.lit("Where is Mary?").alias("question"))
    return S.trace_tier(events, asked, 40).select("question_id", "kind", "text").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (needle_tasks, story_tasks, synthetic_tasks, real_tasks, memory_question_tasks, rendered_trajectories, episode_pairs, expanding_history, sliding_scans, story_evidence, event_windows, story_trace)}

_STRIP = lambda c: f"regexp_replace({c}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"

ORACLES = {
    "needle_tasks": f"""SELECT concat('ruler-', t, '-', doc_id) AS task_id, t AS source_task, lang AS gold_answer, CASE WHEN t = 'vt' THEN 'csv_set_ci' ELSE 'substring_ci' END AS scorer, 'what is ' || doc_id || '?' AS question, sha1({_STRIP("text")}) AS context_sha1, source AS aliases
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'niah_single_1' ELSE 'vt' END AS t FROM documents) WHERE n_chars >= 100""",
    "story_tasks": f"SELECT concat('babilong-', t, '-', doc_id) AS task_id, t AS source_task, lang AS gold_answer, CASE WHEN t = 'qa8' THEN 'csv_set_ci' ELSE 'exact_ci' END AS scorer FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'qa8' ELSE 'qa1' END AS t FROM documents) WHERE {_STRIP('text')} <> ''",
    "synthetic_tasks": """SELECT concat('oolong_synth-count-', doc_id) AS task_id, 'count' AS source_task, CASE WHEN doc_id % 5 = 3 THEN '2023-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') ELSE 'a' || doc_id END AS gold_answer,
        ['oolong_text_ci', 'numeric_075', 'oolong_comparison_ci', 'date_ci', 'month_year_ci'][doc_id % 5 + 1] AS scorer FROM documents WHERE n_chars BETWEEN 200 AND 5000 AND lang IN ('en', 'de')""",
    "real_tasks": """SELECT concat('oolong_real-', lang, '-', doc_id) AS task_id, lang AS source_task, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'a, b' ELSE 'word' END AS gold_answer,
        CASE doc_id % 3 WHEN 0 THEN 'numeric_075' WHEN 1 THEN 'csv_overlap_ci' ELSE 'oolong_text_ci' END AS scorer, 2 AS episodes FROM documents WHERE lang IN ('en', 'fr')""",
    "memory_question_tasks": """
        WITH q AS (SELECT *, 't' || item_id % 4 AS t FROM benchmark),
        c AS (SELECT item_id, string_agg(d.text, chr(10) || chr(10) ORDER BY d.doc_id) AS ctx, count(d.doc_id) AS n FROM q LEFT JOIN documents d ON d.doc_id IN (item_id, item_id + 7, item_id + 1000000000) GROUP BY 1)
        SELECT concat('longmemeval-', t, '-', item_id) AS task_id, t AS source_task, CASE WHEN item_id % 2 = 0 THEN 'a, b' ELSE '300' END AS gold_answer,
          CASE WHEN item_id % 2 = 1 THEN 'exact_ci' WHEN contains(lower(text), 'ordered') THEN 'substring_ci' ELSE 'csv_set_ci' END AS scorer, sha1(coalesce(ctx, '')) AS context_sha1, 3 - n AS missing FROM q JOIN c USING (item_id)""",
    "rendered_trajectories": "SELECT conv_id::VARCHAR AS traj_id, least(4, count(*)) AS n_states, greatest(0, count(*) - 4) AS n_omitted FROM conversations GROUP BY conv_id",
    "episode_pairs": """SELECT repo, sequence_rank, task, question, patch_chars, n_tests, gold_sha1 FROM (SELECT source AS repo, doc_id AS sequence_rank, lead(doc_id) OVER w::VARCHAR AS task, lead(lang) OVER w AS question, least(4000, length(coalesce(text, ''))) AS patch_chars,
        least(5, len(string_split(coalesce(text, ''), chr(10)))) AS n_tests, sha1(lead(coalesce(text, '')) OVER w) AS gold_sha1 FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE task IS NOT NULL""".replace("lead(doc_id) OVER w::VARCHAR", "(lead(doc_id) OVER w)::VARCHAR"),
    "expanding_history": """
        WITH r AS (SELECT event_id + 1 AS ord, event_type AS id, user_id AS value FROM events), k AS (SELECT greatest(1, count(*) // 5) AS per FROM r), e AS (SELECT unnest(range(1, 6)) AS episode)
        SELECT episode, (SELECT string_agg(id || ',' || value, chr(10) ORDER BY ord) FROM r WHERE ord <= 500 AND ord <= episode * per) AS context, string_agg(id || ',' || value, chr(10) ORDER BY ord) AS gold, string_agg(id, ', ' ORDER BY ord) AS question
        FROM e, k JOIN r ON r.ord > episode * per AND r.ord <= episode * per + 10 GROUP BY episode, per""",
    "story_trace": f"WITH m AS ({V.MOVE_SQL}) SELECT context_id::VARCHAR AS question_id, least(40, CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (hit) ELSE count(*) END) AS n FROM (SELECT *, person = 'Mary' OR (kind = 'transfer' AND target = 'Mary') AS hit FROM m) GROUP BY 1",
}
ORACLES["sliding_scans"] = """
    WITH d AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS ord, user_id % 5 AS freq, count(*) AS power FROM events GROUP BY ALL), s AS (SELECT ord, string_agg(printf('%.2f MHz@%.1f dBm', freq::DOUBLE, power::DOUBLE), '; ' ORDER BY freq, power) AS line FROM d GROUP BY 1),
    e AS (SELECT unnest(range(0, (SELECT max(ord) FROM s) + 1, 10)) AS episode)
    SELECT episode, count(*) FILTER (ord <= episode + 9) AS n_history, count(*) FILTER (ord > episode + 9) AS n_future, substring(string_agg(line, chr(10) ORDER BY ord) FILTER (ord > episode + 9), 1, 20) AS next
    FROM e JOIN s ON ord <= episode + 14 GROUP BY 1 HAVING n_history > 0 AND n_future > 0"""
ORACLES["story_evidence"] = f"""
    WITH m AS ({V.MOVE_SQL}), t AS (SELECT context_id, event_id, kind, CASE kind WHEN 'movement' THEN concat(person, ' went to the ', place, '.') WHEN 'pickup' THEN concat(person, ' picked up the ', thing, '.') WHEN 'drop' THEN concat(person, ' dropped the ', thing, '.') ELSE concat(person, ' handed the ', thing, ' to ', target, '.') END AS text FROM m),
    o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY context_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM t),
    s AS (SELECT context_id AS question_id, position, kind, text, 20 + 10 * contains(text, 'Mary')::INT + 9 * contains(text, 'kitchen')::INT + 9 * contains(text, 'milk')::INT AS score FROM o)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position) <= 220"""
