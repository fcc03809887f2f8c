"""Registered queries: column expressions and small operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import evaluate as E
from foliant.operators import normalize as N
from foliant.operators import panel as P
from foliant.operators import retrieve as R
from foliant.plans import texts
from foliant.plans import views as V
from foliant.session import table


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised runs and entities of what is said in conversations."""
    t = F.coalesce("text", F.lit(""))
    return V.turns(spark, sf_dir).select("conv_id", "turn", F.array_join(T.capitalised_terms(t), "|").alias("terms"), F.array_join(T.focus_entities(t), "|").alias("entities"))


def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn with their light variants."""
    terms = T.without(T.tokens(F.coalesce("text", F.lit(""))), T.STOP_QUESTION)
    return V.turns(spark, sf_dir).select("conv_id", "turn", F.sha1(F.array_join(T.morph_variants(terms), " ").cast("binary")).alias("sha1"), F.size(T.morph_variants(terms)).alias("n"))


def reply_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard likeness of the words of what users say and what they are told."""
    words = lambda c: F.array_distinct(T.tokens(F.coalesce(c, F.lit(""))))
    return N.conversation_pairs(V.turns(spark, sf_dir), False).select("conv_id", "turn", F.round(T.jaccard(words("question"), words("gold")), 6).alias("likeness"))


def code_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as finalising code of two forms, or none."""
    n, v = F.col("event_id"), F.col("event_type")
    raw = F.when(n % 3 == 0, F.concat(F.lit("x = 1\nanswer['content'] = '"), v, F.lit("'\nanswer['ready'] = True"))).when(n % 3 == 1, F.concat(F.lit('done\nsubmit_answer( "'), v, F.lit('" )'))).otherwise(F.concat(F.lit("print("), v, F.lit(")")))
    return table(spark, sf_dir, "events").select("event_id", T.code_answer(raw).alias("answer"))


def length_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context lengths as task ids tell them."""
    ident = F.concat(F.lit("babilong-"), F.when(F.col("event_id") % 4 == 0, "qa1").otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("128k", "1M", "50ep")]), (F.col("event_id") % 4).cast("int")), F.lit("-qa1"))), F.lit("-"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy(T.length_label(ident).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as what judges say: JSON, JSON that is cut off, and prose."""
    n, yes = F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    raw = (
        F.when(n % 4 == 0, F.concat(F.lit('{"equivalent": false} no: {"equivalent": '), yes, F.lit(', "why": "x"} {broken}')))
        .when(n % 4 == 1, F.concat(F.lit('{"why": "a", "Equivalent" : '), yes)).when(n % 4 == 2, F.concat(F.lit('{"a": 1} {"equivalent": "'), yes, F.lit('"}'))).otherwise(F.lit("it may be so"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.size(T.json_objects(raw)).alias("n_objects"), T.judge_verdict(raw).alias("verdict"))


def turn_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spaced turns of each conversation as lines of a page table."""
    pages = V.turn_pages(spark, sf_dir).withColumns({"tokens_est": T.tokens_est(F.col("text")), "preview": T.preview(F.col("text"), 60)})
    return R.page_table(pages, 4)


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs whose metadata hold arm, task and evidence under several names, or not at all."""
    n = F.col("run_id")
    meta = F.when(n % 3 == 0, F.to_json(F.struct(F.col("model").alias("arm"), F.struct(n.alias("evidence_tokens_est")).alias("packet")))).when(n % 3 == 1, F.to_json(F.struct(F.struct(F.col("task").cast("string").alias("original_task_id")).alias("task"), F.struct((n * 2).alias("evidence_tokens_est")).alias("virtual_context")))).otherwise("{}")
    runs = V.runs(spark, sf_dir).select("run_id", "condition", n.cast("string").alias("task_id"), meta.alias("metadata"))
    return E.flatten_runs(runs).select("run_id", "arm", "original_task_id", "evidence_tokens")


def sampled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven runs of each benchmark, as a manifest shows them."""
    return P.sampled_manifest(V.runs(spark, sf_dir), "source_benchmark", ["run_id"], 7, ("run_id", "task", "arm"))


def database_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions to a database."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Brand of "), "p_name", F.lit("?")).alias("question"), F.col("p_brand").alias("answer"))
    return N.schema_tasks(asked, "part(p_partkey, p_name, p_brand)").select("task_id", "context", "question", "gold_answer", "scorer", F.get_json_object("metadata", "$.family").alias("family"))


def order_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as studies whose orders' dates and states are two lists joined by position."""
    by = F.sort_array(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("s"))))
    studies = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("study_id")).agg(by.alias("o")).select("study_id", F.col("o.d").alias("metadata"), F.col("o.s").alias("truth"))
    return N.cohort_tasks(studies).select("study_id", "pos", "metadata", "truth")


def relabelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs under new ids with one field of their metadata replaced and one added; every fourth has none."""
    n = F.col("run_id")
    runs = V.runs(spark, sf_dir).select("run_id", F.concat(F.lit("t-"), n.cast("string")).alias("task_id"), F.when(n % 4 > 0, F.to_json(F.struct("arm", "length"))).alias("metadata"))
    field = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    return N.relabel(runs, "--again", {"arm": "control", "pass": "2"}).select("run_id", "task_id", field("arm"), field("length"), field("pass"))


QUERIES = {f.__name__: f for f in (question_terms, term_variants, reply_likeness, code_answers, length_labels, judge_verdicts, turn_tables, run_metadata, sampled_runs, database_tasks, order_cohorts, relabelled_runs)}

_STOP = "'" + "','".join(T.STOP_QUESTION) + "'"
_TOK = texts._TOK
_VARIANTS = "CASE WHEN length(x) < 3 THEN [x] ELSE [x, CASE WHEN x LIKE '%s' THEN x[:-2] ELSE x || 's' END, CASE WHEN x NOT LIKE '%ed' THEN x || 'ed' END, CASE WHEN x NOT LIKE '%ing' THEN x || 'ing' END] END"
#: First seen first, without repeats.
_FIRST = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"

ORACLES = {
    # Letters beyond ASCII are word characters, though no part of terms: any other word character stands for them.
    "question_terms": f"""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g') AS text FROM conversations), f AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '\\b[A-Z][A-Za-z''’]*(?:\\s+[A-Z][A-Za-z''’]*){{0,3}}\\b'), lambda x: lower(x) NOT IN ({_STOP})) AS a,
          list_filter(list_transform(regexp_extract_all(text, '\\b[A-Z][a-z]+\\b'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS b FROM c)
        SELECT conv_id, turn, array_to_string({_FIRST("a")}, '|') AS terms, array_to_string({_FIRST("b")}, '|') AS entities FROM f""",
    "term_variants": f"""WITH w AS (SELECT conv_id, turn, list_filter(flatten(list_transform(list_filter({_TOK("coalesce(text, '')")}, lambda x: x NOT IN ({_STOP})), lambda x: {_VARIANTS})), lambda x: x IS NOT NULL AND x <> '') AS v FROM conversations)
        SELECT conv_id, turn, sha1(array_to_string({_FIRST("v")}, ' ')) AS sha1, len(list_distinct(v)) AS n FROM w""",
    "reply_likeness": f"""{texts._PAIRS}, w AS (SELECT conv_id, turn, list_distinct({_TOK("coalesce(text, '')")}) AS a, list_distinct({_TOK("substring(coalesce(gold, ''), 1, 4000)")}) AS b FROM p)
        SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 6) END AS likeness FROM w""",
    "code_answers": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS answer FROM events",
    "length_labels": "SELECT CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '128k' WHEN 2 THEN '1M' ELSE '50ep' END AS length, count(*) AS n FROM events GROUP BY 1",
    "judge_verdicts": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 0 END AS n_objects, CASE WHEN event_id % 4 < 3 THEN event_id % 2 = 0 END AS verdict FROM events",
    "turn_tables": r"""WITH p AS (SELECT conv_id AS context_id, turn + 1 AS page_id, coalesce(text, '') AS t, max(turn + 1) OVER (PARTITION BY conv_id) AS n FROM conversations), f AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS l FROM p),
        k AS (SELECT context_id, page_id, concat(page_id, ' | 1-', 1 + length(t) - length(replace(t, chr(10), '')), ' | ', greatest(1, length(t) // 4), ' | ', CASE WHEN length(l) <= 60 THEN l ELSE rtrim(substring(l, 1, 59)) || '…' END) AS line
          FROM f WHERE n <= 4 OR page_id IN (1, round_even((n - 1) / 3.0, 0)::INT + 1, round_even(2 * (n - 1) / 3.0, 0)::INT + 1, n))
        SELECT context_id, string_agg(line, chr(10) ORDER BY page_id) AS "table" FROM k GROUP BY 1""",
    "run_metadata": f"""WITH runs AS ({V.RUNS_SQL}) SELECT run_id, CASE WHEN run_id % 3 = 0 THEN model ELSE "condition" END AS arm, CASE WHEN run_id % 3 = 1 THEN task ELSE run_id END::VARCHAR AS original_task_id, CASE run_id % 3 WHEN 0 THEN run_id WHEN 1 THEN 2 * run_id ELSE 0 END AS evidence_tokens FROM runs""",
    "sampled_runs": f"WITH runs AS ({V.RUNS_SQL}) SELECT source_benchmark, run_id, task, arm FROM runs QUALIFY row_number() OVER (PARTITION BY source_benchmark ORDER BY run_id) <= 7",
    "database_tasks": "SELECT 'clb-database-' || p_partkey AS task_id, 'part(p_partkey, p_name, p_brand)' AS context, 'Brand of ' || p_name || '?' AS question, p_brand AS gold_answer, 'substring_ci' AS scorer, 'database' AS family FROM part",
    "order_cohorts": "SELECT o_custkey AS study_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, strftime(o_orderdate, '%Y-%m-%d') AS metadata, o_orderstatus AS truth FROM orders",
    "relabelled_runs": f"WITH runs AS ({V.RUNS_SQL}) SELECT run_id, concat('t-', run_id, '--again') AS task_id, 'control' AS arm, CASE WHEN run_id % 4 > 0 THEN length END AS length, '2' AS pass FROM runs",
}
