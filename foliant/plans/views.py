"""Views over the given tables that the registered queries share, each also as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.session import table

_RUNS = """
    SELECT event_id AS run_id, user_id AS task, event_type AS arm, concat('h', user_id % 3) AS harness, concat('m', user_id % 4) AS model, event_type AS `condition`,
      concat('b', event_id % 5) AS source_benchmark, CASE CAST(JSON AS INT) % 4 WHEN 0 THEN '128k' WHEN 1 THEN '256k' WHEN 2 THEN '512k' ELSE '1M' END AS length,
      (event_id % 5) / 4.0E0 AS score, event_id % 5 = 4 AS correct, event_id % 5 >= 3 AS relaxed, event_id % 7 <> 0 AS parse_ok, event_id % 11 = 0 AS contaminated,
      CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'usage limit reached' WHEN 1 THEN 'HTTP 401' WHEN 2 THEN 'request timed out' ELSE 'boom' END END AS error,
      CAST(JSON AS INT) % 3 AS compactions, value AS duration_s, CASE WHEN event_id % 13 = 0 THEN event_id % 2 = 0 END AS judge_equivalent,
      CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('a', event_id) END AS answer, ts
    FROM events
"""
_MEM = """
    SELECT user_id AS context_id, -CAST(DATEDIFF AS INT) AS day, concat('e', LPAD) AS event_id, CASE event_type WHEN 'click' THEN 'meal' WHEN 'view' THEN 'preference' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'profile' ELSE 'note' END AS kind,
      CASE WHEN event_type = 'click' THEN 'dinner' WHEN event_type = 'view' AND CAST(JSON AS INT) % 2 = 0 THEN 'tea' ELSE concat('k', CAST(JSON AS INT) % 5) END AS key,
      concat('v', CAST(JSON AS INT) % 7) AS value, CAST(event_id % 4 AS INT) AS importance, concat('note ', event_id % 10) AS text
    FROM events
"""
_MOVE = """
    SELECT user_id AS context_id, event_id, CASE event_id % 8 WHEN 0 THEN 'Mary' WHEN 1 THEN 'John' WHEN 2 THEN 'Sandra' WHEN 3 THEN 'Daniel' WHEN 4 THEN 'Fred' WHEN 5 THEN 'Bill' WHEN 6 THEN 'Jeff' ELSE 'Julie' END AS person,
      CASE WHEN event_type IN ('click', 'error') THEN 'movement' WHEN event_type = 'view' THEN 'pickup' WHEN event_type = 'purchase' THEN 'drop' ELSE 'transfer' END AS kind,
      CASE CAST(JSON AS INT) % 9 WHEN 0 THEN 'bathroom' WHEN 1 THEN 'bedroom' WHEN 2 THEN 'garden' WHEN 3 THEN 'hallway' WHEN 4 THEN 'kitchen' WHEN 5 THEN 'office' WHEN 6 THEN 'school' WHEN 7 THEN 'cinema' ELSE 'park' END AS place,
      CASE event_id % 3 WHEN 0 THEN 'football' WHEN 1 THEN 'apple' ELSE 'milk' END AS thing,
      CASE (event_id + 3) % 8 WHEN 0 THEN 'Mary' WHEN 1 THEN 'John' WHEN 2 THEN 'Sandra' WHEN 3 THEN 'Daniel' WHEN 4 THEN 'Fred' WHEN 5 THEN 'Bill' WHEN 6 THEN 'Jeff' ELSE 'Julie' END AS target
    FROM events
"""
_SPARK = {"JSON": "get_json_object(props, '$.k')", "DATEDIFF": "datediff((SELECT max(ts) FROM events), ts)", "LPAD": "lpad(CAST(event_id AS STRING), 9, '0')"}
_DUCK = {"JSON": "json_extract_string(props, '$.k')", "DATEDIFF": "date_diff('day', ts::DATE, (SELECT max(ts) FROM events)::DATE)", "LPAD": "lpad(event_id::VARCHAR, 9, '0')", "`": '"', " AS INT": " AS BIGINT"}


def _as(sql: str, words: dict[str, str]) -> str:
    for word, text in words.items():
        sql = sql.replace(word, text)
    return sql


RUNS_SQL, MEM_SQL, MOVE_SQL = (_as(x, _DUCK) for x in (_RUNS, _MEM, _MOVE))


def _view(sql: str):
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_as(sql, _SPARK).replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))

    return view


#: events as evaluation runs, as memory events, and as moves of a story.
runs, mem_events, moves = _view(_RUNS), _view(_MEM), _view(_MOVE)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (context_id, text, lang, source)."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS context_id", "text", "lang", "source")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as contexts of pages: a page a turn, numbered from 1."""
    return turns(spark, sf_dir).selectExpr("conv_id AS context_id", "CAST(turn + 1 AS INT) AS page_id", "coalesce(text, '') AS text", "CAST(1 AS INT) AS line_start", "CAST(size(split(coalesce(text, ''), '\n')) AS INT) AS line_end")


def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each conversation: what the user said first."""
    first = turns(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg({"turn": "min"}).withColumnRenamed("min(turn)", "turn")
    return turns(spark, sf_dir).join(first, ["conv_id", "turn"]).selectExpr("conv_id AS question_id", "conv_id AS context_id", "coalesce(text, '') AS question")


#: The same for DuckDB.
TURN_PAGES_SQL = "SELECT conv_id AS context_id, turn + 1 AS page_id, coalesce(text, '') AS text FROM conversations"
TURN_QUESTIONS_SQL = "SELECT conv_id AS question_id, conv_id AS context_id, coalesce(text, '') AS question FROM conversations JOIN (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id, turn)"
