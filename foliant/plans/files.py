"""Registered queries: given tables written as the library's file formats into the shared folder and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import chunk as C
from foliant.operators import evaluate as E
from foliant.operators import normalize as N
from foliant.plans import texts
from foliant.plans import views as V
from foliant.session import shared_dir, table
from foliant.sources import tasks as S


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs written as task rows, ids guarded, and read back strictly; an allow-list leaves out every tenth conversation."""
    path, pairs = _folder(spark, "tasks"), N.conversation_pairs(V.turns(spark, sf_dir), False).where("context <> ''")
    rows = pairs.select(
        F.concat_ws("-", F.lit("swe_chat"), "conv_id", "turn").alias("task_id"), F.lit("swe_chat").alias("source_benchmark"), F.lit("qa").alias("source_task"), F.col("conv_id").cast("string").alias("source_sample_id"), "context", "question",
        F.col("gold").alias("gold_answer"), F.array(F.lower("gold")).alias("gold_answer_aliases"), F.lit("substring_ci").alias("scorer"), F.to_json(F.struct("turn")).alias("metadata"),
    )
    S.write_tasks(rows, path)
    back = S.read_tasks(spark, [path], rows.where("cast(source_sample_id as bigint) % 10 <> 0"), glob="*.json")
    return back.select("task_id", F.sha1(F.col("context").cast("binary")).alias("context_sha1"), "question", F.element_at("gold_answer_aliases", 1).alias("alias"), F.get_json_object("metadata", "$.turn").cast("long").alias("turn"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as JSON lines with blank ones between, read by a schema of three fields."""
    path, events = _folder(spark, "lines"), table(spark, sf_dir, "events")
    events.select(F.explode(F.array(F.to_json(F.struct("event_id", "event_type", "value")), F.lit(""))).alias("value")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double")


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as run records, a file each in folders of many, and among them files that are no records."""
    path = _folder(spark, "runs")
    turn = F.struct(F.col("turn").cast("int").alias("index"), "role", F.length("text").alias("chars"), F.substring("text", 1, 160).alias("content_preview"))
    rows = V.turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = S.write_runs(rows.select(F.concat(F.lit("run-"), "conv_id").alias("task_id"), "turns", F.to_json(F.struct(F.col("conv_id").alias("arm"))).alias("metadata")), path)
    rows.where("conv_id % 20 = 0").select(F.lit("{no record").alias("value")).write.option("compression", "none").text(f"{path}/broken.json")
    # Spark reads few small files a task, whatever their size: with as many tasks as folders, one reads about FOLDER_RUNS.
    back = E.flatten_runs(S.read_runs(spark, path, lenient=True).coalesce(n))
    return back.select("task_id", "arm", F.size("turns").alias("n_turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("chars"), F.sha1(F.element_at("turns", -1)["content_preview"].cast("binary")).alias("last_sha1"))


def scanned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of two columns of orders."""
    rows = S.read_columns(spark, f"{sf_dir}/orders.parquet", ["o_orderpriority", "o_totalprice"])
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"))


def wanted_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first orders by key of each bucket of status and priority, more of urgent ones; two buckets aren't asked for."""
    wanted = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct().where("not (o_orderstatus = 'P' and o_orderpriority < '3')").withColumn("n", F.when(F.col("o_orderpriority") < "2", 40).otherwise(15))
    return S.read_buckets(spark, f"{sf_dir}/orders.parquet", wanted, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories by user under either name of the id, in files in order; the last of a user stays."""
    path = _folder(spark, "trajectories")
    even = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(even.alias("id"), F.when(even.isNull(), F.col("user_id").cast("string")).alias("trajectory_id"), F.concat(F.lit("goal "), "event_id").alias("goal"), F.col("event_type").alias("outcome"))
    rows.write.json(path)
    return S.read_trajectories(spark, path, "id string, trajectory_id string, goal string, outcome string").select("traj_id", "goal", "outcome")


def haystack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their trajectories in order, a map a line, read back."""
    path = _folder(spark, "haystacks")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(t["role"], F.lit("-"), t["turn"]))
    V.turns(spark, sf_dir).groupBy("conv_id").agg(ids.alias("ids")).select(F.to_json(F.create_map(F.concat(F.lit("q"), "conv_id"), "ids"))).write.text(path)
    return S.read_haystack(spark, path, by_line=True)


def haystack_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of JSON maps that are a file each, read by byte ranges; ids hold brackets, quotes and backslashes, and a last question has no list."""
    path = _folder(spark, "haystack-maps")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(t["role"], F.lit('-]"\\-'), t["turn"]))
    entries = V.turns(spark, sf_dir).groupBy("conv_id").agg(ids.alias("ids")).select(F.pmod("conv_id", F.lit(4)).alias("map"), F.lit(1).alias("kind"), "conv_id", F.to_json(F.create_map(F.concat(F.lit("q"), "conv_id"), "ids")).alias("m"))
    lines = entries.select("map", "kind", "conv_id", F.expr("substring(m, 2, length(m) - 2) || ','").alias("value"))
    frame = entries.select("map", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit("{").alias("value")), F.struct(F.lit(2).alias("kind"), F.lit('"none": null}').alias("value")))).alias("x")).distinct().select("map", "x.kind", F.lit(None).cast("long").alias("conv_id"), "x.value")
    lines.unionByName(frame).repartition("map").sortWithinPartitions("map", "kind", "conv_id").select("map", "value").write.partitionBy("map").text(path)
    return S.read_haystack(spark, path)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.turns(spark, sf_dir).select(F.concat(F.lit("session-"), "conv_id").alias("path"), F.col("turn").alias("line_no"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: even ones a line a message, the others lists of messages with parts; every third text is too short to stay."""
    said = F.when(F.col("turn") % 3 == 2, " ok ").otherwise(F.col("text"))
    listed = F.array(F.struct(said.alias("text")), F.struct(F.lit("end").alias("text")))
    one = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"), said.alias("content")).alias("payload")))
    two = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("role")).alias("info"), listed.alias("parts"))).alias("messages")))
    lines = _log(spark, sf_dir).select("path", "line_no", F.when(F.col("conv_id") % 2 == 0, one).otherwise(two).alias("value"))
    return S.transcript_turns(lines).select("path", "turn", "role", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


def agent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as agent event logs of two kinds: messages, tools, usage and compactions (those of one kind before those of the other), with lines that are no JSON."""
    usage = F.struct(F.length("text").alias("input_tokens"), (F.length("text") % 7).alias("output_tokens"))
    item = lambda kind: F.struct(kind.alias("type"), F.col("text").alias("text"))
    value = (
        F.when(F.col("turn") == 0, F.to_json(F.struct(F.lit("init").alias("type"), F.col("path").alias("session_id"))))
        .when(F.col("turn") % 5 == 3, F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.lit("compacted").alias("type"), F.col("turn").alias("at")))).otherwise(F.lit('{"type":"other"}')))
        .when(F.col("turn") % 5 == 4, F.to_json(F.struct(F.lit("event").alias("type"), F.struct(F.lit("context_compacted").alias("type"), F.col("turn").alias("at")).alias("payload"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("item.completed").alias("type"), item(F.lit("agent_message")).alias("item"), usage.alias("usage"))))
        .when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit("item.completed").alias("type"), item(F.when(F.col("conv_id") % 3 == 0, "web_search").otherwise("command_execution")).alias("item"))))
        .otherwise(F.lit("not json {"))
    )
    out = S.agent_events(_log(spark, sf_dir).select("path", "line_no", value.alias("value")))
    at = lambda v: F.coalesce(F.get_json_object(v, "$.at"), F.get_json_object(v, "$.payload.at"))
    return out.select("path", "session_id", F.sha1(F.col("final_text").cast("binary")).alias("final_sha1"), F.array_join("tool_events", ",").alias("tools"), F.array_join(F.transform("compaction_events", at), ",").alias("compactions"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a nested column as CSV files by arm, read back."""
    path = _folder(spark, "results")
    rows = V.runs(spark, sf_dir).select("run_id", "arm", "score", "answer", F.array("task", "run_id").alias("ids"))
    S.write_results(rows, path, by=["arm"])
    back = spark.read.option("header", True).schema("run_id long, score double, answer string, ids string, arm string").csv(path)
    return back.select("run_id", "arm", "score", "answer", F.get_json_object("ids", "$[0]").cast("long").alias("task"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page store of all documents, written and read back: its manifest against its pages."""
    path = _folder(spark, "pages")
    S.write_pages(C.page_contexts(V.contexts(spark, sf_dir), 200, 20), path)
    read = S.manifest(spark.read.parquet(f"{path}/pages"))
    return spark.read.parquet(f"{path}/manifest").join(read, read.columns).select(*read.columns)


QUERIES = {f.__name__: f for f in (task_files, raw_lines, run_files, scanned_columns, wanted_buckets, trajectory_files, haystack_files, haystack_map, transcripts, agent_logs, result_files, page_files)}

_LOG = "WITH l AS (SELECT 'session-' || conv_id AS path, conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"

ORACLES = {
    "task_files": f"""{texts._PAIRS} SELECT concat('swe_chat-', conv_id, '-', turn) AS task_id, sha1((SELECT string_agg(s, chr(10) || chr(10) ORDER BY turn) FROM t WHERE t.conv_id = p.conv_id AND t.place < p.place)) AS context_sha1, text AS question, lower(substring(gold, 1, 4000)) AS alias, turn
        FROM p WHERE place > 1 AND conv_id % 10 <> 0""",
    "raw_lines": "SELECT event_id, event_type, value FROM events",
    "run_files": "SELECT 'run-' || conv_id AS task_id, conv_id::VARCHAR AS arm, count(*) AS n_turns, sum(length(text))::BIGINT AS chars, sha1(substring(max_by(text, turn), 1, 160)) AS last_sha1 FROM conversations GROUP BY conv_id",
    "scanned_columns": "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY 1",
    "wanted_buckets": """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority < '3')
        QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) <= CASE WHEN o_orderpriority < '2' THEN 40 ELSE 15 END""",
    "trajectory_files": "SELECT user_id::VARCHAR AS traj_id, 'goal ' || max(event_id) AS goal, max_by(event_type, event_id) AS outcome FROM events GROUP BY user_id",
    "haystack_map": "SELECT 'q' || conv_id AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, role || '-]\"\\-' || turn AS traj_id FROM conversations",
    "haystack_files": "SELECT 'q' || conv_id AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, role || '-' || turn AS traj_id FROM conversations",
    "transcripts": f"""{_LOG}, s AS (SELECT path, conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN ' ok ' ELSE text END || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' end' END AS text FROM l)
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY turn) - 1 AS turn, role, sha1(text) AS text_sha1 FROM s WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 10""",
    "agent_logs": f"""{_LOG}, k AS (SELECT *, CASE WHEN turn = 0 THEN 'init' WHEN turn % 5 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'first' END WHEN turn % 5 = 4 THEN 'fallback' WHEN role = 'assistant' THEN 'text' WHEN turn % 2 = 0 THEN 'tool' END AS kind FROM l)
        SELECT path, max(path) FILTER (kind = 'init') AS session_id, sha1(max_by(text, turn) FILTER (kind = 'text')) AS final_sha1,
          coalesce(string_agg(CASE WHEN conv_id % 3 = 0 THEN 'web_search' ELSE 'command_execution' END, ',' ORDER BY turn) FILTER (kind = 'tool'), '') AS tools,
          coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (kind = 'first'), string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (kind = 'fallback'), '') AS compactions,
          coalesce(sum(length(text)) FILTER (kind = 'text'), 0)::BIGINT AS input_tokens, coalesce(sum(length(text) % 7) FILTER (kind = 'text'), 0)::BIGINT AS output_tokens
        FROM k GROUP BY path""",
    "result_files": f"WITH runs AS ({V.RUNS_SQL}) SELECT run_id, arm, score, nullif(answer, '') AS answer, task FROM runs",
    "page_files": texts.ORACLES["page_store"],
}
