"""Registered queries: panels, set operations and streaming jobs, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import panel as P
from foliant.plans import views as V
from foliant.session import shared_dir, ship, table
from foliant.streaming import jobs as J
from foliant.streaming import tiers, upsert


def first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_n(V.runs(spark, sf_dir), ["source_benchmark", "length"], ["run_id"], 5).select("run_id", "source_benchmark", "length")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_last(V.runs(spark, sf_dir).select("task", "arm", "run_id", "score"), ["task", "arm"], "run_id")


def balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labelled documents a fixed number for each stratum of quality and toxicity."""
    spec = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 0, 10), (1, 1, 3)], "quality int, toxic int, n int")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return P.balanced_panel(rows, spec, ["quality", "toxic"], ["doc_id"]).select("doc_id", "quality", "toxic", "lang")


def short_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of language and source with fewer labelled documents than wanted."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    wanted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.lit(6).alias("n"))
    return P.shortfall(rows, wanted, ["lang", "source"])


def cross_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("arm") != "click", 0).when(F.col("task") % 2 == 0, 1).otherwise(2)
    return P.cross_panel(V.runs(spark, sf_dir).select("run_id", "arm", "task"), priority, ["run_id"], 100)


def experiment_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of every task with every arm that have no run yet."""
    rows = V.runs(spark, sf_dir)
    arms = F.explode(F.array(*[F.lit(a) for a in ("click", "error", "purchase", "signup", "view")]))
    jobs = rows.select("task").distinct().select("task", arms.alias("arm"))
    return P.skip_existing(jobs, rows.where("error is null"), ["task", "arm"])


def allowed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return P.allow_list(P.allow_list(table(spark, sf_dir, "documents").select("doc_id", "lang"), good, "doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", deny=True)


def merged_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.runs(spark, sf_dir).select("task", "run_id", "score")
    first, second = (P.keep_last(rows.where(F.col("run_id") % 2 == k), ["task"], "run_id") for k in (0, 1))
    return P.union_roots([first, second], ["task"])


def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return P.missing_types(docs, docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id"), "source")


def _stream(spark: SparkSession, sf_dir: str, timed: bool = False) -> DataFrame:
    """events as a stream of files; ``timed`` reads ts as an instant (UTC), as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")) if timed else rows


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out when all there is has been read."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    J.run_to_end(stream, f"{folder}/state", f"{folder}/out", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user and kind of event, errors being decoys."""
    state = J.latest_state(_stream(spark, sf_dir), ["user_id", "event_type"], ["click", "view", "purchase", "signup"], kind="event_type")
    return _finished(spark, state, "complete")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a day and kind of the days that the watermark has passed."""
    return _finished(spark, J.daily_rollup(_stream(spark, sf_dir, True)), "append").select(F.date_from_unix_date(F.floor(F.unix_timestamp("day") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.concat(F.lit("h"), F.col("user_id") % 3).alias("harness"), F.lit("m").alias("model"), F.col("event_type").alias("condition"), F.lit("numeric_075").alias("scorer"), ((k + F.col("event_id") % 3) % 100).cast("string").alias("answer"), k.cast("string").alias("gold_answer"), F.when(F.col("event_type") == "error", "boom").alias("error"))


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous scoring of events as runs: numbers against the number wanted."""
    return _finished(spark, J.scored_summary(_scored_events(spark, sf_dir)), "complete").withColumn("score_sum", F.round("score_sum", 4))


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of events of a user no more than two hours apart that the watermark has closed."""
    out = _finished(spark, J.event_blocks(_stream(spark, sf_dir, True), "user_id", "2 hours"), "append")
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first four events of each user a stream keeps."""
    return _finished(spark, J.first_n_stream(_stream(spark, sf_dir), "user_id", 4, "event_id"), "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def stream_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users have an event of each kind, reruns dropped within the watermark."""
    out = _finished(spark, J.without_reruns(_stream(spark, sf_dir, True), ["user_id", "event_type"], "60 days"), "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    return J.age_tier(e, last or "1970-01-01").groupBy("tier", "event_type").agg(F.count(F.lit(1)).alias("n"))


TIER_TIMES = ("2024-01-05", "2024-01-12", "2024-01-20", "2024-01-28")


def stream_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each kind are in each tier at several times, from the changes that timers told."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ship(spark)
    changes = tiers.tier_changes(_stream(spark, sf_dir, True), ["event_type"], cold=20)
    J.run_to_end(changes, f"{folder}/state", f"{folder}/out", timers=True)
    told = spark.read.schema(changes.schema).parquet(f"{folder}/out")
    parts = [tiers.tiers_at(told, f"{t} 00:00:00", ["event_type"]).groupBy("event_type", "tier").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("day"), "event_type", "tier", "n") for t in TIER_TIMES]
    return reduce(DataFrame.unionByName, parts)


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of stream_scores as a table that each batch updates in place: one row a key."""
    folder = f"{shared_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    scored = J.scored_summary(_scored_events(spark, sf_dir))
    upsert.upsert_stream(scored, folder, f"{folder}/checkpoint", ["harness", "model", "condition"], buckets=8)
    return upsert.read_upserted(spark, folder).withColumn("score_sum", F.round("score_sum", 4))


QUERIES = {
    f.__name__: f
    for f in (
        first_runs, last_runs, balanced_labels, short_buckets, cross_panel, experiment_jobs, allowed_documents, merged_roots, missing_types, stream_tiers, stream_upserts, stream_state, stream_rollup, stream_scores, stream_blocks, stream_first, stream_reruns, event_tiers,
    )
}

_R = f"WITH runs AS ({V.RUNS_SQL})"

ORACLES = {
    "first_runs": f"{_R} SELECT run_id, source_benchmark, length FROM runs QUALIFY row_number() OVER (PARTITION BY source_benchmark, length ORDER BY run_id) <= 5",
    "last_runs": f"{_R} SELECT task, arm, run_id, score FROM runs QUALIFY row_number() OVER (PARTITION BY task, arm ORDER BY run_id DESC) = 1",
    "balanced_labels": "SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) <= CASE WHEN quality = 0 AND toxic = 0 THEN 5 WHEN quality = 0 THEN 2 WHEN toxic = 0 THEN 10 ELSE 3 END",
    "short_buckets": "SELECT lang, source, 6 AS n, count(l.doc_id) AS have FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL HAVING count(l.doc_id) < 6",
    "cross_panel": f"{_R} SELECT run_id, arm, task FROM runs ORDER BY CASE WHEN arm <> 'click' THEN 0 WHEN task % 2 = 0 THEN 1 ELSE 2 END, run_id LIMIT 100",
    "experiment_jobs": f"{_R} SELECT task, arm FROM (SELECT DISTINCT task FROM runs), (SELECT DISTINCT arm FROM runs) EXCEPT SELECT task, arm FROM runs WHERE error IS NULL",
    "allowed_documents": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "merged_roots": f"{_R} SELECT task, run_id, score FROM runs QUALIFY row_number() OVER (PARTITION BY task ORDER BY run_id % 2 DESC, run_id DESC) = 1",
    "missing_types": "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0",
    "stream_state": "SELECT user_id, event_type, value, ts FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stream_rollup": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2",
    "stream_scores": """SELECT concat('h', user_id % 3) AS harness, 'm' AS model, event_type AS "condition", count(*) AS n_total, count(*) FILTER (event_type <> 'error') AS n_completed, count(*) FILTER (event_type = 'error') AS n_failed,
        count(*) FILTER (k = m) AS n_correct, round(sum(pow(0.75, abs(k - m))), 4) AS score_sum FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, (json_extract_string(props, '$.k')::BIGINT + event_id % 3) % 100 AS m FROM events) GROUP BY ALL""",
    "stream_blocks": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
        s AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS z, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, floor(epoch(a))::BIGINT AS start, n FROM s WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_first": "SELECT user_id, least(4, count(*)) AS n FROM events GROUP BY 1",
    "stream_reruns": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
    "event_tiers": "SELECT CASE WHEN d <= 2 THEN 'hot' WHEN d <= 14 THEN 'warm' ELSE 'cold' END AS tier, event_type, count(*) AS n FROM (SELECT event_type, date_diff('day', ts::DATE, (SELECT max(ts) FROM events)::DATE) AS d FROM events) GROUP BY ALL",
}
ORACLES["stream_upserts"] = ORACLES["stream_scores"]
ORACLES["stream_tiers"] = """
    SELECT strftime(t, '%Y-%m-%d') AS day, event_type, CASE WHEN d <= 2 THEN 'hot' WHEN d <= 14 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n
    FROM (SELECT t, event_type, date_diff('day', ts, t) AS d FROM events CROSS JOIN (SELECT unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-28']) AS t) WHERE ts <= t)
    WHERE d <= 20 GROUP BY ALL"""
