"""Registered queries: event memory, story state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import memory as M
from foliant.operators import story as S
from foliant.plans import views as V


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written as memory log lines, a context a user and a row a line of it, and parsed again; a line in ten is no event."""
    line = F.concat(F.lit("[MEM day="), F.col("day").cast("string"), F.lit(" id="), "event_id", F.lit(" type="), "kind", F.lit(" key="), "key", F.lit(" value="), "value", F.lit(" importance="), F.col("importance").cast("string"), F.lit("] "), "text")
    line = F.when(F.col("event_id").endswith("0"), F.concat(F.lit("not an event "), "event_id")).otherwise(line)
    return M.parse_memory_log(V.mem_events(spark, sf_dir).select("context_id", line.alias("context")))


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.current_state(V.mem_events(spark, sf_dir))


def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.most_common(V.mem_events(spark, sf_dir))


def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warm tier for a question without an age: a line a day of the last two weeks."""
    events = V.mem_events(spark, sf_dir)
    return M.episodic_tier(events, _ask(events, "what is the pattern of my meals"))


def _ask(events: DataFrame, *questions: str) -> DataFrame:
    """Each question to each context."""
    texts = F.array(*[F.lit(q) for q in questions])
    return events.select("context_id").distinct().select("context_id", F.posexplode(texts).alias("k", "question")).select((F.col("context_id") * 100 + F.col("k")).alias("question_id"), "context_id", "question")


def hot_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.mem_events(spark, sf_dir)
    return M.hot_tier(events, _ask(events, "what project decision was there recently"))


def cold_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.mem_events(spark, sf_dir)
    return M.cold_tier(events, _ask(events, "was the note about tea and decision k3"))


def flat_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.mem_events(spark, sf_dir)
    return M.flat_tier(events, _ask(events, "which decision k3 was it 5 days ago"))


def memory_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packets for six kinds of question to each context."""
    events = V.mem_events(spark, sf_dir)
    asked = _ask(events, "What did I eat last night?", "What do I usually have for dinner?", "How many times did I eat dinner?", "What did I eat 30 days ago?", "What is my current tea?", "Was a project decision ever never mentioned?")
    return M.memory_packets(M.memory_tiers(events, asked), asked)


def derived_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.derive_gold(V.mem_events(spark, sf_dir))


def _story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events told as a story, a context a user and a row a sentence of it."""
    sentence = (
        F.when(F.col("kind") == "movement", F.concat("person", F.lit(" went to the "), "place", F.lit("."))).when(F.col("kind") == "pickup", F.concat("person", F.lit(" picked up the "), "thing", F.lit(".")))
        .when(F.col("kind") == "drop", F.concat("person", F.lit(" dropped the "), "thing", F.lit("."))).otherwise(F.concat("person", F.lit(" handed the "), "thing", F.lit(" to "), "target", F.lit(".")))
    )
    return V.moves(spark, sf_dir).select("context_id", "event_id", sentence.alias("text"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extract_story_events(_story(spark, sf_dir), part_col="event_id")


def story_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.person_locations(_events(spark, sf_dir))


def story_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.object_state(_events(spark, sf_dir))


def story_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    everyone = S.person_moves(events).select("context_id", "person").distinct().withColumn("target", F.lit("cinema"))
    return S.before_location(events, everyone)


def story_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    asked = events.select("context_id").distinct().select(F.col("context_id").alias("question_id"), "context_id", F.lit("Where was Mary before the kitchen, and who has the milk?").alias("question"))
    return S.state_packets(events, asked)


def densest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the block with most of them, two hours apart at most."""
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = V.runs(spark, sf_dir).select(F.col("task").cast("string").alias("context_id"), F.col("run_id").cast("int").alias("idx"), t.alias("position"))
    return S.densest_block(events, 7200).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("start"), F.max("position").alias("end"))


def planted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals planted in whole documents, and what reading them back gives."""
    from foliant.operators.chunk import plant_passages

    docs = V.contexts(spark, sf_dir).select("context_id", "text")
    needles = docs.select("context_id", F.posexplode(F.array(*[F.concat(F.lit(f"alarm at step {k}"), F.lit("")) for k in (1, 2, 3)])).alias("ord", "text")).withColumn("position", F.pmod(F.xxhash64("context_id", "ord"), F.lit(100)) / 100.0)
    planted = plant_passages(docs, needles.select("context_id", "ord", "position", "text"))
    return M.planted_counts(planted, "alarm")


QUERIES = {
    f.__name__: f
    for f in (memory_log, current_state, most_common_values, daily_facts, hot_tier, cold_tier, flat_tier, memory_packets, derived_gold, story_locations, story_objects, story_before, story_packets, densest_blocks, planted_signals)
}

_E = f"WITH e AS ({V.MEM_SQL})"
_M = f"WITH m AS ({V.MOVE_SQL}), mv AS (SELECT context_id, person, event_id, place, lag(place) OVER (PARTITION BY context_id, person ORDER BY event_id) AS previous FROM m WHERE kind = 'movement')"
_RENDER = "'[day=' || CASE WHEN day < 0 THEN '-' ELSE '+' END || lpad(abs(day)::VARCHAR, 3, '0') || ' id=' || event_id || ' type=' || kind || ' key=' || key || ' value=' || value || ' importance=' || importance || '] ' || text"
_HITS = lambda *terms: " + ".join(f"contains(h, '{t}')::INT" for t in terms)
_HAY = "lower(kind || ' ' || key || ' ' || value || ' ' || text) AS h"

ORACLES = {
    "memory_log": f"{_E} SELECT context_id, day, event_id, kind, key, value, importance, text FROM e WHERE event_id NOT LIKE '%0'",
    "current_state": f"{_E} SELECT context_id, kind, key, value, day, event_id FROM e WHERE kind IN ('preference', 'profile', 'decision') QUALIFY row_number() OVER (PARTITION BY context_id, kind, key ORDER BY day DESC, event_id DESC) = 1",
    "most_common_values": f"""{_E}, c AS (SELECT context_id, kind, key, value, count(*) AS n, min((day, event_id)) AS first FROM e GROUP BY ALL)
        SELECT context_id, kind, key, value, n FROM c QUALIFY row_number() OVER (PARTITION BY context_id, kind, key ORDER BY n DESC, first) = 1""",
    "daily_facts": f"""{_E}, d AS (SELECT context_id, day, string_agg(kind || '/' || key || '=' || value, '; ' ORDER BY event_id) AS f FROM e WHERE abs(day) <= 14 GROUP BY ALL)
        SELECT context_id * 100 AS question_id, 'L1' AS tier, row_number() OVER (PARTITION BY context_id ORDER BY day DESC) AS ord, 'day ' || CASE WHEN day < 0 THEN '-' ELSE '+' END || lpad(abs(day)::VARCHAR, 3, '0') || ': ' || f AS item FROM d""",
    "hot_tier": f"""{_E}, h AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY day DESC, event_id DESC) AS back FROM e WHERE abs(day) <= 2 AND kind = 'decision')
        SELECT context_id * 100 AS question_id, 'L0' AS tier, row_number() OVER (PARTITION BY context_id ORDER BY day, event_id) AS ord, {_RENDER} AS item FROM h WHERE back <= 24""",
    "cold_tier": f"""{_E}, h AS (SELECT *, {_HAY} FROM e), s AS (SELECT *, {_HITS("was", "the", "note", "about", "tea", "and", "decision")} AS score FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, abs(day), event_id) AS ord FROM s WHERE score > 0)
        SELECT context_id * 100 AS question_id, 'L3' AS tier, ord, {_RENDER} AS item FROM r WHERE ord <= 24""",
    "flat_tier": f"""{_E}, h AS (SELECT *, {_HAY} FROM e), s AS (SELECT *, {_HITS("decision", "was", "ago")} + CASE WHEN abs(day) = 5 THEN 8 ELSE 0 END AS score FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, abs(day), event_id) AS ord FROM s WHERE score > 0)
        SELECT context_id * 100 AS question_id, 'FLAT' AS tier, ord, {_RENDER} AS item FROM r WHERE ord <= 24""",
    "derived_gold": f"""{_E}, d AS (SELECT * FROM e WHERE kind = 'meal' AND key = 'dinner'), c AS (SELECT context_id, value, count(*) AS n, min((day, event_id)) AS first FROM d GROUP BY ALL),
        s AS (SELECT * FROM e WHERE kind IN ('preference', 'decision') QUALIFY row_number() OVER (PARTITION BY context_id, kind, key ORDER BY day DESC, event_id DESC) = 1)
        SELECT context_id, 'last_night' AS query_type, max_by(value, event_id) AS gold FROM d WHERE abs(day) = 1 GROUP BY 1 UNION ALL SELECT context_id, 'thirty_days_ago', max_by(value, event_id) FROM d WHERE abs(day) = 30 GROUP BY 1
        UNION ALL SELECT context_id, 'most_common', value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY n DESC, first) = 1)
        UNION ALL SELECT context_id, 'least_common', value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY n, value) = 1)
        UNION ALL SELECT context_id, 'count', count(*)::VARCHAR FROM d GROUP BY 1 UNION ALL SELECT context_id, 'latest_' || kind, value FROM s""",
    "story_locations": f"{_M} SELECT context_id::VARCHAR AS context_id, person, max_by(place, event_id) AS location FROM mv GROUP BY ALL",
    "story_objects": f"""{_M}, l AS (SELECT context_id, thing, kind, event_id, CASE WHEN kind = 'transfer' THEN target ELSE person END AS actor FROM m WHERE kind <> 'movement' QUALIFY row_number() OVER (PARTITION BY context_id, thing ORDER BY event_id DESC) = 1)
        SELECT l.context_id::VARCHAR AS context_id, l.thing AS obj, CASE WHEN l.kind <> 'drop' THEN l.actor END AS holder, max_by(mv.place, mv.event_id) AS location
        FROM l LEFT JOIN mv ON mv.context_id = l.context_id AND mv.person = l.actor AND (l.kind <> 'drop' OR mv.event_id <= l.event_id) GROUP BY l.context_id, l.thing, l.kind, l.actor""",
    "story_before": f"{_M} SELECT context_id::VARCHAR AS context_id, person, 'cinema' AS target, min_by(previous, event_id) AS answer FROM mv WHERE place = 'cinema' AND previous IS NOT NULL GROUP BY ALL",
    "densest_blocks": """
        WITH e AS (SELECT user_id AS c, event_id AS i, floor(epoch(ts))::BIGINT AS p FROM events), g AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY c ORDER BY p, i) > 7200 THEN 1 ELSE 0 END AS n FROM e),
        b AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY p, i) AS k FROM g), s0 AS (SELECT c, k, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY c) AS total FROM s0),
        t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, k) = 1)
        SELECT context_id, count(*) AS n, min(p) AS start, max(p) AS "end" FROM (SELECT b.c::VARCHAR AS context_id, p FROM b JOIN t ON b.c = t.c AND (t.total <= 2 OR b.k = t.k)) GROUP BY 1""",
    "planted_signals": "SELECT doc_id AS context_id, 3 AS n FROM documents",
}
