"""Structured Streaming jobs; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.scoring import score_runs


def scored_summary(runs: DataFrame, keys: Sequence[str] = ("harness", "model", "condition")) -> DataFrame:
    """Continuous scoring with a summary and status counts, in update mode."""
    scored = score_runs(runs)
    done = F.col("error").isNull()
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(done).alias("n_completed"), F.count_if(~done).alias("n_failed"), F.count_if("correct").alias("n_correct"), F.sum("score").alias("score_sum"))


def latest_state(events: DataFrame, keys: Sequence[str], kinds: Sequence[str] | None, ts: str = "ts", order: str = "event_id", value: str = "value", kind: str = "kind") -> DataFrame:
    """The latest value of each key by event time, whatever the order of arrival; decoy kinds are dropped."""
    rows = events if kinds is None else events.where(F.col(kind).isin(*kinds))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("ts")), F.struct(ts, order)).alias("s")).select(*keys, "s.value", "s.ts")


def daily_rollup(events: DataFrame, keys: Sequence[str] = ("event_type",), delay: str = "2 days", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums a day; events later than the watermark are dropped."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), *keys, "n", "total")


def age_tier(events: DataFrame, now: str, ts: str = "ts", hot: int = 2, warm: int = 14) -> DataFrame:
    """Adds tier: hot, warm or cold by age in days at ``now``."""
    days = F.datediff(F.lit(now).cast("timestamp"), F.col(ts))
    return events.withColumn("tier", F.when(days <= hot, "hot").when(days <= warm, "warm").otherwise("cold"))


def event_blocks(events: DataFrame, key: str, gap: str, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Blocks of events with no more than ``gap`` between them: key, start, end, n."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, delay).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_n_stream(events: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The first n rows of each key in order of arrival, by a counter a key; rows of one micro-batch by ``order``."""
    schema = events.schema
    names = schema.names

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        if had < n:
            rows = pd.concat(list(frames)).sort_values(order).head(n - had)
            state.update((had + len(rows),))
            yield rows[names]

    return events.groupBy(key).applyInPandasWithState(run, schema, "n long", "append", "NoTimeout")


def without_reruns(events: DataFrame, keys: Sequence[str], delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, checkpoint: str, out: str, mode: str = "append", timers: bool = False) -> None:
    """Process all that is there now into Parquet (append) or the last state of each batch (complete, update) by foreachBatch.

    ``timers`` starts the stream on RocksDB's state store, as state with timers needs; the session's own setting is put back. For a table of
    the latest rows see upsert_stream.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if timers:
        conf.set(name, ROCKS)
    try:
        if mode == "append":
            q = writer.format("parquet").option("path", out).start()
        else:
            q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}" if mode == "complete" else f"{out}/batch={n}")).start()
    finally:
        conf.set(name, before)
    q.awaitTermination()
