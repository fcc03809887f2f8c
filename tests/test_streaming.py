"""Streaming jobs give what batch gives, whatever the order of arrival."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def _events(spark, tmp_path, order):
    rows = [(k, START + dt.timedelta(hours=5 * k), k % 3, "click" if k % 4 else "error", float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for n, part in enumerate(order):
        df.where(F.col("event_id") % len(order) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{n}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def _out(spark, tmp_path, stream, mode):
    J.run_to_end(stream, str(tmp_path / "state"), str(tmp_path / "out"), mode)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_latest_state_ignores_arrival(spark, tmp_path):
    df, stream = _events(spark, tmp_path, [3, 0, 2, 1])
    job = lambda d: J.latest_state(d, ["user_id"], ["click"], kind="event_type")
    assert sorted(_out(spark, tmp_path, job(stream), "complete").collect()) == sorted(job(df).collect())


def test_first_n_counts_over_batches(spark, tmp_path):
    _, stream = _events(spark, tmp_path, [0, 1])
    got = _out(spark, tmp_path, J.first_n_stream(stream, "user_id", 4, "event_id"), "append").groupBy("user_id").count().collect()
    assert {(r["user_id"], r["count"]) for r in got} == {(0, 4), (1, 4), (2, 4)}


def test_rollup_and_reruns(spark, tmp_path):
    df, stream = _events(spark, tmp_path, [0])
    days = {str(r["day"])[:10]: r["n"] for r in _out(spark, tmp_path / "a", J.daily_rollup(stream), "append").where("event_type = 'error'").collect()}
    last = df.agg(F.max("ts")).first()[0]
    assert days and all(dt.datetime.fromisoformat(d) + dt.timedelta(days=1) <= last - dt.timedelta(days=2) for d in days)
    kept = _out(spark, tmp_path / "b", J.without_reruns(stream, ["user_id", "event_type"], "60 days"), "append")
    assert kept.count() == df.select("user_id", "event_type").distinct().count()


def test_blocks(spark, tmp_path):
    df, stream = _events(spark, tmp_path, [0])
    got = _out(spark, tmp_path, J.event_blocks(stream, "user_id", "4 hours"), "append")
    assert got.count() > 0 and {r["n"] for r in got.collect()} == {1}


def test_scored_summary(spark, tmp_path):
    rows = [("h", "m", "c", "exact", "a", "a", None), ("h", "m", "c", "exact", "a", "b", None), ("h", "m", "c", "exact", "a", None, "boom")]
    df = spark.createDataFrame(rows, "harness string, model string, condition string, scorer string, gold_answer string, answer string, error string")
    df.write.parquet(str(tmp_path / "in"))
    got = _out(spark, tmp_path, J.scored_summary(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "complete").first()
    assert (got["n_total"], got["n_completed"], got["n_failed"], got["n_correct"], got["score_sum"]) == (3, 2, 1, 1, 1.0)


def test_tiers_over_time_equal_batch_tiers(spark, tmp_path):
    """Files out of order, one at a time: at each of several times the changes give what age_tier gives; what is held is bounded by what is to come."""
    from foliant.session import ship
    from foliant.streaming import tiers

    ship(spark)
    rows = [(k, START + dt.timedelta(hours=7 * k), "click" if k % 4 else "error") for k in range(160)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string")
    for n, part in enumerate([(0, 60), (100, 130), (60, 100), (130, 160)]):  # the third comes late
        df.where(F.col("event_id").between(part[0], part[1] - 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    changes, folder = None, str(tmp_path)
    for n in range(4):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/f[0-{n}]")
        changes = tiers.tier_changes(stream, ["event_type"], delay="15 days", hot=1, warm=3, cold=8, salts=2)
        J.run_to_end(changes, f"{folder}/state{n}", f"{folder}/out{n}", timers=True)
    told = spark.read.schema(changes.schema).parquet(f"{folder}/out3")
    last = rows[-1][1] - dt.timedelta(days=15)
    days = sorted({r[1].date() for r in rows if r[1] < last})[2:]
    assert len(days) > 10
    for day in days[::5]:
        now = f"{day} 00:00:00"
        want = {(r["event_id"], r["tier"]) for r in J.age_tier(df.where(F.col("ts") <= F.lit(now).cast("timestamp")), now, hot=1, warm=3).where(F.datediff(F.lit(now).cast("timestamp"), "ts") <= 8).collect()}
        assert {(r["event_id"], r["tier"]) for r in tiers.tiers_at(told, now, ["event_type"]).collect()} == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != J.ROCKS
    gone = {r["event_id"] for r in told.where("tier = 'gone'").collect()}
    assert gone == {k for k, ts, _ in rows if dt.datetime.combine(ts.date(), dt.time()) + dt.timedelta(days=9) <= last}


def test_upsert_applies_each_batch_once(spark, tmp_path):
    from foliant.streaming import upsert as U

    folder = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k long, at int, v string")
    now = lambda **how: {(r["k"], r["v"]) for r in U.read_upserted(spark, folder, **how).collect()}
    assert U.upsert(frame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n"), (1, 3, "c")]), 0, folder, ["k"], ["at"], buckets=4)
    assert now() == {(1, "c"), (2, "b"), (None, "n")}
    assert U.upsert(frame([(1, 2, "older"), (2, 1, "later batch"), (5, 1, "new")]), 1, folder, ["k"], ["at"], buckets=4)
    want = {(1, "c"), (2, "later batch"), (None, "n"), (5, "new")}
    assert now() == want
    assert not U.upsert(frame([(1, 9, "replayed")]), 1, folder, ["k"], ["at"], buckets=4) and now() == want
    assert now(version=0) == {(1, "c"), (2, "b"), (None, "n")}
    # A batch that failed before its manifest was complete is not seen, and is written over.
    (tmp_path / "table" / "manifest" / "batch=2").mkdir()
    assert now() == want and U.versions(spark, folder) == [0, 1]
    assert U.upsert(frame([(7, 1, "x")]), 2, folder, ["k"], ["at"], buckets=4) and now() == want | {(7, "x")}
    assert U.upsert(frame([]), 3, folder, ["k"], ["at"], buckets=4) and now() == want | {(7, "x")}
    assert U.forget(spark, folder, keep=1) and now() == want | {(7, "x")} and U.versions(spark, folder) == [3]


def test_upserts_of_a_stream_are_its_last_rows(spark, tmp_path):
    from foliant.streaming import upsert as U

    df, stream = _events(spark, tmp_path, [3, 0, 2, 1])
    counts = stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        U.upsert_stream(counts, str(tmp_path / "t"), str(tmp_path / "c"), ["user_id"], buckets=2)
        assert sorted(map(tuple, U.read_upserted(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.groupBy("user_id").count().collect()))
    assert len(U.versions(spark, str(tmp_path / "t"))) >= 4
