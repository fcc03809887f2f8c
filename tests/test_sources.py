"""Readers and writers, and operators on what they read."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunk as C
from foliant.operators import evaluate as E
from foliant.operators import normalize as N
from foliant.operators import panel as P
from foliant.plans import files
from foliant.session import shared_dir
from foliant.sources import tasks as S
from foliant.sources.buckets import index_files
from foliant.sources.splits import read_map


def test_runs_one_a_file(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "run.json").write_text(json.dumps({"task_id": f"t{k}", "harness": "h", "model": "m", "condition": "grep", "turns": [{"index": 0, "content_preview": "gold here"}], "metadata": json.dumps({"arm": "a", "packet": {"evidence_tokens_est": 7}}), "final_answer_parsed": {"answer": "x"}}, indent=1))
    (tmp_path / "d1" / "broken.json").write_text("{oops")
    rows = S.read_runs(spark, str(tmp_path), lenient=True)
    assert {r["task_id"] for r in rows.collect()} == {"t1", "t2"}
    flat = E.flatten_runs(rows).first()
    assert (flat["arm"], flat["evidence_tokens"]) == ("a", 7)


def test_haystack_and_trajectories(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"q1": ["a", "b"], "q2": []}')
    hay = S.read_haystack(spark, str(tmp_path / "h.json"))
    assert [(r["question_id"], r["pos"], r["traj_id"]) for r in hay.orderBy("pos").collect()] == [("q1", 0, "a"), ("q1", 1, "b")]
    (tmp_path / "lines.json").write_text('{"q1": ["a", "b"]}\n{"q2": []}\n{"q3": ["c"], "q4": ["a"]}\n')
    by_line = S.read_haystack(spark, str(tmp_path / "lines.json"), by_line=True)
    assert sorted(map(tuple, by_line.collect())) == [("q1", 0, "a"), ("q1", 1, "b"), ("q3", 0, "c"), ("q4", 0, "a")]
    (tmp_path / "many").mkdir()
    for k, goal in ((2, "late"), (1, "early")):
        (tmp_path / "many" / f"part-{k}.jsonl").write_text('{"id": "a", "goal": "%s 1"}\n{"id": "a", "goal": "%s 2"}\n' % (goal, goal))
    assert [r["goal"] for r in S.read_trajectories(spark, str(tmp_path / "many"), "id string, goal string").collect()] == ["late 2"]
    (tmp_path / "t.jsonl").write_text('{"id": "a", "goal": "old"}\n{"trajectory_id": "b", "goal": "g"}\n{"id": "a", "goal": "new", "states": [{"state_index": 1}]}\n')
    fields = "id string, trajectory_id string, domain string, environment string, goal string, outcome string, start_url string, states array<struct<state_index:int,url:string,thought:string,action:string,accessibility_tree:string>>"
    rows = S.read_trajectories(spark, str(tmp_path / "t.jsonl"), fields)
    assert {r["traj_id"]: r["goal"] for r in rows.collect()} == {"a": "new", "b": "g"}
    asked = spark.createDataFrame([("q1", "t", "Q?", "300", "d", "e")], "id string, question_type string, question string, answer string, domain string, environment string")
    task = N.memory_questions(asked, hay, N.render_trajectories(rows.where("traj_id = 'a'")), 3).first()
    assert task["scorer"] == "exact_ci" and "goal: new" in task["context"] and json.loads(task["metadata"])["missing"] == 1


def test_buckets_and_results(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, "x" * k) for k in range(12)], "id int, g int, body string")
    rows.write.parquet(str(tmp_path / "in"))
    wanted = spark.createDataFrame([(0, 2), (1, 9)], "g int, n int")
    assert {r["id"] for r in S.read_buckets(spark, str(tmp_path / "in"), wanted, ["g"], ["id"]).collect()} == {0, 3, 1, 4, 7, 10}
    assert {(r["g"], r["have"]) for r in P.shortfall(rows, wanted, ["g"]).collect()} == {(1, 4)}
    S.write_results(rows.withColumn("a", F.array("id")), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("a = '[3]'").count() == 1
    assert P.sampled_manifest(rows, "g", ["id"], 2, ("id",)).count() == 6


def test_page_store_and_lines(spark, tmp_path):
    pages = C.page_contexts(spark.createDataFrame([(1, "line\n" * 100), (2, "")], "context_id int, text string"), 20, 2)
    S.write_pages(pages, str(tmp_path / "store"), 4)
    assert spark.read.parquet(str(tmp_path / "store" / "pages")).count() == pages.count()
    assert {r["context_id"]: r["chars"] for r in spark.read.parquet(str(tmp_path / "store" / "manifest")).collect()} == {1: 500, 2: 0}
    (tmp_path / "log.txt").write_text("a\n\nb\n")
    assert [(r["line_no"], r["value"]) for r in S.read_lines(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()] == [(1, "a"), (3, "b")]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_long_files(spark, tmp_path, small_splits):
    """Many tasks read one file and number its lines rightly; short files share tasks."""
    long = [f"line {k} " + "x" * (k * 37 % 300) if k % 7 else "" for k in range(2000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "long.txt").write_text("\n".join(long) + "\n")
    (tmp_path / "in" / "crlf.txt").write_bytes(b"a\r\n\r\nb\r\nlast")
    (tmp_path / "in" / "none.txt").write_text("")
    lines = S.read_lines(spark, str(tmp_path / "in"))
    got = {}
    for r in lines.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["line_no"]] = r["value"]
    assert got["long.txt"] == {k + 1: v for k, v in enumerate(long) if v} and got["crlf.txt"] == {1: "a", 3: "b", 4: "last"} and set(got) == {"long.txt", "crlf.txt"}
    assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 50


def test_one_json_map_by_splits(spark, tmp_path, small_splits):
    rng = random.Random(9)
    odd = ['a]b', '[x', 'say "]" and \\ ', "é]]", "plain", "", '\\"', "line\nend]"]
    for style in ({}, {"indent": 2}, {"separators": (",", ":")}):
        made = {f"q{k}{rng.choice(odd)}": None if k % 11 == 3 else [rng.choice(odd) + str(j) for j in range(rng.randrange(0, 9))] for k in range(400)}
        path = tmp_path / f"map{len(style)}{style.get('indent', 0)}.json"
        path.write_text(json.dumps(made, ensure_ascii=rng.random() < 0.5, **style))
        assert {r["key"]: r["values"] for r in read_map(spark, str(path)).collect()} == {k: v for k, v in made.items() if v is not None}
    hay = S.read_haystack(spark, str(path)).collect()
    assert sorted((r["question_id"], r["pos"], r["traj_id"]) for r in hay) == sorted((k, j, t) for k, v in made.items() for j, t in enumerate(v or []))
    (tmp_path / "bad.json").write_text('{"q": 5, "r": [1]}')
    with pytest.raises(Exception, match="not a map of lists"):
        read_map(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "empty.json").write_text(" {} \n")
    assert read_map(spark, str(tmp_path / "empty.json")).collect() == []


def test_buckets_open_few_files(spark, tmp_path):
    """Files that hold no wanted bucket, or only rows behind full ones, are not opened; rows are those of a full scan."""
    for k in range(12):
        spark.createDataFrame([(1000 * k + j, f"g{(k // 4 + j) % 3}" if k < 8 else "far", "x" * (j % 5), j % 10 == 0) for j in range(200)], "id long, g string, v string, rare boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    wanted = spark.createDataFrame([("g0", 5), ("g1", 100), ("absent", 3)], "g string, n int")
    full = {g: sorted(r["id"] for r in rows.where(F.col("g") == g).collect())[:n] for g, n in (("g0", 5), ("g1", 100))}
    index = index_files(spark, str(tmp_path / "in"), ["g"], ["id"])
    index.write.parquet(str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    for given in (None, kept):
        got = S.read_buckets(spark, str(tmp_path / "in"), wanted, ["g"], ["id"], index=given)
        assert sorted(r["id"] for r in got.collect()) == sorted(full["g0"] + full["g1"]) and got.columns == rows.columns
        assert len(got.inputFiles()) == 2
    some = S.read_buckets(spark, str(tmp_path / "in"), wanted, ["g"], ["id"], index=kept, where=F.col("rare"))
    rare = {g: sorted(r["id"] for r in rows.where(F.col("g") == g).where("rare").collect())[:n] for g, n in (("g0", 5), ("g1", 100))}
    assert sorted(r["id"] for r in some.collect()) == sorted(rare["g0"] + rare["g1"]) and len(some.inputFiles()) <= 8
    one = S.read_buckets(spark, str(tmp_path / "in"), wanted.where("g = 'g0'"), ["g"], ["id"], index=kept, where=F.col("rare"))
    assert sorted(r["id"] for r in one.collect()) == rare["g0"] and len(one.inputFiles()) == 1
    none = S.read_buckets(spark, str(tmp_path / "in"), wanted.where("g = 'absent'"), ["g"], ["id"], index=kept)
    assert none.count() == 0 and none.columns == rows.columns


def test_no_tasks_is_an_error(spark, tmp_path):
    row = {"task_id": "a", "source_benchmark": "ruler", "source_task": "t", "source_sample_id": "s", "context": "c", "question": "q", "gold_answer": "g", "scorer": "exact"}
    (tmp_path / "t.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "n.jsonl").write_text("")
    assert S.read_tasks(spark, [str(tmp_path / "t.jsonl")]).count() == 1
    with pytest.raises(ValueError, match="no tasks"):
        S.read_tasks(spark, [str(tmp_path / "none")])
    with pytest.raises(ValueError, match="among those allowed"):
        S.read_tasks(spark, [str(tmp_path / "t.jsonl")], allow=spark.createDataFrame([("b",)], "task_id string"))
    assert S.read_tasks(spark, [str(tmp_path / "none")], strict=False).count() == 0


def test_page_store_is_sized_by_what_it_holds(spark, tmp_path):
    pages = C.page_contexts(spark.createDataFrame([(1, "line of a long context\n" * 2000)] + [(k, f"short {k}") for k in range(2, 20)], "context_id int, text string"), 20, 2)
    assert S.write_pages(pages, str(tmp_path / "one")) == 1
    n = S.write_pages(pages, str(tmp_path / "many"), bucket_chars=9000, file_chars=4000)
    assert n == 6
    kept = spark.read.parquet(str(tmp_path / "many" / "pages"))
    assert kept.count() == pages.count() and kept.where("context_id = 1").select("_metadata.file_path").distinct().count() > 3


def test_carriers(spark):
    carriers = spark.createDataFrame([(0, "a" * 30), (1, "b" * 30), (2, "c" * 30)], "idx int, text string")
    tasks = spark.createDataFrame([(0, "q"), (4, "r")], "idx int, question string")
    got = {r["idx"]: r["carrier"] for r in C.assemble_carriers(tasks, carriers, 20).collect()}
    assert got[0] == "a" * 30 + "\n\n" + "b" * 30 and got[4].startswith("b" * 30)
    text = "Mary went.\n\nA long line about the garden " + "x" * 240 + "\nshort garden\nkept"
    row = spark.createDataFrame([(text, "S", "y" * 50)], "t string, s string, c string").select(C.clean_carrier("t", ["garden"], ["Mary"]).alias("clean"), C.splice("s", "c", 11).alias("spliced")).first()
    assert row["clean"].splitlines()[-1] == "kept" and len(row["clean"].splitlines()) == 2
    assert row["spliced"] == "y" * 5 + "\n\nS\n\n" + "y" * 6
    parts = C.episode_chunks(spark.createDataFrame([(1, "[START OF EPISODE] a [START OF EPISODE] b"), (2, "none")], "context_id int, text string")).collect()
    assert {(r["context_id"], r["episode"]) for r in parts} == {(1, 0), (1, 1), (2, 0)}


def test_carriers_equal_plain_rounds(spark):
    """Any lengths, targets and numbers of tasks; rows made are those taken."""
    import random

    rng = random.Random(3)
    for m in (1, 2, 7, 40):
        texts = [rng.choice(["", None, "a", "bb" * rng.randrange(1, 30), "long " * rng.randrange(1, 300)]) for _ in range(m)]
        tasks = [(k, k * 7 % 90, rng.choice([0, 1, 5, 60, 900, 20_000])) for k in range(60)]
        want = {}
        for key, idx, target in tasks:
            pieces, total = [], 0
            for k in range(3 * m):
                piece = texts[(idx + k) % m] or ""
                if piece:
                    pieces.append(piece)
                    total += len(piece)
                    if total >= 2 * target:
                        break
            text = "\n\n".join(pieces)
            want[key] = text if len(text) >= target and pieces else None
        carriers = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
        frame = spark.createDataFrame(tasks, "key int, idx long, target int")
        assert {r["key"]: r["carrier"] for r in C.assemble_carriers(frame, carriers, "target").collect()} == want
    sized = spark.createDataFrame([(k, 10) for k in range(1000)], "idx long, len long")
    some = spark.createDataFrame([(k, 45) for k in range(0, 5000, 7)], "idx long, target_chars long")
    assert {r["last"] - r["first"] for r in C.carrier_ranges(some, sized).collect()} == {8}
    none = spark.createDataFrame([], "idx long, text string")
    assert [r["carrier"] for r in C.assemble_carriers(frame.limit(2), none, 5).collect()] == [None, None]
    assert C.assemble_carriers(frame.limit(0), carriers, 5).count() == 0


def test_cohort_relabel_scans(spark):
    studies = spark.createDataFrame([("s", ["m1", "m2"], ["t1", "t2"])], "study_id string, metadata array<string>, truth array<string>")
    assert {(r["pos"], r["metadata"], r["truth"]) for r in N.cohort_tasks(studies).collect()} == {(0, "m1", "t1"), (1, "m2", "t2")}
    t = N.relabel(spark.createDataFrame([("a", '{"x":"1","y":"2"}')], "task_id string, metadata string"), "--p", {"y": "3"}).first()
    assert t["task_id"] == "a--p" and json.loads(t["metadata"]) == {"x": "1", "y": "3"}
    scans = spark.createDataFrame([(k, [(100.0 + k, -50.0)]) for k in range(20)], "ord int, peaks array<struct<freq:double,power:double>>")
    got = {r["episode"]: (r["history"].count("\n") + 1, r["future"]) for r in N.sliding_scans(scans, back=10, ahead=5).collect()}
    assert got[0][0] == 10 and got[0][1].splitlines()[0] == "110.00 MHz@-50.0 dBm" and set(got) == {0}


def test_page_store_deals_a_task_one_share(spark, tmp_path):
    """No task writes two buckets, and the first pages of short contexts are not one task's."""
    text = F.repeat(F.lit("word and word. "), 40)
    pages = C.page_contexts(spark.range(600).select(F.col("id").alias("context_id"), text.alias("text")), 400)
    n = S.write_pages(pages, str(tmp_path), bucket_chars=100_000, file_chars=20_000)
    rows = spark.read.parquet(f"{tmp_path}/pages").select("bucket", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("task")).groupBy("bucket", "task").count().collect()
    assert n == 4 and {r["bucket"] for r in rows} == set(range(4))
    assert len({r["task"] for r in rows}) == len(rows) and max(r["count"] for r in rows) < 60


def _record_folders(root) -> dict:
    return {d: [json.loads(f.read_text()) for f in d.glob("*.json")] for d in {f.parent for f in root.rglob("*.json") if f.is_file()}}


def test_run_records_share_folders(spark, tmp_path):
    """One record a file, few folders, each one task's; nothing is lost for ids that repeat or are null, and a failed attempt's files aren't read."""
    turn = F.array(F.struct(F.lit(0).alias("index"), F.lit('say "ö"\n').alias("content_preview")))
    runs = spark.range(450).select(F.concat(F.lit("t/"), F.col("id") % 300).alias("task_id"), turn.alias("turns"), F.col("id").cast("string").alias("model")).repartition(7)
    runs = runs.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("task_id"), turn.alias("turns"), F.lit("none").alias("model")))
    root = tmp_path / "a b%20" / "runs"
    S.write_runs(runs, str(root), 100)
    folders = _record_folders(root)
    assert len(folders) == 5 and sum(map(len, folders.values())) == 451 and sorted(p.name[:5] for p in root.iterdir()) == ["part-"] * 5
    (root / "_temporary" / "7").mkdir(parents=True)
    (root / "_temporary" / "7" / "run-000000.json").write_text('{"task_id": "half"}')
    want = sorted((f"t/{k % 300}", str(k), 'say "ö"\n') for k in range(450))
    told = lambda rows: sorted((r["task_id"], r["model"], r["turns"][0]["content_preview"]) for r in rows.collect())
    assert told(S.read_runs(spark, str(root), lenient=True)) == want
    with pytest.raises(FileExistsError):
        S.write_runs(runs, str(root))
    S.write_runs(runs.limit(0), str(tmp_path / "none"))
    assert S.read_runs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "linked").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./in", f"file://{tmp_path}/linked")
    S.write_runs(runs, "viewfs://runs/in/runs", 100)
    folders = _record_folders(tmp_path / "linked" / "runs")
    assert len(folders) == 5 and sum(map(len, folders.values())) == 451 and told(S.read_runs(spark, "viewfs://runs/in/runs", lenient=True)) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_run_files_folders_hold_many(spark):
    """Conversations are a file each, and not a folder each."""
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("runs-*"))
    n = files.run_files(spark, "/root/testdata/sf0.001").count()
    (root,) = set(shared.glob("runs-*")) - before
    folders = _record_folders(root)
    assert sum(map(len, folders.values())) == n and 20 * len(folders) <= n
