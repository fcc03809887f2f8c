"""Readers and writers: task tables, run records, trajectories, haystacks, transcripts, agent event logs, pages, results."""

from __future__ import annotations

import math
import os
import shutil
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import cut, ship
from foliant.sources.buckets import read_buckets as read_buckets
from foliant.sources.splits import read_lines as read_lines
from foliant.sources.splits import read_map

# Sources, scorers and bounds of the task schema.
BENCHMARKS = ("ruler", "babilong", "oolong_synth", "oolong_real", "longmemeval", "swe_chat", "clb", "synthetic")
SCORERS = ("exact", "exact_ci", "substring_ci", "multiple_choice", "csv_set_ci", "numeric_075", "csv_overlap_ci", "oolong_text_ci", "oolong_comparison_ci", "date_ci", "month_year_ci")
TASK = "task_id string, source_benchmark string, source_task string, source_sample_id string, context string, question string, gold_answer string, gold_answer_aliases array<string>, scorer string, metadata string"
RUN = (
    "task_id string, source_benchmark string, source_task string, source_sample_id string, harness string, model string, condition string, session_id string, chunk_tokens int, chunk_count int, context_tokens_est int, "
    "scorer string, gold_answer string, gold_answer_aliases array<string>, metadata string, turns array<struct<index:int,role:string,kind:string,chunk_index:int,chunk_count:int,chars:int,tokens_est:int,content_preview:string>>, "
    "tool_events array<struct<turn_index:int,tool_name:string,raw:string>>, compaction_events array<struct<turn_index:int,mode:string,before_tokens:int,after_tokens:int,raw:string>>, final_answer_raw string, "
    "final_answer_parsed struct<answer:string>, parse_ok boolean, correct boolean, contaminated_by_tools boolean, error string, duration_s double"
)


def _json(spark: SparkSession, paths: Sequence[str], schema: str, **options) -> DataFrame:
    reader = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.json(list(paths))


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Adds errors: the names of the schema's rules that a row breaks."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    rules = {
        "corrupt": F.col("_corrupt").isNotNull() if "_corrupt" in tasks.columns else F.lit(False),
        "task_id": ~F.coalesce(F.col("task_id").rlike(r"^[A-Za-z0-9._:-]+$"), F.lit(False)), "source_benchmark": ~F.coalesce(F.col("source_benchmark").isin(*BENCHMARKS), F.lit(False)),
        "source_task": ~n("source_task").between(1, 200), "context": n("context") < 1, "question": n("question") > 20_000, "gold_answer": n("gold_answer") > 4_000, "scorer": ~F.coalesce(F.col("scorer").isin(*SCORERS), F.lit(False)),
    }
    return tasks.withColumn("errors", F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()])))


def read_tasks(spark: SparkSession, paths: Sequence[str], allow: DataFrame | None = None, strict: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """Task rows of JSON lines under files and folders, validated; ``allow`` (task_id) keeps only those.

    Strict: reading fails at the first bad row, with its file, and if there is no row at all. Otherwise rows come with errors and path.
    """
    rows = validate_tasks(_json(spark, paths, TASK, pathGlobFilter=glob).withColumn("path", F.col("_metadata.file_path")))
    if allow is not None:
        rows = rows.join(allow.select("task_id").distinct(), "task_id", "left_semi")
    if not strict:
        return rows
    told = F.concat_ws(": ", "path", "task_id", F.array_join("errors", ", "))
    if rows.isEmpty():
        raise ValueError(f"no tasks in {', '.join(paths)}" + ("" if allow is None else " among those allowed"))
    return rows.withColumn("task_id", F.when(F.size("errors") > 0, F.raise_error(told).cast("string")).otherwise(F.col("task_id"))).drop("errors", "path", "_corrupt")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Raw JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_runs(spark: SparkSession, root: str, lenient: bool = False) -> DataFrame:
    """One run a file, below ``root``; lenient skips unreadable files."""
    rows = _json(spark, [root], RUN, multiLine=True, pathGlobFilter="*.json").withColumn("path", F.col("_metadata.file_path"))
    if lenient:
        return rows.where(F.col("_corrupt").isNull() & F.col("task_id").isNotNull()).drop("_corrupt")
    return rows.withColumn("task_id", F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("not a run record: "), "path")).cast("string")).otherwise(F.col("task_id"))).drop("_corrupt")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Some columns of Parquet files; the scan reads no others."""
    rows = spark.read.parquet(path).select(*columns)
    return rows if limit is None else rows.limit(limit)


def read_trajectories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Trajectories by id or trajectory_id; of rows with one id the last in the file stays, and of several files that in the last by name."""
    from foliant.operators.panel import keep_last

    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.schema(schema).json(path).withColumns({"traj_id": F.coalesce("id", "trajectory_id") if "trajectory_id" in schema else F.col("id"), "__ord": place})
    return keep_last(rows, ["traj_id"], "__ord").drop("__ord")


def read_haystack(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(question_id, pos, traj_id) of JSON maps from question to trajectory ids: one a file, of any size (see read_map), or one a line."""
    if by_line:
        maps = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("question_id", "ids"))
    else:
        maps = read_map(spark, path).select(F.col("key").alias("question_id"), F.col("values").alias("ids"))
    return maps.select("question_id", F.posexplode("ids").alias("pos", "traj_id"))


def _said(content: Column) -> Column:
    """Text of a message's content: a string, or a list of parts with text, joined by blanks."""
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), " ")
    return F.when(content.startswith("["), joined).otherwise(content)


def transcript_turns(lines: DataFrame, shortest: int = 10) -> DataFrame:
    """(path, turn, role, text) of transcript lines (path, line_no, value), whichever of two shapes they have.

    Shape one is a line a message, {type, payload: {role, content}}; shape two a line with messages: [{info: {role}, parts}].
    User and assistant messages of ``shortest`` characters or more stay, numbered by place.
    """
    one = lines.select("path", "line_no", F.lit(0).alias("k"), F.coalesce(F.get_json_object("value", "$.payload.role"), F.get_json_object("value", "$.type")).alias("role"), _said(F.get_json_object("value", "$.payload.content")).alias("text")).where("text is not null")
    listed = F.from_json("value", "messages array<struct<info:struct<role:string>,parts:array<struct<text:string>>>>")["messages"]
    two = lines.select("path", "line_no", F.posexplode(listed).alias("k", "m")).select("path", "line_no", "k", F.col("m.info.role").alias("role"), F.array_join(F.filter(F.transform("m.parts", lambda p: p["text"]), lambda t: t.isNotNull()), " ").alias("text"))
    role = F.when(F.lower("role").isin("user", "user_message", "human"), "user").when(F.lower("role").isin("assistant", "agent", "agent_message"), "assistant")
    kept = one.unionByName(two).withColumn("role", role).where(F.col("role").isNotNull() & (F.length(T.strip(F.col("text"))) >= shortest))
    return kept.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("line_no", "k")) - 1).alias("turn"), "role", "text")


def agent_events(lines: DataFrame) -> DataFrame:
    """One row a session log (path, line_no, value): session_id, final_text, tool_events, compaction_events, input_tokens, output_tokens. Lines that aren't JSON are dropped."""
    get = lambda p: F.get_json_object("value", p)
    rows = lines.withColumn("type", F.coalesce(get("$.type"), get("$.payload.type"))).where(F.json_object_keys("value").isNotNull())
    text = F.coalesce(get("$.result"), F.when(get("$.item.type").isin("agent_message", "assistant_message"), get("$.item.text")), F.when(F.col("type") == "assistant", get("$.message.content[0].text")))
    tool = F.coalesce(F.when(get("$.item.type").isin("command_execution", "mcp_tool_call", "web_search", "file_change"), get("$.item.type")), F.when(get("$.message.content[0].type") == "tool_use", get("$.message.content[0].name")))
    first = F.when(F.col("type").isin("compacted", "compact_boundary"), F.col("value"))
    fallback = F.when((F.col("type") == "context_compacted") | (get("$.payload.type") == "context_compacted"), F.col("value"))
    made = rows.withColumns({"text": text, "tool": tool, "first": first, "fallback": fallback, "sid": F.coalesce(get("$.session_id"), get("$.thread_id"), get("$.payload.id"))})
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("v"))))), lambda x: x["v"])
    out = made.groupBy("path").agg(
        F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("line_no"))).alias("session_id"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("line_no"))).alias("final_text"), in_order("tool").alias("tool_events"),
        in_order("first").alias("__first"), in_order("fallback").alias("__fallback"), F.sum(get("$.usage.input_tokens").try_cast("long")).alias("input_tokens"), F.sum(get("$.usage.output_tokens").try_cast("long")).alias("output_tokens"),
    )
    return out.withColumn("compaction_events", prefer("__first", "__fallback")).drop("__first", "__fallback")


def prefer(first: str, fallback: str) -> Column:
    """One list of events, or another where it is empty."""
    return F.when(F.size(first) > 0, F.col(first)).otherwise(F.col(fallback))


def duplicate_ids(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_tasks(tasks: DataFrame, path: str, kind: str = "json") -> None:
    """Write a task table, unless task ids repeat."""
    twice = [r["task_id"] for r in duplicate_ids(tasks).limit(5).collect()]
    if twice:
        raise ValueError(f"task ids repeat: {', '.join(map(str, twice))}")
    tasks.write.format(kind).mode("errorifexists").save(path)


def write_results(rows: DataFrame, path: str, kind: str = "csv", by: Sequence[str] = ()) -> None:
    """Result tables; nested columns become JSON in CSV files."""
    flat = rows.select(*[F.to_json(c).alias(c) if kind == "csv" and t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
    writer = flat.write.mode("overwrite").partitionBy(*by) if by else flat.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


#: Run records of a folder.
FOLDER_RUNS = 200


def _record_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        made = f"{root}/_temporary/{task.taskAttemptId()}"
        for b in batches:
            for record in b.column(0):
                if not n:
                    os.makedirs(made)
                with open(f"{made}/run-{n:06d}.json", "wb") as out:
                    out.write(record.as_py())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([f"{root}/part-{task.partitionId():06d}"])], names=["made", "kept"])

    return run


def write_runs(runs: DataFrame, path: str, folder_runs: int = FOLDER_RUNS) -> int:
    """Run records (task_id and others) as JSON, one a file, in a new folder: in folders below it, each written by one task; returns as many as ``folder_runs`` go into the records.

    In a file system that Hadoop takes for local, tasks write the files by themselves: without its native library it starts a process for each file,
    its checksum and its folder. What a task writes lies in a folder of its attempt, which readers pass over until the driver renames those of successful tasks.
    """
    spark = runs.sparkSession
    n = max(1, math.ceil(runs.count() / folder_runs))
    dealt = runs.withColumn("__folder", F.pmod(F.xxhash64("task_id"), F.lit(n)).cast("int")).repartitionById(n, "__folder")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if uri.getScheme() != "file":
        dealt.write.option("maxRecordsPerFile", 1).partitionBy("__folder").json(path)
        return n
    root = uri.getPath()
    os.makedirs(root)
    ship(spark)
    for r in dealt.select(F.to_json(F.struct(*runs.columns)).cast("binary")).mapInArrow(_record_files(root), "made string, kept string").collect():
        os.rename(r["made"], r["kept"])
    shutil.rmtree(f"{root}/_temporary", ignore_errors=True)
    return n


#: Characters of a page store's bucket, and of one of its files.
BUCKET_CHARS, FILE_CHARS = 1 << 30, 1 << 28


def write_pages(pages: DataFrame, path: str, buckets: int | None = None, bucket_chars: int = BUCKET_CHARS, file_chars: int = FILE_CHARS) -> int:
    """The page store: pages by a hash bucket of their context, and beside it a manifest (write_manifest's aggregate); returns the number of buckets.

    There are as many buckets as ``bucket_chars`` go into what is written, unless a number is given. A bucket is written by several tasks,
    as many as ``file_chars`` go into the largest one, a task of its own for each of their shares. Pages are dealt out to these by a hash of context and
    number, so neither a context that holds much of the pages nor the first pages of short ones are one task's. No pages give an empty store.
    """
    told = cut(manifest(pages))
    n = buckets or max(1, math.ceil((told.agg(F.sum("chars")).first()[0] or 0) / bucket_chars))
    bucket = F.pmod(F.xxhash64("context_id"), F.lit(n)).cast("int")
    most = told.groupBy(bucket.alias("bucket")).agg(F.sum("chars").alias("chars")).agg(F.max("chars")).first()[0] or 0
    files = max(1, math.ceil(most / file_chars))
    share = F.pmod(F.xxhash64("page_id", "context_id"), F.lit(files)).cast("int")
    dealt = pages.withColumn("bucket", bucket).repartitionById(n * files, F.col("bucket") * files + share)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pages")
    told.write.mode("overwrite").parquet(f"{path}/manifest")
    return n


def manifest(pages: DataFrame) -> DataFrame:
    """(context_id, page_count, chars, tokens_est, min_tokens, max_tokens)."""
    return pages.groupBy("context_id").agg(F.count(F.lit(1)).alias("page_count"), F.max("char_end").alias("chars"), F.sum("tokens_est").alias("tokens_est"), F.min("tokens_est").alias("min_tokens"), F.max("tokens_est").alias("max_tokens"))
