"""Raw corpora into the task table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.panel import first_n

# Scorers by task and by answer type.
NEEDLE_SCORERS = {**{f"niah_single_{k}": "substring_ci" for k in (1, 2, 3)}, **{f"niah_multikey_{k}": "substring_ci" for k in (1, 2, 3)}, "niah_multivalue": "csv_set_ci", "niah_multiquery": "csv_set_ci", "vt": "csv_set_ci", "cwe": "csv_set_ci", "fwe": "csv_set_ci", "qa_1": "substring_ci", "qa_2": "substring_ci"}
ANSWER_SCORERS = {"LABEL": "oolong_text_ci", "NUMERIC": "numeric_075", "COMPARISON": "oolong_comparison_ci", "USER": "oolong_text_ci", "DATE": "date_ci", "MONTH_YEAR": "month_year_ci"}
LENGTHS = {1 << k: f"{1 << (k - 10)}k" for k in range(10, 20)} | {1 << 20: "1M", 1 << 21: "2M", 1 << 22: "4M"}


def lookup(values: Mapping, key: Column, default: str | None = None) -> Column:
    """A small dimension as a map literal."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(T.strip(F.col(n)), F.lit("")) for n in names])


def _task(benchmark: str, task: Column, sample: Column, context: Column, question: Column, gold: Column, aliases: Column, scorer: Column, metadata: Column) -> list[Column]:
    ident = F.concat_ws("-", F.lit(benchmark), T.sanitise(task), T.sanitise(sample))
    return [ident.alias("task_id"), F.lit(benchmark).alias("source_benchmark"), task.alias("source_task"), sample.alias("source_sample_id"), context.alias("context"), question.alias("question"), F.substring(gold, 1, 4000).alias("gold_answer"), aliases.alias("gold_answer_aliases"), scorer.alias("scorer"), F.to_json(metadata).alias("metadata")]


def _none() -> Column:
    return F.array().cast("array<string>")


def needle_tasks(raw: DataFrame, tasks: Sequence[str] | None = None, min_length: int = 0) -> DataFrame:
    """(index, task, length, input, outputs): the input's trailing Question: is split off; the first output is gold, the others aliases."""
    form = r"(?s)^(.*?)\n*\s*Question:\s*(.*?)\s*$"
    last = r"(?s)^(.*)\n\s*(?:Question:\s*)?(\S.*?)\s*$"
    rows = raw.where((F.coalesce("length", F.lit(0)) >= min_length) & (F.length(T.strip(F.col("input"))) > 0) & (F.size("outputs") > 0))
    rows = rows if tasks is None else rows.where(F.col("task").isin(*tasks))
    asked = F.col("input").rlike(form)
    part = lambda k: F.when(asked, F.regexp_extract("input", form, k)).otherwise(F.regexp_extract("input", last, k))
    return rows.select(*_task("ruler", F.col("task"), F.col("index").cast("string"), T.strip(part(1)), part(2), F.get("outputs", F.lit(0)), F.slice("outputs", F.lit(2), F.greatest(F.size("outputs") - 1, F.lit(0))), lookup(NEEDLE_SCORERS, F.col("task"), "substring_ci"), F.struct("length")))


def story_tasks(raw: DataFrame) -> DataFrame:
    """Story questions: input or context, target or answer, id or sample_id (missing columns are taken as null); qa8 is scored as a set."""
    rows = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in ("input", "context", "target", "answer", "id", "sample_id", "length") if c not in raw.columns])
    rows = rows.withColumns({"__context": _filled("input", "context"), "__gold": _filled("target", "answer"), "__id": F.coalesce(F.col("id").cast("string"), F.col("sample_id").cast("string"))}).where("__context is not null and __gold is not null")
    return rows.select(*_task("babilong", F.col("task"), F.coalesce("__id", F.lit("")), F.col("__context"), F.col("question"), F.col("__gold"), _none(), F.when(F.col("task") == "qa8", "csv_set_ci").otherwise("exact_ci"), F.struct(F.col("length").alias("length_label"))))


def literal_gold(raw: Column) -> Column:
    """datetime.date(Y, M, D) as ISO text; the first element of a list literal; else the text itself."""
    call = r"datetime\.date\((\d+),\s*(\d+),\s*(\d+)\)"
    iso = F.concat_ws("-", F.lpad(F.regexp_extract(raw, call, 1), 4, "0"), F.lpad(F.regexp_extract(raw, call, 2), 2, "0"), F.lpad(F.regexp_extract(raw, call, 3), 2, "0"))
    listed = r"""^\s*\[\s*(?:'([^']*)'|"([^"]*)"|([^,\]'"]+))"""
    first = F.concat(F.regexp_extract(raw, listed, 1), F.regexp_extract(raw, listed, 2), T.strip(F.regexp_extract(raw, listed, 3)))
    return F.when(raw.rlike(call), iso).when(raw.rlike(listed), first).otherwise(T.strip(raw))


def list_length(raw: Column) -> Column:
    """Elements of a list literal; 0 if it can't be read."""
    return F.coalesce(F.size(F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "array<string>")), F.lit(0))


def synthetic_aggregation_tasks(raw: DataFrame, min_length: int | None = None, max_length: int | None = None, lengths: Sequence[int] | None = None, groups: Sequence[str] | None = None, datasets: Sequence[str] | None = None, labelled: bool = False) -> DataFrame:
    """Aggregation questions over generated data: filters go to the scan; scorer by answer type."""
    rows = raw
    for wanted, cond in ((min_length, F.col("context_len") >= (min_length or 0)), (max_length, F.col("context_len") <= (max_length or 0))):
        rows = rows if wanted is None else rows.where(cond)
    for wanted, name in ((lengths, "context_len"), (groups, "task_group"), (datasets, "dataset")):
        rows = rows if wanted is None else rows.where(F.col(name).isin(*wanted))
    kind = F.upper(F.regexp_replace("answer_type", r"^.*\.", ""))
    context = "context_window_text_with_labels" if labelled else "context_window_text"
    label = F.coalesce(lookup(LENGTHS, F.col("context_len")), F.col("context_len").cast("string"))
    return rows.select(*_task("oolong_synth", F.col("task"), F.col("id").cast("string"), F.col(context), F.col("question"), literal_gold(F.col("answer")), _none(), lookup(ANSWER_SCORERS, kind, "oolong_text_ci"), F.struct(label.alias("length_label"), "task_group", "dataset")))


def shape_scorer(gold: Column, listed: str = "csv_overlap_ci", number: str = "numeric_075", other: str = "oolong_text_ci") -> Column:
    """The scorer that a gold answer's shape asks for."""
    return F.when(gold.rlike(r"^-?\d+$"), number).when(F.contains(gold, F.lit(",")), listed).otherwise(other)


def real_aggregation_tasks(raw: DataFrame, question_types: Sequence[str] | None = None) -> DataFrame:
    rows = raw if question_types is None else raw.where(F.col("question_type").isin(*question_types))
    gold = T.strip(F.col("answer"))
    return rows.select(*_task("oolong_real", F.col("question_type"), F.col("id").cast("string"), F.col("context_window_text"), F.col("question"), gold, _none(), shape_scorer(gold), F.struct(list_length(F.col("episodes")).alias("episodes"), "campaign")))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def render_trajectories(rows: DataFrame, edge: int = 4, head_chars: int = 900, field_chars: int = 700) -> DataFrame:
    """(traj_id, rendered): header fields, then the first and the last states with a line for those left out."""
    front, back = edge // 2, edge - edge // 2
    n = F.size("states")
    chosen = F.when(n <= edge, F.col("states")).otherwise(F.concat(F.slice("states", 1, front), F.slice("states", -back, back)))
    field = lambda s, name: F.concat(F.lit(f"{name}: "), clip(F.coalesce(s[name], F.lit("")), field_chars))
    state = lambda s: F.concat_ws("\n", F.concat(F.lit("[state "), s["state_index"].cast("string"), F.lit("]")), *[field(s, f) for f in ("url", "thought", "action", "accessibility_tree")])
    blocks = F.transform(chosen, state)
    gap = F.concat(F.lit("… "), (n - edge).cast("string"), F.lit(" intermediate states omitted …"))
    body = F.when(n <= edge, F.array_join(blocks, "\n")).otherwise(F.concat_ws("\n", F.array_join(F.slice(blocks, 1, front), "\n"), gap, F.array_join(F.slice(blocks, -back, back), "\n")))
    head = [F.concat(F.lit(f"{f}: "), clip(F.coalesce(f, F.lit("")), head_chars)) for f in ("domain", "environment", "goal", "outcome", "start_url")]
    return rows.select("traj_id", F.concat_ws("\n", *head, body).alias("rendered"))


def memory_questions(questions: DataFrame, haystack: DataFrame, rendered: DataFrame, per_type: int, most: int = 120) -> DataFrame:
    """Questions with the trajectories of their haystack: context in order, missing ones counted; the first ``per_type`` of each type."""
    chosen = first_n(questions, ["question_type"], ["id"], per_type)
    found = chosen.select(F.col("id").alias("question_id")).join(haystack.where(F.col("pos") < most), "question_id").join(rendered, "traj_id", "left")
    contexts = found.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rendered").isNotNull(), F.struct("pos", "rendered")))), lambda x: x["rendered"]), "\n\n").alias("context"), F.count_if(F.col("rendered").isNull()).alias("missing"))
    rows = chosen.join(contexts, F.col("id") == F.col("question_id"))
    ordered = F.lower("question").contains("ordered")
    scorer = F.when(F.contains("answer", F.lit(",")) & ~ordered, "csv_set_ci").when(T.strip(F.col("answer")).rlike(r"^-?\d+(?:\.\d+)?$"), "exact_ci").otherwise("substring_ci")
    return rows.select(*_task("longmemeval", F.col("question_type"), F.col("id"), F.col("context"), F.col("question"), F.col("answer"), _none(), scorer, F.struct("domain", "environment", "missing")))


def conversation_pairs(turns: DataFrame, middle_third: bool = True, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, context, question, gold): user turns that an assistant turn follows; context is what was said before.

    Earlier turns are gathered once for each conversation; a pair takes its prefix. Of n pairs the middle third stays if asked for.
    """
    w = Window.partitionBy(id_col).orderBy("turn")
    pairs = turns.withColumns({"next_role": F.lead("role").over(w), "gold": F.lead("text").over(w), "place": F.row_number().over(w)}).where("role = 'user' and next_role = 'assistant'")
    said = turns.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("["), F.upper(t["role"]), F.lit("]: "), F.coalesce(t["text"], F.lit("")))).alias("said"))
    p = Window.partitionBy(id_col)
    kept = pairs.withColumns({"k": F.row_number().over(p.orderBy("turn")) - 1, "n": F.count(F.lit(1)).over(p)})
    if middle_third:
        kept = kept.where((F.col("k") >= F.floor(F.col("n") / 3)) & (F.col("k") < F.floor(2 * F.col("n") / 3)))
    return kept.join(said, id_col).select(id_col, "turn", F.array_join(F.slice("said", F.lit(1), F.col("place") - 1), "\n\n").alias("context"), F.col("text").alias("question"), F.substring("gold", 1, 4000).alias("gold"))


def spread_pairs(turns: DataFrame, id_col: str = "conv_id", shares: Sequence[float] = (0.3, 0.5, 0.7, 0.9), apart: int = 4, min_turns: int = 6, min_question: int = 20, min_gold: int = 80, min_tokens: int = 0, max_tokens: int = 1 << 40) -> DataFrame:
    """Pairs of good length spread over long conversations: for each share of the turns the nearest candidate at least ``apart`` turns from those chosen."""
    import pandas as pd

    n = turns.groupBy(id_col).agg(F.count(F.lit(1)).alias("turns")).where(F.col("turns") >= min_turns)
    good = conversation_pairs(turns, False, id_col).where((F.length("question") >= min_question) & (F.length("gold") >= min_gold) & T.tokens_est(F.col("context")).between(min_tokens, max_tokens))
    rows = good.select(id_col, "turn").join(n, id_col)
    kinds = dict(rows.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        total, free, taken = int(p["turns"].iloc[0]), sorted(p["turn"]), []
        for share in shares:
            open_ = [t for t in free if all(abs(t - x) >= apart for x in taken)]
            if open_:
                taken.append(min(open_, key=lambda t: (abs(t - share * total), t)))
        return pd.DataFrame({id_col: p[id_col].iloc[0], "turn": sorted(taken)})

    return good.join(rows.groupBy(id_col).applyInPandas(run, f"{id_col} {kinds[id_col]}, turn {kinds['turn']}"), [id_col, "turn"])


def episode_pairs(rows: DataFrame, repo: str = "repo", order: str = "sequence_rank") -> DataFrame:
    """Row i is the context of row i + 1 of the same repository."""
    w = Window.partitionBy(repo).orderBy(order)
    return rows.select(repo, order, F.substring("patch", 1, 4000).alias("context_patch"), F.slice("tests", 1, 5).alias("context_tests"), F.lead("instance_id").over(w).alias("task"), F.lead("problem").over(w).alias("question"), F.lead("patch").over(w).alias("gold")).where("task is not null")


def expanding_history(rows: DataFrame, episodes: int, shown: int = 500, ahead: int = 10, order: str = "ord") -> DataFrame:
    """(episode, context, question, gold): equal-width episodes; rows up to an episode's end (the first ``shown``), then the next ``ahead``. Rows: ord (from 1, dense), id, value."""
    total = rows.count()
    per = max(1, total // max(1, episodes))
    dims = rows.sparkSession.range(episodes).select((F.col("id") + 1).alias("episode"))
    slim = rows.select(F.col(order).alias("ord"), "id", "value")
    history = slim.where(F.col("ord") <= shown).join(F.broadcast(dims), F.col("ord") <= F.col("episode") * per)  # episodes: a parameter
    line = F.concat_ws(",", F.col("id").cast("string"), F.col("value").cast("string"))
    listed = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias(name)
    after = slim.withColumn("episode", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda k: F.floor((F.col("ord") - k) / per))))).where(F.col("episode").between(1, episodes) & F.col("ord").between(F.col("episode") * per + 1, F.col("episode") * per + ahead))
    gold = after.groupBy("episode").agg(listed("gold"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col("id").cast("string").alias("l")))), lambda x: x["l"]), ", ").alias("question"))
    return history.groupBy("episode").agg(listed("context")).join(gold, "episode")


def sliding_scans(scans: DataFrame, step: int = 10, back: int = 10, ahead: int = 5, order: str = "ord") -> DataFrame:
    """(episode, history, future): scans (ord from 0, peaks of freq, power) up to ep + ``back``, and the next ``ahead``, every ``step``."""
    peak = F.array_join(F.transform("peaks", lambda p: F.concat(F.format_string("%.2f", p["freq"].cast("double")), F.lit(" MHz@"), F.format_string("%.1f", p["power"].cast("double")), F.lit(" dBm"))), "; ")
    total = scans.agg(F.max(order)).first()[0]
    rows = scans.select(F.col(order).alias("ord"), peak.alias("line"))
    episodes = scans.sparkSession.range(0, (total or 0) + 1, step).select(F.col("id").alias("episode"))
    listed = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias(name)
    ep = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("ord") - back + 1) / step) * step).cast("long"), F.lit(total or 0).cast("long"), F.lit(step).cast("long")))
    past = rows.where(F.ceil((F.col("ord") - back + 1) / step) * step <= (total or 0)).withColumn("episode", ep).groupBy("episode").agg(listed("history"))
    nxt = rows.withColumn("episode", F.explode(F.transform(F.sequence(F.lit(back), F.lit(back + ahead - 1)), lambda k: F.col("ord") - k))).where((F.col("episode") >= 0) & (F.col("episode") % step == 0)).groupBy("episode").agg(listed("future"))
    return episodes.join(past, "episode").join(nxt, "episode")


def schema_tasks(questions: DataFrame, schema_text: str) -> DataFrame:
    return questions.select(*_task("clb", F.lit("database"), F.col("id").cast("string"), F.lit(schema_text), F.col("question"), F.col("answer"), _none(), F.lit("substring_ci"), F.struct(F.lit("database").alias("family"))))


def cohort_tasks(studies: DataFrame) -> DataFrame:
    """(study_id, pos, metadata, truth): two lists joined by position."""
    left = studies.select("study_id", F.posexplode("metadata").alias("pos", "metadata"))
    return left.join(studies.select("study_id", F.posexplode("truth").alias("pos", "truth")), ["study_id", "pos"])


def relabel(tasks: DataFrame, suffix: str, extra: Mapping[str, str]) -> DataFrame:
    """New ids and merged metadata."""
    merged = F.map_concat(F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*extra)), F.create_map(*[F.lit(x) for kv in extra.items() for x in kv]))
    return tasks.withColumns({"task_id": F.concat("task_id", F.lit(suffix)), "metadata": F.to_json(merged)})
