"""Event memory: log parsing, question routing, tiers, current state, packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

# The log line's form and the kinds that hold state.
LINE = r"^\[MEM\s+day=(-?\d+)\s+id=(\S+)\s+type=(\S+)\s+key=(\S+)\s+value=(.*?)\s+importance=(\d+)\]\s*(.*)$"
STATE_KINDS = ("preference", "profile", "decision")
HOT_DAYS, WARM_DAYS, TIER_ITEMS, BUDGET = 2, 14, 24, 4000


def parse_memory_log(contexts: DataFrame, id_col: str = "context_id", text_col: str = "context") -> DataFrame:
    """(context_id, day, event_id, kind, key, value, importance, text) of the lines that are memory events. A context may come in several rows of whole lines."""
    lines = contexts.select(F.col(id_col).alias("context_id"), F.explode(F.split(F.coalesce(text_col, F.lit("")), "\r?\n")).alias("line")).withColumn("line", T.strip(F.col("line"))).where(F.col("line").rlike(LINE))
    part = lambda k: F.regexp_extract("line", LINE, k)
    return lines.select("context_id", part(1).cast("int").alias("day"), part(2).alias("event_id"), part(3).alias("kind"), part(4).alias("key"), T.strip(part(5)).alias("value"), part(6).cast("int").alias("importance"), T.strip(part(7)).alias("text"))


def age() -> Column:
    return F.abs("day")


def render() -> Column:
    day = F.concat(F.when(F.col("day") < 0, "-").otherwise("+"), F.lpad(F.abs("day").cast("string"), 3, "0"))
    return F.concat(F.lit("[day="), day, F.lit(" id="), "event_id", F.lit(" type="), "kind", F.lit(" key="), "key", F.lit(" value="), "value", F.lit(" importance="), F.col("importance").cast("string"), F.lit("] "), "text")


def route(question: Column) -> tuple[Column, Column]:
    """(tiers, reason): the first rule that a question meets."""
    q = F.lower(question)
    rules = (
        ("last night|yesterday|today|recent", ("L0", "L1"), "recent exact recall"),
        ("usually|most often|least often|least common|typical|pattern|how many|count|times", ("L2",), "pattern/count or semantic recall"),
        ("current|now|latest", ("L2", "L1"), "current/stale-update recall"),
        ("never mentioned|not mentioned|unknown", ("L3",), "abstention check against cold archive"),
    )
    tiers = reason = None
    for words, names, why in rules:
        arr = F.array(*[F.lit(n) for n in names])
        tiers = F.when(q.rlike(words), arr) if tiers is None else tiers.when(q.rlike(words), arr)
        reason = F.when(q.rlike(words), why) if reason is None else reason.when(q.rlike(words), why)
    aged = T.requested_age(question).isNotNull()
    return (
        tiers.when(aged, F.array(F.lit("L1"), F.lit("L3"))).otherwise(F.array(F.lit("L2"), F.lit("L3"))),
        reason.when(aged, "old exact recall with cold fallback").otherwise("default semantic plus archive retrieval"),
    )


def concerns(question: Column) -> Column:
    """Whether an event is of the kind that a question asks about; without a named kind, any but notes."""
    q = F.lower(question)
    return (
        F.when(q.rlike("dinner|eat|ate"), (F.col("kind") == "meal") & (F.col("key") == "dinner"))
        .when(F.contains(q, F.lit("tea")), (F.col("kind") == "preference") & (F.col("key") == "tea"))
        .when(q.rlike("project|decision"), F.col("kind") == "decision").otherwise(F.col("kind") != "note")
    )


def content_terms(question: Column) -> Column:
    """Distinct lower-case words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*T.STOP_MEMORY)))


def _asked(events: DataFrame, questions: DataFrame) -> DataFrame:
    """Events with the questions of their context (question_id, question), and what they ask for."""
    q = questions.select("question_id", "context_id", "question").withColumns({"asked_age": T.requested_age(F.col("question")), "terms": content_terms(F.col("question"))})
    return events.join(q, "context_id")


def _numbered(rows: DataFrame, tier: str, order: Sequence[Column], item: Column, most: int) -> DataFrame:
    """(question_id, tier, ord, item): the first ``most`` of each question."""
    ranked = rows.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("ord") <= most)
    return ranked.select("question_id", F.lit(tier).alias("tier"), "ord", item.alias("item"))


def _or_absent(items: DataFrame, questions: DataFrame, tier: str, line: Column) -> DataFrame:
    """A row that says so for questions without items."""
    none = questions.join(items.select("question_id").distinct(), "question_id", "left_anti")
    return items.unionByName(none.select("question_id", F.lit(tier).alias("tier"), F.lit(1).alias("ord"), line.alias("item")))


def _relevant(asked: DataFrame) -> DataFrame:
    """Events that concern the question; where only notes are left for a question without a named kind, those."""
    named = F.lower("question").rlike("dinner|eat|ate|tea|project|decision")
    marked = asked.withColumn("hit", concerns(F.col("question")))
    any_hit = F.max("hit").over(Window.partitionBy("question_id"))
    return marked.withColumn("any", any_hit).where(F.col("hit") | (~named & ~F.col("any")))


def hot_tier(events: DataFrame, questions: DataFrame, hot_days: int = HOT_DAYS, most: int = TIER_ITEMS) -> DataFrame:
    """L0: the last events of at most ``hot_days`` days that the question is about, oldest first."""
    rows = _relevant(_asked(events.where(age() <= hot_days), questions))
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("day"), F.desc("event_id")))).where(F.col("back") <= most)
    return _numbered(last, "L0", [F.col("day"), F.col("event_id")], render(), most)


def episodic_tier(events: DataFrame, questions: DataFrame, warm_days: int = WARM_DAYS, most: int = TIER_ITEMS) -> DataFrame:
    """L1: events of the age that is asked for; else a line a day over the warm days, newest first."""
    asked = _asked(events, questions)
    exact = _numbered(_relevant(asked.where(age() == F.col("asked_age"))), "L1", [F.col("day"), F.col("event_id")], render(), most)
    dated = questions.withColumn("asked_age", T.requested_age(F.col("question"))).where(F.col("asked_age").isNotNull())
    exact = _or_absent(exact, dated, "L1", F.concat(F.lit("No event found for age "), F.col("asked_age").cast("string"), F.lit(" days ago in warm episodic memory.")))
    warm = asked.where(F.col("asked_age").isNull() & (age() <= warm_days))
    facts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat("kind", F.lit("/"), "key", F.lit("="), "value").alias("f")))), lambda x: x["f"])
    days = warm.groupBy("question_id", "day").agg(F.array_join(facts, "; ").alias("facts"))
    day = F.concat(F.when(F.col("day") < 0, "-").otherwise("+"), F.lpad(F.abs("day").cast("string"), 3, "0"))
    return exact.unionByName(_numbered(days, "L1", [F.desc("day")], F.concat(F.lit("day "), day, F.lit(": "), "facts"), most))


def current_state(events: DataFrame, keys: Sequence[str] = ("context_id", "kind", "key"), kinds: Sequence[str] | None = STATE_KINDS) -> DataFrame:
    """The latest value of each key (largest day, then event id): keys, value, day, event_id. Other kinds are decoys and ignored; None takes all."""
    rows = events if kinds is None else events.where(F.col("kind").isin(*kinds))
    last = F.max_by(F.struct("value", "day", "event_id"), F.struct("day", "event_id"))
    return rows.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.value", "s.day", "s.event_id")


def value_counts(events: DataFrame, keys: Sequence[str] = ("context_id", "kind", "key")) -> DataFrame:
    """(keys, value, n, first): how often each value occurs and when it was first seen."""
    return events.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "event_id")).alias("first"))


def most_common(events: DataFrame, keys: Sequence[str] = ("context_id", "kind", "key"), least: bool = False) -> DataFrame:
    """The most common value of each key, the first seen among equals; or the least common, the first by name."""
    counts = value_counts(events, keys)
    pick = F.min_by(F.struct("value", "n"), F.struct("n", "value")) if least else F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "first"))
    return counts.groupBy(*keys).agg(pick.alias("s")).select(*keys, "s.value", "s.n")


def semantic_tier(events: DataFrame, questions: DataFrame, kind: str = "meal", key: str = "dinner", pinned: int = 8) -> DataFrame:
    """L2: counts and the most common value of one kind and key, current state, pinned events that the question names."""
    q = questions.select("question_id", "context_id")
    chosen = events.where((F.col("kind") == kind) & (F.col("key") == key))
    counts = value_counts(chosen).groupBy("context_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "; ").alias("parts"))
    label = key.capitalize()
    one = counts.select("context_id", F.lit(1).alias("a"), F.lit("").alias("b"), F.concat(F.lit(f"{label} counts across all {kind} events: "), "parts", F.lit(".")).alias("item"))
    top = most_common(chosen).select("context_id", F.lit(2).alias("a"), F.lit("").alias("b"), F.concat(F.lit(f"Most common {key} pattern: "), "value", F.lit(" ("), F.col("n").cast("string"), F.lit(" mentions).")).alias("item"))
    day = F.concat(F.when(F.col("day") < 0, "-").otherwise("+"), F.lpad(F.abs("day").cast("string"), 3, "0"))
    state = current_state(events).select("context_id", F.lit(3).alias("a"), F.concat_ws("\n", "kind", "key").alias("b"), F.concat(F.lit("Current "), "kind", F.lit(" "), "key", F.lit(": "), "value", F.lit(" (from day "), day, F.lit(", event "), "event_id", F.lit(").")).alias("item"))
    shared = one.unionByName(top).unionByName(state).join(q, "context_id").select("question_id", "a", "b", "item")
    named = lambda c: F.array_contains("terms", F.lower(c))
    pins = _asked(events.where("importance >= 3"), questions).where(named("key") | named("kind") | named("value"))
    pins = pins.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy("day", "event_id"))).where(F.col("k") <= pinned)
    pins = pins.select("question_id", F.lit(4).alias("a"), F.lpad(F.col("k").cast("string"), 6, "0").alias("b"), F.concat(F.lit("Pinned/high-importance memory: "), render()).alias("item"))
    every = shared.unionByName(pins)
    return every.select("question_id", F.lit("L2").alias("tier"), F.row_number().over(Window.partitionBy("question_id").orderBy("a", "b")).alias("ord"), "item")


def _matches() -> Column:
    hay = F.lower(F.concat_ws(" ", "kind", "key", "value", "text"))
    return F.size(F.filter("terms", lambda t: F.contains(hay, t)))


def cold_tier(events: DataFrame, questions: DataFrame, most: int = TIER_ITEMS) -> DataFrame:
    """L3: events of the age that is asked for; else those that share most words with the question."""
    asked = _asked(events, questions)
    exact = _numbered(_relevant(asked.where(age() == F.col("asked_age"))), "L3", [F.col("day"), F.col("event_id")], render(), most)
    scored = asked.where(F.col("asked_age").isNull()).withColumn("score", _matches()).where("score > 0")
    found = exact.unionByName(_numbered(scored, "L3", [F.desc("score"), age(), F.col("event_id")], render(), most))
    a = T.requested_age(F.col("question"))
    return _or_absent(found, questions, "L3", F.when(a.isNotNull(), F.concat(F.lit("No raw archive event found for age "), a.cast("string"), F.lit(" days ago."))).otherwise("No matching cold-archive evidence found for the query terms."))


def flat_tier(events: DataFrame, questions: DataFrame, most: int = TIER_ITEMS) -> DataFrame:
    """The flat baseline: shared words, +8 for the age that is asked for."""
    scored = _asked(events, questions).withColumn("score", _matches() + F.when(age() == F.col("asked_age"), 8).otherwise(0)).where("score > 0")
    found = _numbered(scored, "FLAT", [F.desc("score"), age(), F.col("event_id")], render(), most)
    return _or_absent(found, questions, "FLAT", F.lit("No raw events matched the query terms in the flat retriever."))


def memory_tiers(events: DataFrame, questions: DataFrame) -> DataFrame:
    """The tiers that each question is routed to: question_id, tier, place (of the tier in the packet), ord, item. A tier sees only the questions that go to it."""
    tiers, _ = route(F.col("question"))
    to = lambda tier: questions.where(F.array_contains(tiers, tier))
    place = F.array_position(F.array(*[F.lit(x) for x in ("L0", "L1", "L2", "L3")]), F.col("tier"))
    every = hot_tier(events, to("L0")).unionByName(episodic_tier(events, to("L1"))).unionByName(semantic_tier(events, to("L2"))).unionByName(cold_tier(events, to("L3")))
    return every.withColumn("place", place.cast("int"))


def memory_packets(items: DataFrame, questions: DataFrame, budget_tokens: int = BUDGET) -> DataFrame:
    """(question_id, tiers, evidence, tokens): tiers in order, the last ones dropped while over budget (the first always stays)."""
    titles = {"L0": "L0 HOT RECENT RAW MEMORY", "L1": "L1 WARM EPISODIC MEMORY", "L2": "L2 SEMANTIC / CONSOLIDATED MEMORY", "L3": "L3 COLD RAW ARCHIVE", "FLAT": "FLAT RAW RETRIEVAL MEMORY"}
    named = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    place = F.col("place") if "place" in items.columns else F.lit(1)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: F.concat(F.lit("- "), x["item"])), "\n")
    tiers = items.withColumn("place", place).groupBy("question_id", "place", "tier").agg(lines.alias("body")).withColumn("text", F.concat(F.lit("## "), F.element_at(named, F.col("tier")), F.lit("\n"), "body"))
    w = Window.partitionBy("question_id").orderBy("place")
    fit = tiers.withColumn("used", F.sum(F.length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w)).where((F.col("used") <= 4 * budget_tokens) | (F.col("k") == 1))
    packed = fit.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "tier", "text"))).alias("t"))
    _, reason = route(F.col("question"))
    head = F.concat(F.lit("HIERARCHICAL MEMORY PACKET\nQuestion used for routing: "), "question", F.lit("\nRoute reason: "), reason, F.lit("\n\n"))
    out = questions.join(packed, "question_id").withColumn("evidence", F.concat(head, F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.lit("\n")))
    return out.select("question_id", F.transform("t", lambda x: x["tier"]).alias("tiers"), "evidence", T.tokens_est(F.col("evidence")).alias("tokens"))


def derive_gold(events: DataFrame) -> DataFrame:
    """Gold answers of memory questions for each context: query_type, gold. The aggregates behind them are one pass each."""
    dinner = events.where("kind = 'meal' and key = 'dinner'")
    named = lambda df, kind: df.select("context_id", F.lit(kind).alias("query_type"), F.col("value").cast("string").alias("gold"))
    state = current_state(events)
    return (
        named(dinner.where(age() == 1).groupBy("context_id").agg(F.max_by("value", "event_id").alias("value")), "last_night")
        .unionByName(named(dinner.groupBy("context_id", "day").agg(F.max_by("value", "event_id").alias("value")).select("context_id", F.col("value"), "day").where(F.abs("day") == 30), "thirty_days_ago"))
        .unionByName(named(most_common(dinner), "most_common")).unionByName(named(most_common(dinner, least=True), "least_common"))
        .unionByName(dinner.groupBy("context_id").agg(F.count(F.lit(1)).alias("n")).select("context_id", F.lit("count").alias("query_type"), F.col("n").cast("string").alias("gold")))
        .unionByName(named(state.where("kind = 'preference'"), "latest_preference")).unionByName(named(state.where("kind = 'decision'"), "latest_decision"))
    )


def planted_counts(texts: DataFrame, event: str, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """How many '<event> at step N' lines each text has."""
    return texts.select(id_col, F.regexp_count(F.col(text_col), F.lit(rf"\b{event} at step \d+")).alias("n"))


def planted_bindings(texts: DataFrame, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, entity, value) of sentences like 'E uses V.'; the last one of an entity wins."""
    units = texts.select(F.col(id_col).alias("context_id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(r"\b([A-Z]\w*) uses ([\w-]+)\."), F.lit(0))).alias("at", "unit"))
    part = lambda k: F.regexp_extract("unit", r"^(\w+) uses ([\w-]+)\.", k)
    return units.select("context_id", part(1).alias("entity"), part(2).alias("value"), "at").groupBy("context_id", "entity").agg(F.max_by("value", "at").alias("value"))


def planted_updates(texts: DataFrame, id_col: str = "context_id", text_col: str = "text") -> DataFrame:
    """(context_id, value): the latest value that a sentence sets, changes to or calls the one now; sentences that speak of a rejected one don't count."""
    form = r"(?:set to|changed to|now)\s+([\w.-]*\w)"
    units = texts.select(F.col(id_col).alias("context_id"), F.posexplode(F.split(text_col, T.SENTENCE)).alias("at", "unit")).where(F.col("unit").rlike(form) & ~F.lower("unit").contains("rejected"))
    return units.groupBy("context_id").agg(F.max_by(F.regexp_extract("unit", form, 1), "at").alias("value"))
