"""Story events: extraction with coreference, densest block, state fold, derived facts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from foliant.functions.text import SENTENCE
from foliant.operators.order import PART, deal, scan
from foliant.session import cut, ship

# Names, places, things and verbs of the story tasks.
NAMES = ("Mary", "John", "Sandra", "Daniel", "Fred", "Bill", "Jeff", "Julie")
PLACES = ("bathroom", "bedroom", "garden", "hallway", "kitchen", "office", "school", "cinema", "park")
THINGS = ("football", "apple", "milk")
MOVE, PICK, DROP, GIVE = "(?:went(?: back)?|journeyed|travelled|traveled|moved)", "(?:picked up|grabbed|got|took)", "(?:dropped|discarded|put down|left)", "(?:gave|handed|passed)"
GAP = 5000

_N, _P, _T = "|".join(NAMES), "|".join(PLACES), "|".join(THINGS)
_TO = rf"\s+{MOVE}\s+to\s+the\s+({_P})\b"
_FORMS = {
    "pair": rf"(?i)\b({_N})\s+and\s+({_N}){_TO}",
    "they": rf"(?i)\b(they){_TO}",
    "pronoun": rf"(?i)\b(he|she){_TO}",
    "single": rf"(?i)\b({_N}){_TO}",
    "pickup": rf"(?i)\b({_N})\s+{PICK}\s+the\s+({_T})\b",
    "drop": rf"(?i)\b({_N})\s+{DROP}\s+the\s+({_T})\b",
    "transfer": rf"(?i)\b({_N})\s+{GIVE}\s+the\s+({_T})\s+to\s+({_N})\b",
}
_GROUPS = {"pair": 3, "they": 2, "pronoun": 2, "single": 2, "pickup": 2, "drop": 2, "transfer": 3}


def sentence_offsets(contexts: DataFrame, id_col: str = "context_id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """(context_id, position, sentence): non-empty sentences with their offsets in code points.

    A context may come in several rows of whole sentences, in the order of ``part_col``: offsets are then those
    of its rows joined by one character each, and no row, task or window has to hold a long context.
    """
    return _sentences(contexts, id_col, text_col, part_col).drop(PART)


def _sentences(contexts: DataFrame, id_col: str, text_col: str, part_col: str | None) -> DataFrame:
    """As sentence_offsets, dealt out by ranges of contexts and places."""
    ship(contexts.sparkSession)
    rows = contexts.select(F.col(id_col).cast("string").alias("context_id"), F.coalesce(text_col, F.lit("")).alias("text"), (F.lit(0) if part_col is None else F.col(part_col)).alias("nth"))
    rows = scan(deal(rows, "context_id", "nth"), ["context_id"], ["nth"], {"base": F.length("text") + 1})
    marked = F.split(F.regexp_replace("text", f"({SENTENCE})", "\u0001$1\u0002"), "[\u0001\u0002]")
    parts = rows.select(PART, "context_id", F.col("base").cast("long").alias("base"), marked.alias("sentence"))
    placed = parts.withColumn("position", _before(F.transform("sentence", F.length)))
    found = placed.select(PART, "context_id", "base", F.inline(F.filter(F.arrays_zip("position", "sentence"), lambda x: x["sentence"].rlike(r"\S") & x["sentence"].rlike(r"(?i)[a-z]"))))
    return found.select(PART, "context_id", (F.col("position") + F.col("base")).alias("position"), "sentence")


@F.pandas_udf(ArrayType(LongType()))
def _before(lengths: pd.Series) -> pd.Series:
    """For each length of a list, the sum of those before it."""
    return lengths.map(lambda x: np.cumsum(x) - x)


def matched_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences that any form fits, with the forms' groups as arrays (null where a form doesn't fit). Prose goes before Python sees a row."""
    out = sentences.where(F.col("sentence").rlike("|".join(f"(?:{f})" for f in _FORMS.values())))
    for name, form in _FORMS.items():
        out = out.withColumn(name, F.when(F.col("sentence").rlike(form), F.array(*[F.regexp_extract("sentence", form, k + 1) for k in range(_GROUPS[name])])))
    return out


def _resolved(rows: DataFrame) -> DataFrame:
    """Adds people (who moves), place and named: whether the row's movement is that of a name on its own.

    ``assumed`` says which rows' movements are. What "they" and "he" stand for comes from
    earlier rows alone: the last one or two names that moved (group), and the last ones that did
    anything or were given something (referents). Both are scans over ranges of places, so a context of any size is many tasks'.
    """
    place_of = (["context_id"], ["position"])
    name = lambda form, k=0: F.initcap(F.lower(F.get(form, F.lit(k))))
    both, alone = F.array(name("pair"), name("pair", 1)), F.array(name("single"))
    grouped = cut(scan(rows, *place_of, lasts={"group": F.when(F.col("pair").isNotNull(), both).when(F.col("assumed"), alone)}))
    theirs = F.col("pair").isNull() & F.col("they").isNotNull() & F.col("group").isNotNull()
    moved = F.when(F.col("pair").isNotNull(), both).when(theirs, F.col("group")).when(F.col("assumed"), alone)
    # What a row says last about someone counts: a thing given, put down, taken, then a movement.
    said = F.coalesce(F.when(F.col("transfer").isNotNull(), F.array(name("transfer", 2))), F.when(F.col("drop").isNotNull(), F.array(name("drop"))), F.when(F.col("pickup").isNotNull(), F.array(name("pickup"))), moved)
    told = scan(grouped, *place_of, lasts={"referents": said})
    his = F.col("pair").isNull() & ~theirs & F.col("pronoun").isNotNull() & F.coalesce(F.size("referents") == 1, F.lit(False))
    own = F.col("pair").isNull() & ~theirs & ~his & F.col("single").isNotNull()
    people = F.when(F.col("pair").isNotNull(), both).when(theirs, F.col("group")).when(his, F.col("referents")).when(own, alone)
    place = F.when(F.col("pair").isNotNull(), F.get("pair", F.lit(2))).when(theirs, F.get("they", F.lit(1))).when(his, F.get("pronoun", F.lit(1))).when(own, F.get("single", F.lit(1)))
    return told.withColumns({"named": own, "people": people, "place": F.lower(place)})


def story_candidates(contexts: DataFrame, id_col: str = "context_id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """All events of each context, with coreference; numbered from 1 by place, a row's movement before what happens to things.

    Coreference is a matter of scans over a context's matching sentences (see _resolved). Only a
    sentence with a pronoun's movement beside a name's needs to know how earlier ones of its
    kind came out: such contexts are resolved again until nothing changes, each time one more is settled at least.
    """
    return _candidates(contexts, id_col, text_col, part_col).drop(PART)


def _candidates(contexts: DataFrame, id_col: str, text_col: str, part_col: str | None) -> DataFrame:
    """As story_candidates, dealt out by ranges of contexts and places."""
    rows = cut(matched_sentences(_sentences(contexts, id_col, text_col, part_col)))
    mixed = F.col("pair").isNull() & F.col("single").isNotNull() & (F.col("they").isNotNull() | F.col("pronoun").isNotNull())
    found = _resolved(rows.withColumn("assumed", F.col("pair").isNull() & F.col("single").isNotNull() & ~mixed))
    if not rows.where(mixed).isEmpty():
        found = cut(found)
        while not found.where("named <> assumed").isEmpty():
            found = cut(_resolved(found.withColumn("assumed", F.col("named")).drop("named", "people", "place", "group", "referents")))
    name, thing = lambda form, k=0: F.initcap(F.lower(F.get(form, F.lit(k)))), lambda form: F.lower(F.get(form, F.lit(1)))
    kinds = "struct<kind:string,people:array<string>,location:string,obj:string,source:string,target:string>"

    def event(there, kind, people, location=F.lit(None), obj=F.lit(None), source=F.lit(None), target=F.lit(None)):
        return F.when(there, F.struct(F.lit(kind).alias("kind"), people.alias("people"), location.alias("location"), obj.alias("obj"), source.alias("source"), target.alias("target")).cast(kinds))

    events = F.array_compact(F.array(
        event(F.col("place").isNotNull(), "movement", F.col("people"), F.col("place")),
        event(F.col("pickup").isNotNull(), "pickup", F.array(name("pickup")), obj=thing("pickup")),
        event(F.col("drop").isNotNull(), "drop", F.array(name("drop")), obj=thing("drop")),
        event(F.col("transfer").isNotNull(), "transfer", F.array(name("transfer"), name("transfer", 2)), obj=thing("transfer"), source=name("transfer"), target=name("transfer", 2)),
    ))
    each = cut(found.select(PART, "context_id", "position", F.col("sentence").alias("text"), F.posexplode(events).alias("at", "e")))
    numbered = scan(each, ["context_id"], ["position", "at"], {"idx": F.lit(1)}).withColumn("idx", (F.col("idx") + 1).cast("int"))
    return numbered.select(PART, "context_id", "idx", "e.kind", "text", "position", "e.people", "e.location", "e.obj", "e.source", "e.target")


def densest_block(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Of events split where more than ``gap`` characters lie between two, the block with most of them, the earliest among equals; two events or fewer stay. Renumbers idx.

    Blocks are numbered by scans over ranges of places, so a context of any size is many tasks'. A scan reads its rows twice, so what one
    is made of is kept.
    """
    places = (["context_id"], ["position", "idx"])
    dealt = events if PART in events.columns else deal(events, "context_id", "position", "idx")
    new = F.coalesce(F.col("position") - F.col("last") > gap, F.lit(False)).cast("int")
    split = cut(scan(dealt, *places, lasts={"last": F.col("position")}).withColumn("new", new))
    blocks = cut(scan(split, *places, {"block": F.col("new")}).withColumn("block", F.col("block") + F.col("new")))
    sizes = blocks.groupBy("context_id", "block").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("context_id").agg(F.sum("n").alias("total"), F.max_by("block", F.struct("n", -F.col("block"))).alias("best"))
    kept = cut(blocks.join(cut(best), "context_id").where((F.col("total") <= 2) | (F.col("block") == F.col("best"))))
    renumbered = scan(kept.withColumnRenamed("idx", "old"), ["context_id"], ["position", "old"], {"idx": F.lit(1)}).withColumn("idx", (F.col("idx") + 1).cast("int"))
    return renumbered.select(*[c for c in events.columns if c != PART])


def extract_story_events(contexts: DataFrame, id_col: str = "context_id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """The events of each context's densest block. Kept, as what is told of a story reads them several times."""
    return cut(densest_block(cut(_candidates(contexts, id_col, text_col, part_col))))


def _moves(events: DataFrame) -> DataFrame:
    return events.where("kind = 'movement' and location is not null").select("context_id", F.explode("people").alias("person"), "idx", "location")


def person_moves(events: DataFrame) -> DataFrame:
    """(context_id, person, idx, location, previous): each person's history."""
    who = (["context_id", "person"], ["idx"])
    return scan(deal(_moves(events), *who[0], *who[1]), *who, lasts={"previous": F.col("location")}).drop(PART)


def person_locations(events: DataFrame) -> DataFrame:
    """(context_id, person, location) at the end."""
    return _moves(events).groupBy("context_id", "person").agg(F.max_by("location", "idx").alias("location"))


def object_state(events: DataFrame) -> DataFrame:
    """(context_id, obj, holder, location) at the end, by an as-of join of each thing's last event to its actor's moves.

    What someone holds is where they went last; what was dropped is where its actor last was then.
    """
    target = F.when(F.col("kind") == "transfer", F.col("target")).otherwise(F.get("people", F.lit(0)))
    last = events.where("obj is not null").groupBy("context_id", "obj").agg(F.max_by(F.struct("idx", "kind", target.alias("actor")), "idx").alias("e"))
    last = last.select("context_id", "obj", F.col("e.idx").alias("at"), F.col("e.kind").alias("kind"), F.col("e.actor").alias("person"))
    moves = _moves(events).select("context_id", "person", "idx", F.col("location").alias("went"))
    seen = last.join(moves, ["context_id", "person"], "left").where(F.col("idx").isNull() | (F.col("kind") != "drop") | (F.col("idx") <= F.col("at")))
    where = seen.groupBy("context_id", "obj").agg(F.max_by("went", "idx").alias("location"))
    return last.select("context_id", "obj", F.when(F.col("kind") != "drop", F.col("person")).alias("holder")).join(where, ["context_id", "obj"], "left")


def before_location(events: DataFrame, targets: DataFrame) -> DataFrame:
    """For (context_id, person, target): where the person was before their first visit to target that has a place before it."""
    visits = person_moves(events).join(targets, ["context_id", "person"]).where((F.col("location") == F.col("target")) & F.col("previous").isNotNull())
    return visits.groupBy("context_id", "person", "target").agg(F.min_by("previous", "idx").alias("answer"))


def asked_about(questions: DataFrame) -> DataFrame:
    """Adds names, objects and places (arrays) that a question speaks of, whatever the case."""
    q = F.lower("question")
    found = lambda words: F.array_compact(F.array(*[F.when(q.rlike(rf"\b{w.lower()}\b"), w) for w in words]))
    return questions.withColumns({"names": found(NAMES), "objects": found(THINGS), "places": found(PLACES)})


def trace_tier(events: DataFrame, questions: DataFrame, most: int = 40) -> DataFrame:
    """(question_id, idx, kind, text): the last events about a question's names, things or places; the last of all if none is."""
    rows = events.join(asked_about(questions), "context_id")
    hit = F.arrays_overlap("people", "names") | F.coalesce(F.array_contains("objects", F.col("obj")), F.lit(False)) | F.coalesce(F.array_contains("places", F.col("location")), F.lit(False))
    marked = rows.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("any", F.max("hit").over(Window.partitionBy("question_id"))).where(F.col("hit") | ~F.col("any"))
    back = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("idx")))
    return marked.withColumn("back", back).where(F.col("back") <= most).select("question_id", "idx", "kind", "text")


def derived_facts(events: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, fact): current and before-locations of the names, holders and places of the things that a question speaks of."""
    asked = asked_about(questions)
    people = asked.select("question_id", "context_id", "question", F.explode("names").alias("person"))
    now = people.join(person_locations(events), ["context_id", "person"]).select("question_id", F.concat(F.lit("Derived current location for "), "person", F.lit(": "), "location", F.lit(".")).alias("fact"))
    target = F.lower(F.regexp_extract("question", rf"(?i)before\s+the\s+({_P})", 1))
    wanted = people.withColumn("target", target).where("target <> ''")
    before = wanted.join(before_location(events, wanted.select("context_id", "person", "target").distinct()), ["context_id", "person", "target"])
    then = before.select("question_id", F.concat(F.lit("Derived before-location for "), "person", F.lit(": before "), "target", F.lit(", "), "person", F.lit(" was in the "), "answer", F.lit(".")).alias("fact"))
    things = asked.select("question_id", "context_id", "question", F.explode("objects").alias("obj")).join(object_state(events), ["context_id", "obj"])
    held = things.where(F.lower("question").contains("who") & F.col("holder").isNotNull()).select("question_id", F.concat(F.lit("Derived holder for "), "obj", F.lit(": "), "holder", F.lit(".")).alias("fact"))
    put = things.where("location is not null").select("question_id", F.concat(F.lit("Derived current location for "), "obj", F.lit(": "), "location", F.lit(".")).alias("fact"))
    return now.unionByName(then).unionByName(held).unionByName(put)


def state_packets(events: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, evidence): trace, current state with derived facts, and a line on the archive."""
    trace = trace_tier(events, questions).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("trace"))
    where = person_locations(events).groupBy("context_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("person", F.lit("="), "location"))), "; ").alias("people"))
    state = object_state(events).groupBy("context_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("obj", F.lit(": held_by="), F.coalesce("holder", F.lit("none")), F.lit(", location="), F.coalesce("location", F.lit("unknown"))))), "; ").alias("things"))
    facts = derived_facts(events, questions).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("facts"))
    counts = events.groupBy("context_id").agg(F.count(F.lit(1)).alias("n"))
    rows = questions.join(trace, "question_id", "left").join(facts, "question_id", "left").join(where, "context_id", "left").join(state, "context_id", "left").join(counts, "context_id", "left")
    evidence = F.concat_ws(
        "\n", F.lit("## L1 EVENT TRACE"), F.coalesce("trace", F.lit("- No extracted event trace.")), F.lit("## L2 STATE TABLE"), F.concat(F.lit("Current person locations: "), "people", F.lit(".")),
        F.concat(F.lit("Current object state: "), "things", F.lit(".")), "facts", F.lit("## L3 RAW ARCHIVE SUMMARY"), F.concat(F.lit("Extracted "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" story events; other prose was ignored.")),
    )
    return rows.select("question_id", evidence.alias("evidence"))

