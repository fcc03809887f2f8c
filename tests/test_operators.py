"""Operators on small literal inputs, and against plain restatements."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import chunk as C
from foliant.operators import compress as K
from foliant.operators import evaluate as E
from foliant.operators import memory as M
from foliant.operators import normalize as N
from foliant.operators import panel as P
from foliant.operators import retrieve as R
from foliant.operators import story as S
from foliant.sources import tasks as tasks_io


def _story(spark, text):
    return S.extract_story_events(spark.createDataFrame([("c", text)], "context_id string, text string"))


def test_story_coreference(spark):
    events = _story(spark, "Mary and Daniel went back to the garden. Then they travelled to the bathroom. Daniel and John journeyed to the hallway. Afterwards they moved to the kitchen.")
    assert events.count() == 4
    assert {r["person"]: r["location"] for r in S.person_locations(events).collect()} == {"Mary": "bathroom", "Daniel": "kitchen", "John": "kitchen"}


def test_story_before_and_objects(spark):
    events = _story(spark, "Bill went to the school. Fred moved to the office. Julie went to the park. Fred journeyed to the cinema. Fred got the milk. Fred went to the park. Bill picked up the apple. Bill dropped the apple. Bill moved to the cinema.")
    asked = spark.createDataFrame([(1, "c", "Where was Fred before the cinema?")], "question_id int, context_id string, question string")
    facts = [r["fact"] for r in S.derived_facts(events, asked).collect()]
    assert any("was in the office" in f for f in facts)
    state = {r["obj"]: (r["holder"], r["location"]) for r in S.object_state(events).collect()}
    assert state == {"milk": ("Fred", "park"), "apple": (None, "school")}
    assert S.state_packets(events, asked).count() == 1


def test_story_prose_is_no_event(spark):
    assert [r["location"] for r in _story(spark, "Mary went to Didlum's shop. Mary journeyed to the bathroom.").collect()] == ["bathroom"]


def test_state_equals_a_fold_over_random_stories(spark):
    rng, stories, wanted = random.Random(5), [], {}
    for c in range(20):
        sents, at, held, where = [], {}, {}, {}
        for _ in range(25):
            who, thing = rng.choice(S.NAMES), rng.choice(S.THINGS)
            kind = rng.randrange(4)
            if kind == 0:
                place = rng.choice(S.PLACES)
                sents.append(f"{who} went to the {place}.")
                at[who] = place
                where.update({o: place for o, h in held.items() if h == who})
            elif kind == 1:
                sents.append(f"{who} grabbed the {thing}.")
                held[thing], where[thing] = who, at.get(who)
            elif kind == 2:
                sents.append(f"{who} dropped the {thing}.")
                held[thing], where[thing] = None, at.get(who)
            else:
                other = rng.choice([n for n in S.NAMES if n != who])
                sents.append(f"{who} gave the {thing} to {other}.")
                held[thing], where[thing] = other, at.get(other)
        stories.append((f"c{c}", " ".join(sents)))
        wanted.update({(f"c{c}", o): (held[o], where[o]) for o in held})
    events = S.extract_story_events(spark.createDataFrame(stories, "context_id string, text string"))
    assert {(r["context_id"], r["obj"]): (r["holder"], r["location"]) for r in S.object_state(events).collect()} == wanted


@pytest.mark.parametrize("question, tiers", [("what happened last night", ["L0", "L1"]), ("what do I usually eat", ["L2"]), ("how many teas", ["L2"]), ("what was it 30 days ago", ["L1", "L3"]), ("the current plan", ["L2", "L1"])])
def test_routing(spark, question, tiers):
    got, _ = M.route(F.col("q"))
    assert spark.createDataFrame([(question,)], "q string").select(got.alias("t")).first()["t"] == tiers


def test_memory_log_and_tiers(spark):
    lines = "\n".join(["noise", "[MEM day=-001 id=a type=meal key=dinner value=ramen importance=1] noodles", "[MEM day=-030 id=b type=meal key=dinner value=soup importance=1] broth", "[MEM day=-003 id=c type=preference key=tea value=mint importance=3] now mint", "[MEM day=-009 id=d type=preference key=tea value=green importance=1] green"])
    events = M.parse_memory_log(spark.createDataFrame([(1, lines), (2, None)], "context_id int, context string"))
    assert events.count() == 4
    assert [r["value"] for r in M.current_state(events).collect()] == ["mint"]
    asked = spark.createDataFrame([(1, 1, "What did I eat last night?"), (2, 1, "What did I eat 30 days ago?"), (3, 1, "What did I eat 5 days ago?")], "question_id int, context_id int, question string")
    packets = {r["question_id"]: r["evidence"] for r in M.memory_packets(M.memory_tiers(events, asked), asked).collect()}
    assert "ramen" in packets[1] and "soup" in packets[2] and "No event found for age 5" in packets[3]


def test_chunks_and_pages(spark):
    text = "para one.\n\npara two is longer.\n\n" + "x" * 200 + "\n\nend"
    got = [t for _, t in C.chunks_of(text, 10)]
    assert "".join(got) == text and max(map(len, got)) <= 48
    pages = list(C.pages_of("line one.\nline two.\nline three and more.\n" * 9, 20, 5))
    assert pages[0][1] == 0 and pages[-1][2] == len("line one.\nline two.\nline three and more.\n" * 9)
    assert all(a[2] > b[1] for a, b in zip(pages, pages[1:], strict=False)) and all(p[5].endswith("\n") for p in pages[:-1])
    assert [p[:3] for p in C.pages_of("", 20, 5)] == [(1, 0, 0)]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "context_id int, text string")
    assert {r["context_id"] for r in C.page_contexts(df, 20, 2).collect()} == {1, 2, 3}
    assert C.chunk_contexts(df.limit(0), 10).count() == 0


def test_planting(spark):
    docs = spark.createDataFrame([(1, "a. b. c. d"), (2, "one")], "context_id int, text string")
    needles = spark.createDataFrame([(1, 1, 0.5, "N1"), (1, 2, 0.5, "N2"), (1, 3, 1.0, "N3")], "context_id int, ord int, position double, text string")
    assert {r["context_id"]: r["text"] for r in C.plant_passages(docs, needles).collect()} == {1: "a. b. c N1 N2. d N3", 2: "one"}


def _plain_greedy(score, cost, tokens, budget, penalty):
    taken, union, spent = [], set(), 0
    while True:
        best, value = None, -1.0
        for k in range(len(score)):
            if k in taken or (taken and cost[k] + spent > budget):
                continue
            over = len(tokens[k] & union) / len(tokens[k] | union) if union and tokens[k] else 0.0
            a = score[k] / max(1.0, cost[k] ** 0.5) * (1 - penalty * over)
            if a > value:
                best, value = k, a
        if best is None:
            return taken
        taken.append(best)
        union |= tokens[best]
        spent += cost[best]
        if spent >= budget or len(taken) == len(score):
            return taken


def test_greedy_selection_equals_its_plain_form():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 14)
        score, cost = np.array([rng.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(n)]), np.array([rng.choice([1, 4, 9]) for _ in range(n)])
        tokens = [set(rng.sample("abcdefg", rng.randrange(0, 5))) for _ in range(n)]
        pairs = [(u, "abcdefg".index(t)) for u, ts in enumerate(tokens) for t in ts]
        unit, code = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        assert K.diverse_order(score, cost, unit, code, np.arange(n), 20, 0.45) == _plain_greedy(score, cost, tokens, 20, 0.45)


def test_selection_of_many_units():
    """Hundreds of units under a large budget as in the plain form; 100 000 units with common tokens in near-linear time."""
    import time

    def made(n, seed):
        rng = np.random.default_rng(seed)
        tokens = [set(np.minimum(rng.zipf(1.4, rng.integers(3, 12)), 5000).tolist()) for _ in range(n)]
        pairs = [(u, t) for u, ts in enumerate(tokens) for t in ts]
        return rng.integers(1, 60, n) / 8.0, rng.integers(5, 40, n), tokens, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    for seed in range(3):
        score, cost, tokens, unit, code = made(400, seed)
        for budget in (100, 2000, 10**6):
            assert K.diverse_order(score, cost, unit, code, np.arange(400), budget, 0.45) == _plain_greedy(score, cost, tokens, budget, 0.45)
    took = []
    for n in (25_000, 100_000):
        score, cost, _, unit, code = made(n, 9)
        began = time.time()
        assert len(K.diverse_order(score, cost, unit, code, np.arange(n), 20_000, 0.45)) > 500
        took.append(time.time() - began)
    assert took[1] < 60


def test_few_units_are_taken_as_many_are(monkeypatch):
    """Looking at all units each time gives what the heap gives, ties by index included; pairs are told apart without a hash table."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        pairs = np.unique(rng.integers(0, n, 6 * n) * 40 + rng.integers(0, 40, 6 * n))
        given = (rng.integers(0, 5, n) / 2.0, rng.integers(1, 9, n), pairs // 40, pairs % 40, rng.permutation(n) + 1, int(rng.integers(1, 60)), 0.45)
        few = K.diverse_order(*given)
        monkeypatch.setattr(K, "FEW_UNITS", 0)
        assert few == K.diverse_order(*given)
        monkeypatch.undo()
    values = rng.integers(0, 50, 300)
    assert K._distinct(values).tolist() == sorted(set(values.tolist())) and K._distinct(values[:0]).tolist() == []


def test_values_hold_one_of_their_signs(spark):
    rows = spark.createDataFrame([(x,) for x in ("plain words", "7", "a-b", "A_1", "x@y", "/tmp", "3.5", "AB-9", "", "semi;colon", "\u0663 \u00bd")], "t string")
    for r in rows.select("t", tasks_io.T.flags(F.col("t"))["has_value"].alias("has"), F.col("t").rlike(tasks_io.T.VALUE).alias("want")).collect():
        assert r["has"] == r["want"]


def test_units_are_made_once(spark):
    """A text without sentences is its own unit; the units of others aren't made a second time for their number."""
    made = C.unit_array(F.col("t"))
    rows = spark.createDataFrame([("One. Two!\n\nThree",), ("  ",), (None,)], "t string").select(made.alias("u"))
    assert [r["u"] for r in rows.collect()] == [["One.", "Two!", "Three"], [""], [""]]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_context_windows_split_once_a_term(spark):
    """What a text is split into is named once: named twice, it was split anew for every place of a term."""
    rows = spark.createDataFrame([(1, 1, "word " * 50, ["word", "none"])], "question_id int, page_id int, text string, terms array<string>")
    plan = R.context_windows(rows, 4, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_rm3_counts_pages_once(spark):
    """Both rankings, the expansion and the frequencies share the postings."""
    seen = spark.sparkContext.accumulator(0)

    def said(text: str) -> str:
        seen.add(1)
        return text

    pages = spark.createDataFrame([(0, k, f"apple pear plum{k} word{k % 3}") for k in range(12)], "context_id int, page_id int, text string")
    pages = pages.withColumn("text", F.udf(said).asNondeterministic()("text"))
    asked = spark.createDataFrame([(7, 0, "plum3 word1")], "question_id int, context_id int, question string")
    assert R.rank_pages(pages, asked, "rm3").count() >= 1
    assert seen.value <= 2 * 12  # once for the postings, and pages are counted for each context


def test_context_windows_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        text = "".join(rng.choice(["garden ", "den", "Mary ", "x", ". ", "a.b*c ", "the garden gate ", "\\Q", "é"]) for _ in range(rng.randrange(0, 200)))
        rows.append((k, 1, text if k else None, rng.sample(["garden", "den", "mary", "x", "a.b*c", "gate", "absent", "\\q", "garden"], rng.randrange(0, 8))))
    frame = spark.createDataFrame(rows, "question_id int, page_id int, text string, terms array<string>")
    for most, radius in ((8, 30), (2, 5), (4, 0)):
        got = {r["question_id"]: r["windows"] for r in R.context_windows(frame, most, radius).collect()}
        for k, _, text, terms in rows:
            places = [(m.start(), m.end(), n) for t in sorted({t for t in terms if len(t) > 1}, key=lambda t: (-len(t), t)) for n, m in enumerate(re.finditer(re.escape(t), (text or "").lower()))]
            places = sorted(p[:2] for i, p in enumerate(places) if i < 3 * most or p[2] == 0)
            want, end = [], -1
            for s, e in places:
                if len(want) < most and max(0, s - radius) > end:
                    want.append(text[max(0, s - radius) : e + radius].strip())
                    end = min(len(text), e + radius)
            assert got[k] == want, (k, most)


def test_raw_snippets_equal_plain_ones(spark):
    rng = random.Random(8)
    said = ["What about the garden gate and the silver lantern near Oslo?", "Who counted lanterns, ladders, letters, lemons, lilies, lizards, lockets, locks, logs, looms, loaves, lutes and lynxes?", ""]
    texts = ["".join(rng.choice(["Garden gate ", "silver ", "lantern ", "the rest of it ", "lemons and lilies ", "oslo. ", "." * 40]) for _ in range(n)) for n in (0, 5, 400, 3000)]
    contexts = spark.createDataFrame(list(enumerate(texts)), "context_id int, text string")
    questions = spark.createDataFrame([(10 * c + q, c, said[q]) for c in range(4) for q in range(3)], "question_id int, context_id int, question string")
    from foliant.functions import text as T

    terms = {r["question_id"]: r["t"] for r in questions.select("question_id", T.ranked_terms(F.col("question")).alias("t")).collect()}
    got = {}
    for r in R.raw_snippets(contexts, questions, chars=90, quota=20).collect():
        got.setdefault(r["question_id"], set()).add((r["term"], r["start"], r["end"], r["window"]))
    for qid, listed in terms.items():
        text, cells, want = texts[qid // 10], set(), set()
        for term in listed:
            left = max(3, 20 // len(listed))
            for m in re.finditer(re.escape(term), text.lower()):
                a, z = max(0, m.start() - 90), min(len(text), m.end() + 90)
                if left and (a // 200, z // 200) not in cells:
                    cells.add((a // 200, z // 200))
                    want.add((term, a, z, text[a:z]))
                    left -= 1
        assert got.get(qid, set()) == want


def test_compression_keeps_what_is_asked_for(spark):
    filler = " ".join(f"The plain sentence number {w} says little of note." for w in ("one", "two", "three", "four", "five", "six") * 20)
    text = filler + " The launch code is ZX-91 for Project Heron. " + filler
    ctx = spark.createDataFrame([("t", text)], "context_id string, text string")
    asked = spark.createDataFrame([("t", "What is the launch code of Project Heron?")], "context_id string, question string")
    for policy in ("static", "entropy"):
        r = K.compress_contexts(ctx, policy, 240, asked).first()
        assert "ZX-91" in r["text"] and r["ratio"] < 0.5 and r["new_id"].endswith("-b240-qaware")
    assert K.compress_contexts(ctx, "none", 10).first()["text"] == text
    with pytest.raises(ValueError):
        K.compress_contexts(ctx, "other", 10)


def test_retrieval(spark):
    pages = spark.createDataFrame([(1, 1, "the cat sat on a mat\ncats purr", 1, 2), (1, 2, "dogs bark at night 7", 3, 3), (1, 3, "a cat and a dog", 4, 4)], "context_id int, page_id int, text string, line_start int, line_end int")
    asked = spark.createDataFrame([(9, 1, "Where is the cat?")], "question_id int, context_id int, question string")
    assert [r["page_id"] for r in R.rank_pages(pages, asked, "bm25").orderBy("rank").collect()][:2] == [3, 1]
    assert R.rank_pages(pages, asked, "rm3").count() >= 2
    assert R.search(pages, asked).orderBy("rank").first()["page_id"] == 1
    hits = R.grep_pages(pages, "cat", 1).collect()
    assert {(r["page_id"], r["line_no"]) for r in hits if r["is_hit"]} == {(1, 1), (1, 2), (3, 1)}
    assert R.grep_pages(pages, "[", 0).count() == 0
    packet = R.build_packets(R.page_evidence(pages, asked), asked, (2000,)).first()
    assert packet["page_ids"] == [1, 3] and "cat sat" in packet["packet"]
    assert R.working_set(pages, asked).count() >= 2


def test_panels(spark):
    rows = spark.createDataFrame([(k, k % 2, f"c{k % 3}") for k in range(10)], "id int, g int, context string")
    assert {r["id"] for r in P.first_n(rows, ["g"], ["id"], 2).collect()} == {0, 1, 2, 3}
    assert {r["id"] for r in P.keep_last(rows, ["g"], "id").collect()} == {8, 9}
    assert P.experiment_matrix({"a": ["x", "y"], "b": ["u", "v", "w"]}, spark).orderBy("job").collect()[4].asDict() == {"job": 5, "a": "y", "b": "v"}
    groups = E.context_groups(rows, "id").collect()
    assert {(r["id"], r["group"], r["place"]) for r in groups if r["id"] < 4} == {(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 1, 2)}
    assert [r["id"] for r in P.evenly_spaced(rows.withColumn("p", F.col("id") + 1).withColumn("k", F.lit(1)), ["k"], "p", 4).orderBy("id").collect()] == [0, 3, 6, 9]


def test_summary_leaves_contaminated_runs_out(spark):
    rows = spark.createDataFrame([("h", "m", "c", "b", 1.0, True, True, False, None, 0, 1.0), ("h", "m", "c", "b", 0.0, False, True, True, None, 1, 1.0)], "harness string, model string, condition string, source_benchmark string, score double, correct boolean, parse_ok boolean, contaminated boolean, error string, compactions int, duration_s double")
    r = E.run_summary(rows).where("level = 'all'").first()
    assert (r["accuracy"], r["accuracy_all"], r["compaction_events"]) == (1.0, 0.5, 1)


def test_quotes(spark):
    proofs = spark.createDataFrame([(1, '{"quotes": ["alpha beta", "beta  gamma", "nothing here"], "note": "beta gamma", "source_quote": "alpha beta gamma"}')], "context_id int, proof string")
    quotes = E.quotes_from_json(proofs)
    assert quotes.count() == 4
    checked = E.verify_quotes(quotes, spark.createDataFrame([(1, "alpha beta gamma")], "context_id int, text string"))
    assert checked.where("normalised").count() == 3 and checked.where("exact").count() == 2


def test_tasks_in_and_out(spark, tmp_path):
    good = spark.createDataFrame([("a:1", "ruler", "t", "1", "ctx", "q", "g", [], "exact", "{}")], tasks_io.TASK)
    tasks_io.write_tasks(good, str(tmp_path / "out"))
    again = tasks_io.read_tasks(spark, [str(tmp_path / "out")], glob="*.json")
    assert again.count() == 1 and again.first()["task_id"] == "a:1"
    with pytest.raises(ValueError):
        tasks_io.write_tasks(good.union(good), str(tmp_path / "twice"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('{"task_id": "bad id!"}\nnot json\n')
    rows = tasks_io.read_tasks(spark, [str(tmp_path / "bad")], strict=False)
    assert all(r["errors"] for r in rows.collect()) and rows.count() == 2
    with pytest.raises(Exception, match="bad id!|x.jsonl"):
        tasks_io.read_tasks(spark, [str(tmp_path / "bad")]).collect()


def test_transcripts_and_logs(spark):
    lines = spark.createDataFrame([("p", 1, '{"type":"user_message","payload":{"role":"user","content":"please fix the bug"}}'), ("p", 2, '{"payload":{"role":"assistant","content":[{"text":"done with"},{"text":"the bug"}]}}'), ("p", 3, "oops"), ("q", 1, '{"messages":[{"info":{"role":"user"},"parts":[{"text":"hello there you"}]},{"info":{"role":"tool"},"parts":[]}]}')], "path string, line_no long, value string")
    got = [(r["path"], r["turn"], r["role"], r["text"]) for r in tasks_io.transcript_turns(lines).orderBy("path", "turn").collect()]
    assert got == [("p", 0, "user", "please fix the bug"), ("p", 1, "assistant", "done with the bug"), ("q", 0, "user", "hello there you")]
    log = spark.createDataFrame([("s", 1, '{"type":"thread.started","thread_id":"T"}'), ("s", 2, '{"item":{"type":"command_execution"}}'), ("s", 3, '{"item":{"type":"agent_message","text":"fin"},"usage":{"input_tokens":3}}'), ("s", 4, '{"type":"context_compacted"}'), ("s", 5, "x")], "path string, line_no long, value string")
    r = tasks_io.agent_events(log).first()
    assert (r["session_id"], r["final_text"], r["tool_events"], len(r["compaction_events"]), r["input_tokens"]) == ("T", "fin", ["command_execution"], 1, 3)


def test_normalisers(spark):
    story = spark.createDataFrame([("qa1", "Mary went.", "Where?", "bathroom", "7", "4k"), ("qa8", "x", "What?", "apple,milk", "8", "4k"), ("qa1", " ", "?", "a", "9", "4k")], "task string, input string, question string, target string, id string, length string")
    got = {r["source_sample_id"]: r for r in N.story_tasks(story).collect()}
    assert set(got) == {"7", "8"} and got["8"]["scorer"] == "csv_set_ci" and got["7"]["task_id"] == "babilong-qa1-7"
    needle = spark.createDataFrame([(0, "niah_single_1", 5, "hay hay\nQuestion: what is the number?", ["42", "forty-two"])], "index int, task string, length int, input string, outputs array<string>")
    r = N.needle_tasks(needle).first()
    assert (r["context"], r["question"], r["gold_answer"], r["gold_answer_aliases"]) == ("hay hay", "what is the number?", "42", ["forty-two"])
    golds = spark.createDataFrame([("['incorrect']",), ("[datetime.date(2023, 1, 5)]",), ("[7]",), ("plain",)], "a string").select(N.literal_gold(F.col("a")).alias("g"), N.shape_scorer(F.col("a")).alias("s"))
    assert [x["g"] for x in golds.collect()] == ["incorrect", "2023-01-05", "7", "plain"]
    turns = spark.createDataFrame([(1, 0, "user", "u0"), (1, 1, "assistant", "a0"), (1, 2, "user", "u1"), (1, 3, "assistant", "a1"), (1, 4, "user", "u2"), (1, 5, "assistant", "a2"), (1, 6, "user", "u3")], "conv_id int, turn int, role string, text string")
    r = N.conversation_pairs(turns).collect()
    assert [(x["turn"], x["question"], x["gold"]) for x in r] == [(2, "u1", "a1")] and r[0]["context"] == "[USER]: u0\n\n[ASSISTANT]: a0"
    rows = spark.createDataFrame([(k, f"i{k}", k * 10) for k in range(1, 13)], "ord int, id string, value int")
    eps = {x["episode"]: x for x in N.expanding_history(rows, 3, ahead=2).collect()}
    assert eps[1]["context"].count("\n") == 3 and eps[1]["gold"] == "i5,50\ni6,60" and 3 not in eps


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_verbatim_passages(spark, limit):
    docs = spark.createDataFrame([(1, "One two  three\nfour five six seven eight nine"), (2, "two"), (3, None), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "two three four five six seven eight nine"), (8, "TWO"), (9, "two three four five six seven eight"), (10, "wo three"), (11, None)], "item_id int, text string")
    assert {(r["item_id"], r["doc_id"]) for r in E.verbatim_passages(docs, items, broadcast_chars=limit).collect()} == {(7, 1), (8, 1), (8, 2), (9, 1)}
    assert E.verbatim_passages(docs, items.limit(0)).count() == 0


def test_story_coreference_of_mixed_sentences(spark):
    """A sentence with a pronoun's and a name's movement: the pronoun's counts if one person is meant, else the name's."""
    rows = [(1, "Mary went to the park. He moved to the office and John went to the school. They went to the garden."),
            (2, "Mary and John went to the park. He moved to the office and Fred went to the school. They went to the garden. She went to the cinema."),
            (3, "They went to the park. Bill gave the milk to Jeff. He moved to the office."), (4, None)]
    got = S.story_candidates(spark.createDataFrame(rows, "context_id long, text string")).orderBy("context_id", "idx").collect()
    assert [(r["context_id"], r["idx"], r["kind"], r["people"], r["location"]) for r in got] == [
        ("1", 1, "movement", ["Mary"], "park"), ("1", 2, "movement", ["Mary"], "office"), ("1", 3, "movement", ["Mary"], "garden"),
        ("2", 1, "movement", ["Mary", "John"], "park"), ("2", 2, "movement", ["Fred"], "school"), ("2", 3, "movement", ["Fred"], "garden"), ("2", 4, "movement", ["Fred"], "cinema"),
        ("3", 1, "transfer", ["Bill", "Jeff"], None), ("3", 2, "movement", ["Jeff"], "office"),
    ]


def test_story_in_rows_equals_story_in_one(spark):
    told = ["Mary went to the garden. ", "", None, "She picked up the milk.  Mary took the milk.\n", "Then they moved to the office. John and Mary moved to the park."]
    parts = spark.createDataFrame([(c, k, x) for c in (1, 2) for k, x in enumerate(told)], "context_id long, part int, text string")
    whole = spark.createDataFrame([(c, "\n".join(x or "" for x in told)) for c in (1, 2)], "context_id long, text string")
    assert sorted(story.sentence_offsets(parts, part_col="part").collect()) == sorted(story.sentence_offsets(whole).collect())
    key = lambda rows: sorted(str(r) for r in rows.collect())
    assert key(S.extract_story_events(parts, part_col="part")) == key(S.extract_story_events(whole)) != []


def test_quotes_of_nested_json(spark):
    """Any nesting: strings under their nearest key, in order, as a plain walk finds them."""
    import json

    rng = random.Random(3)
    words = ["short", "a long enough text", "one with ] and } and \"marks\"", "  blanks around it  ", "é" * 9, "x" * 2001, "again the same one", "again the same one"]
    keys = ["quote", "source_quotes", "Evidence", "citations", "a_quote", "quoted", "unquote", "source", "note", "misquote", "preevidencepost"]

    def made(depth):
        kind = rng.randrange(3) if depth else 2
        if kind == 0:
            return {rng.choice(keys): made(depth - 1) for _ in range(rng.randrange(4))}
        return [made(depth - 1) for _ in range(rng.randrange(4))] if kind == 1 else rng.choice([*words, 5, None, True])

    def walk(node, key, out):
        for name, x in node.items() if isinstance(node, dict) else ((key, x) for x in node) if isinstance(node, list) else ():
            walk(x, name, out)
        if isinstance(node, str) and re.search(r"(^|_)(source_)?quotes?$|citation|evidence", key, re.I) and 8 <= len(node.strip()) <= 2000 and node.strip() not in out:
            out.append(node.strip())
        return out

    values = [made(6) for _ in range(300)] + [{"quotes": ["has ] bracket inside here", "second long quote"]}, {"evidence": [{"source": "first long one", "quote": "second long one"}]}]
    proofs = spark.createDataFrame([*((k, json.dumps(v)) for k, v in enumerate(values)), (998, "{not json"), (999, None)], "context_id int, proof string")
    got = {}
    for r in E.quotes_from_json(proofs, keep=5).collect():
        got.setdefault(r["context_id"], {})[r["ord"]] = r["quote"]
    want = {k: dict(enumerate(walk(v, "", [])[:5])) for k, v in enumerate(values)}
    assert got == {k: v for k, v in want.items() if v} and got[300] == {0: "has ] bracket inside here", 1: "second long quote"} and got[301] == {0: "second long one"}


def test_scans_equal_plain_ones(spark):
    """Sums and last values within keys over ranges, one key holding most rows and spread over all of them, null keys and values too."""
    from foliant.operators import order as O

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([None, rng.randrange(9)])) for k in range(500)]
    rng.shuffle(rows)
    dealt = O.deal(spark.createDataFrame(rows, "k string, at int, v int"), "k", "at")
    got = {r["at"]: (r["sum"], r["last"]) for r in O.scan(dealt, ["k"], ["at"], {"sum": F.col("v")}, {"last": F.col("v")}).collect()}
    want, had = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = had.get(k, (0, None))
        had[k] = (want[at][0] + (v or 0), want[at][1] if v is None else v)
    assert got == want and dealt.where("k = 'hot'").select(O.PART).distinct().count() >= 3
    assert O.scan(dealt.limit(0), ["k"], ["at"], {"sum": F.col("v")}).count() == 0
    numbered = O.prefix_sums(spark.createDataFrame(rows, "k string, at int, v int"), ["at"], {"n": "at"}).collect()
    assert all(r["n"] == sum(range(r["at"])) for r in numbered)


def test_bloom_filter(spark):
    """Nothing that is there is turned away, little else gets through, and the size is bounded."""
    from foliant.operators import bloom

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    test = bloom.may_hold(keys, "h", bloom.filter_bits(3000))
    there = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).where(test(F.col("h")))
    got = {r["id"] for r in there.collect()}
    assert set(range(3000)) <= got and len(got) < 3000 + 17_000 * 0.02
    assert bloom.filter_bits(10**12) == bloom.MOST_BITS and bloom.filter_bits(0) == bloom.LEAST_BITS
    none = bloom.may_hold(keys.limit(0), "h", 1024)
    assert spark.range(9).select(F.xxhash64("id").alias("h")).where(none(F.col("h"))).count() == 0


def test_passages_beyond_the_broadcast(spark):
    """The shuffled way gives the same, and shuffles hardly more hashes than there are candidates."""
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "garden", "gate", "of", "a", "house", "river", "stone"]) + rng.choice(["", "s", "ly", "ed"])
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 9, 30]) if k else 12)) for k in range(30)] + [(90, " "), (91, None)]
    docs = [(k, f"{say(40)} {rng.choice(items)[1] if k % 3 == 0 else say(9)}  {say(40)}") for k in range(300)] + [(900, None)]
    corpus, passages = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    near, far = ({tuple(r) for r in E.verbatim_passages(corpus, passages, broadcast_chars=c).collect()} for c in (8_000_000, 0))
    assert near == far and len(near) > 50


def test_bm25_in_blocks_equals_postings(spark):
    """Scores and ranks as by joined postings, in blocks of any size, over several contexts, with ties and empty pages."""
    from foliant.operators.blocks import bm25_in_blocks

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["garden", "gate", "river", "stone", "house", "lamp", "w1", "42", "zz"]) for _ in range(n))
    pages = spark.createDataFrame([(k % 3, k, say(rng.choice([0, 3, 9, 40])) if k % 11 else None) for k in range(120)] + [(None, 5, say(5))], "context_id int, page_id int, text string").repartition(3)
    asked = spark.createDataFrame([(10 * c + k, c, say(rng.randrange(1, 9))) for c in range(4) for k in range(5)] + [(99, 0, "absent words only")], "question_id int, context_id int, question string")
    weights = R.query_weights(asked)
    post = R.postings(pages)
    want = R.top_k(R.bm25(post, R.document_frequencies(post, pages), weights), 4).collect()
    for cells in (4_000_000, 7):
        got = R.top_k(bm25_in_blocks(pages, weights, 4, R.K1, R.B, R.AVERAGE_LENGTH, cells=cells), 4).collect()
        assert {(r["question_id"], r["page_id"], r["rank"], round(r["score"], 9)) for r in got} == {(r["question_id"], r["page_id"], r["rank"], round(r["score"], 9)) for r in want} and len(want) > 40
    assert bm25_in_blocks(pages, weights, 4, R.K1, R.B, R.AVERAGE_LENGTH, most_terms=3) is None
    assert bm25_in_blocks(pages.limit(0), weights, 4, R.K1, R.B, R.AVERAGE_LENGTH).count() == 0
    assert bm25_in_blocks(pages, weights.limit(0), 4, R.K1, R.B, R.AVERAGE_LENGTH).count() == 0


def test_tiers_see_only_their_questions(spark, monkeypatch):
    """A tier is worked out for the questions that are routed to it, not for all."""
    events = spark.createDataFrame([(1, -1, "e1", "meal", "dinner", "soup", 1, "note"), (1, -3, "e2", "preference", "tea", "green", 3, "note")], "context_id long, day int, event_id string, kind string, key string, value string, importance int, text string")
    asked = spark.createDataFrame([(1, 1, "What did I eat last night?"), (2, 1, "How many times did I eat dinner?"), (3, 1, "Was it never mentioned?")], "question_id long, context_id long, question string")
    seen = {}
    for name in ("hot_tier", "episodic_tier", "semantic_tier", "cold_tier"):
        whole = getattr(M, name)
        monkeypatch.setattr(M, name, lambda e, q, whole=whole, name=name: seen.setdefault(name, [r["question_id"] for r in q.collect()]) and whole(e, q))
    tiers = {(r["question_id"], r["tier"]) for r in M.memory_tiers(events, asked).collect()}
    assert seen == {"hot_tier": [1], "episodic_tier": [1], "semantic_tier": [2], "cold_tier": [3]}
    assert tiers == {(1, "L0"), (1, "L1"), (2, "L2"), (3, "L3")}


def test_packets_make_their_items_once(spark):
    """Evidence is made once for all budgets."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(k):
        made.add(1)
        return f"text {k}"

    asked = spark.createDataFrame([(1, "q")], "question_id long, question string")
    items = spark.range(5).select(F.lit(1).cast("long").alias("question_id"), F.lit("page_snippet").alias("kind"), F.concat(F.lit("t"), "id").alias("title"), said.asNondeterministic()("id").alias("text"), F.lit(1.0).alias("score"), F.array(F.col("id").cast("int")).alias("page_ids"))
    got = R.build_packets(items, asked, (700, 1200, 3000)).collect()
    assert [r["n_items"] for r in sorted(got, key=lambda r: r["budget"])] == [5, 5, 5] and made.value == 5


def test_story_events_are_kept(spark):
    """What is told of a story reads its events several times; they are not extracted anew each time."""
    events = S.extract_story_events(spark.createDataFrame([("1", "Mary went to the kitchen. Mary picked up the milk.")], "context_id string, text string"))
    assert "Window" not in events._jdf.queryExecution().toString()
    assert [r["kind"] for r in events.orderBy("idx").collect()] == ["movement", "pickup"]
