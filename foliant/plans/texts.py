"""Registered queries: chunking, compression, retrieval and corpus normalisation over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunk as C
from foliant.operators import compress as K
from foliant.operators import normalize as N
from foliant.operators import retrieve as R
from foliant.operators.evaluate import global_rank
from foliant.operators.panel import evenly_spaced
from foliant.plans import views as V
from foliant.session import table
from foliant.sources import tasks as S


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.conversation_pairs(V.turns(spark, sf_dir)).select("conv_id", "turn", F.sha1(F.col("context").cast("binary")).alias("context_sha1"), "question", "gold")


def spread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.spread_pairs(V.turns(spark, sf_dir), apart=2, min_turns=4).select("conv_id", "turn", F.length("context").alias("context_chars"))


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window_chunks(V.contexts(spark, sf_dir), 1200, 200).select("context_id", "start", F.sha1(F.col("text").cast("binary")).alias("sha1"))


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts of paragraphs, chunked; joined again they give the text."""
    said = V.turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))
    chunks = C.chunk_contexts(said, 200, "conv_id")
    return chunks.groupBy("context_id").agg(F.sum(F.length("text")).alias("chars"), F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").cast("binary")).alias("sha1"))


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents paged with overlap; the manifest of each."""
    return S.manifest(C.page_contexts(V.contexts(spark, sf_dir), 200, 20))


def pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_contexts(V.contexts(spark, sf_dir), 200, 20).select("context_id", "page_id", "char_start", "char_end", "line_start", "line_end", "tokens_est")


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_units(V.contexts(spark, sf_dir)).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def episode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.episode_chunks(V.contexts(spark, sf_dir), "The and attion", 2000, 100).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def padded_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.pad_contexts(V.contexts(spark, sf_dir).select("context_id", "text").withColumn("original", F.col("text")), 500)
    return out.select("context_id", F.length("text").alias("chars"), F.startswith("text", "original").alias("kept"))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages spliced into documents that were cleaned of short lines with common words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), C.clean_carrier("text", ["the", "and", "der", "que"], ["The", "Thing"]).alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("passage"))
    n = docs.count()
    near = docs.join(items.select(F.pmod("idx", F.lit(max(1, n))).alias("idx"), "passage", F.col("idx").alias("item_id")), "idx")
    return near.select("item_id", F.length(C.splice("passage", "text", 1000)).alias("chars"), F.contains(C.splice("passage", "text", 1000), F.col("passage")).alias("whole"))


def carrier_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a task that takes carriers from its own place on until it has twice the text of its first one, cleaned; what was taken, by digest."""
    docs = table(spark, sf_dir, "documents")
    cleaned = C.clean_carrier("text", ["the", "and", "der", "que"], ["The", "Thing"])
    carriers = global_rank(docs.select("doc_id", F.coalesce(cleaned, F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("raw")), "doc_id", "rank").select("doc_id", (F.col("rank") - 1).alias("idx"), "text", "raw")
    built = C.assemble_carriers(carriers.select("doc_id", "idx", "raw"), carriers.select("idx", "text"), "raw")
    return built.select("doc_id", F.length("carrier").alias("chars"), F.sha1(F.col("carrier").cast("binary")).alias("sha1"))


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best units of each document by density within 60 tokens."""
    return K.top_by_density(K.unit_scores(V.contexts(spark, sf_dir)), 60).select("context_id", "idx", "rank", F.round("base_score", 6).alias("base_score"), "spent")


def compressed_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compress_contexts(V.contexts(spark, sf_dir), "entropy", 300).select("context_id", "original_tokens", "compressed_tokens", "selected_units", F.sha1(F.col("text").cast("binary")).alias("sha1"))


def compressed_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compression_report(K.compress_contexts(V.contexts(spark, sf_dir), "static", 400)).withColumn("avg_ratio", F.round("avg_ratio", 6))


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of benchmark passages against all documents, as one context of pages; the ten best each."""
    pages, asked = _corpus(spark, sf_dir)
    return R.rank_pages(pages, asked, "bm25", 10).select("question_id", "page_id", "rank", F.round("score", 4).alias("score"))


def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over turns of a conversation, with query expansion."""
    return R.rank_pages(V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir), "rm3", 5).select("question_id", "page_id", "rank", F.round("score", 4).alias("score"))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "documents").select(F.lit(0).alias("context_id"), F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"))
    return pages, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lit(0).alias("context_id"), F.col("text").alias("question"))


def turn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by the words of what the user asked first."""
    return R.generic_scores(V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir)).select("question_id", "page_id", "score")


def question_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir), 3).select("question_id", "page_id", "rank", "score")


def working_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.working_set(V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir), 4)


def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for each conversation's first question under three budgets."""
    pages, asked = V.turn_pages(spark, sf_dir), V.turn_questions(spark, sf_dir)
    return R.build_packets(R.page_evidence(pages, asked), asked, (700, 1200, 3000)).select("question_id", "budget", "n_items", "page_ids", "tokens")


def raw_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = V.turn_pages(spark, sf_dir).groupBy("context_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return R.raw_snippets(said, V.turn_questions(spark, sf_dir)).select("question_id", "start", "end", "term")


def grep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.contexts(spark, sf_dir).select("context_id", F.lit(1).alias("page_id"), F.coalesce("text", F.lit("")).alias("text"))
    return R.grep_pages(pages, "token|password", 1, 5, 40)


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_regex(V.contexts(spark, sf_dir), "[0-9]+")


def grep_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grep_windows(V.contexts(spark, sf_dir), "token", 40).select("context_id", "start", "end", F.length("window").alias("chars"))


def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evenly_spaced(V.turn_pages(spark, sf_dir), ["context_id"], "page_id", 3).select("context_id", "page_id")


def neighbour_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that question_search finds, with those beside them."""
    found = question_search(spark, sf_dir).select(F.col("question_id").alias("context_id"), "page_id")
    return R.pages_around(V.turn_pages(spark, sf_dir), found, 1).select("context_id", "page_id")


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs as a validated task table: how many rows break which rule."""
    pairs = N.conversation_pairs(V.turns(spark, sf_dir), False)
    tasks = pairs.select(F.concat(F.lit("swe_chat-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("task_id"), F.lit("swe_chat").alias("source_benchmark"), F.lit("qa").alias("source_task"), F.col("conv_id").cast("string").alias("source_sample_id"), "context", "question", F.col("gold").alias("gold_answer"), F.when(F.col("turn") % 2 == 0, "substring_ci").otherwise("nonesuch").alias("scorer"))
    checked = S.validate_tasks(tasks)
    return checked.select(F.explode_outer("errors").alias("rule")).groupBy(F.coalesce("rule", F.lit("valid")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent content tokens of each language."""
    terms = table(spark, sf_dir, "documents").select("lang", F.explode(T.without(T.tokens(F.col("text")), T.STOP_UNITS)).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(terms, 20, "n", "lang", "term").select("lang", "term", "n")


QUERIES = {
    f.__name__: f
    for f in (
        conversation_pairs, spread_pairs, window_chunks, paragraph_chunks, page_store, pages_of_documents, sentence_units, episode_chunks, padded_contexts, carriers, carrier_tasks, unit_scores, compressed_entropy, compressed_notebook, passage_search,
        expanded_search, turn_scores, question_search, working_sets, evidence_packets, raw_snippets, grep_documents, count_documents, grep_windows, sampled_turns, neighbour_turns, task_table, text_terms,
    )
}

_STOP = "'" + "','".join(T.STOP_UNITS) + "'"
_TOK = lambda c: f"regexp_extract_all(lower({c}), '[a-z][a-z0-9_''-]*|\\d+(?:\\.\\d+)?')"
_TERMS = lambda c: f"list_filter({_TOK(c)}, lambda x: x NOT IN ({_STOP}) AND length(x) >= 2)"
_PAIRS = """
    WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS gold, row_number() OVER w AS place, '[' || upper(role) || ']: ' || coalesce(text, '') AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'user' AND nr = 'assistant')"""
_COUNT = lambda h, x: f"((length({h}) - length(replace({h}, {x}, ''))) // length({x}))"
_BM25 = f"""
    post AS (SELECT context_id, page_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT context_id, page_id, len(w) AS dl, unnest(w) AS term FROM (SELECT context_id, page_id, {_TERMS('text')} AS w FROM pages)) GROUP BY ALL),
    n AS (SELECT context_id, count(*) AS n FROM pages GROUP BY 1),
    df AS (SELECT context_id, term, count(*) AS df, any_value(n) AS n FROM post JOIN n USING (context_id) GROUP BY ALL),
    q AS (SELECT question_id, context_id, term, count(*)::DOUBLE AS weight FROM (SELECT question_id, context_id, unnest({_TERMS('question')}) AS term FROM asked) GROUP BY ALL)"""
_SCORE = lambda q: f"SELECT question_id, context_id, page_id, sum(weight * (ln((n + 1) / (df + 0.5)) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 700.0)))) AS score FROM {q} JOIN df USING (context_id, term) JOIN post USING (context_id, term) GROUP BY ALL"
_TOP = lambda s, k: f"SELECT question_id, page_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_id) AS rank, score FROM {s} QUALIFY rank <= {k}"

ORACLES = {
    "conversation_pairs": f"{_PAIRS} SELECT conv_id, turn, sha1(coalesce((SELECT string_agg(s, chr(10) || chr(10) ORDER BY turn) FROM t WHERE t.conv_id = p.conv_id AND t.place < p.place), '')) AS context_sha1, text AS question, substring(gold, 1, 4000) AS gold FROM p WHERE k >= n // 3 AND k < (2 * n) // 3",
    "window_chunks": "SELECT context_id, s AS start, sha1(substring(text, s + 1, 1200)) AS sha1 FROM (SELECT doc_id AS context_id, coalesce(text, '') AS text, unnest(range(0, greatest(length(coalesce(text, '')) - 1, 0) + 1, 1000)) AS s FROM documents)",
    "paragraph_chunks": "SELECT conv_id AS context_id, length(t)::BIGINT AS chars, sha1(t) AS sha1 FROM (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)",
    "padded_contexts": "SELECT doc_id AS context_id, greatest(length(text), 2000) AS chars, true AS kept FROM documents",
    "passage_search": f"""WITH pages AS (SELECT 0 AS context_id, doc_id AS page_id, coalesce(text, '') AS text FROM documents), asked AS (SELECT item_id AS question_id, 0 AS context_id, text AS question FROM benchmark), {_BM25},
        s AS ({_SCORE('q')}) SELECT question_id, page_id, rank, round(score, 4) AS score FROM ({_TOP('s', 10)})""",
    "expanded_search": f"""WITH pages AS ({V.TURN_PAGES_SQL}), asked AS ({V.TURN_QUESTIONS_SQL}), {_BM25}, s AS ({_SCORE('q')}), top AS ({_TOP('s', 12)}),
        rel AS (SELECT *, score / max(score) OVER (PARTITION BY question_id) / sqrt(rank) AS rel, question_id AS context_id FROM top),
        x AS (SELECT question_id, context_id, term, sum(rel * least(tf / dl * 100.0, 5.0) * (ln((n + 1) / (df + 0.5)) + 1)) AS weight FROM rel JOIN post USING (context_id, page_id) JOIN df USING (context_id, term)
          WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\\d+') AND df / n <= 0.55 GROUP BY ALL),
        xt AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 9) DESC, term) <= 24),
        mx AS (SELECT question_id, context_id, term, 0.65 * weight / sum(weight) OVER (PARTITION BY question_id) AS weight FROM q UNION ALL SELECT question_id, context_id, term, 0.35 * weight / sum(weight) OVER (PARTITION BY question_id) FROM xt),
        m AS (SELECT question_id, context_id, term, sum(weight) AS weight FROM mx GROUP BY ALL), s2 AS ({_SCORE('m')}) SELECT question_id, page_id, rank, round(score, 4) AS score FROM ({_TOP('s2', 5)})""",
    "turn_scores": f"""WITH pages AS (SELECT context_id, page_id, lower(text) AS low, text FROM ({V.TURN_PAGES_SQL})), asked AS (SELECT *, list_distinct(list_filter({_TOK('question')}, lambda x: x NOT IN ({_STOP}))) AS w, lower(trim(question, ' ' || chr(10))) AS ph FROM ({V.TURN_QUESTIONS_SQL})),
        s AS (SELECT question_id, page_id, coalesce((SELECT sum(least(6, {_COUNT('low', 'x')})) FROM (SELECT unnest(w) AS x)), 0)::DOUBLE + CASE WHEN ph <> '' AND contains(low, ph) THEN 20 ELSE 0 END
          + CASE WHEN regexp_matches(question, '(?i)\\b(count|total|how many|percentage|percent|number)\\b') AND regexp_matches(text, '\\b\\d+\\b') THEN 5 ELSE 0 END AS score FROM pages JOIN asked USING (context_id))
        SELECT * FROM s WHERE score > 0""",
    "question_search": f"""WITH pages AS (SELECT context_id, page_id, lower(text) AS low FROM ({V.TURN_PAGES_SQL})), asked AS (SELECT *, {_TOK('question')} AS w, regexp_extract_all(lower(question), '"([^"]+)"', 1) AS ph, regexp_replace(lower(question), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS q FROM ({V.TURN_QUESTIONS_SQL})),
        s AS (SELECT question_id, page_id, coalesce((SELECT sum(least(8, {_COUNT('low', 'x')})) FROM (SELECT unnest(w) AS x)), 0)::DOUBLE + coalesce((SELECT sum(12 * {_COUNT('low', 'x')}) FROM (SELECT unnest(ph) AS x)), 0) + CASE WHEN length(q) >= 4 AND contains(low, q) THEN 20 ELSE 0 END AS score FROM pages JOIN asked USING (context_id))
        SELECT question_id, page_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_id) AS rank, score FROM s WHERE score > 0 QUALIFY rank <= 3""",
    "grep_documents": """
        WITH l AS (SELECT doc_id AS context_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), h AS (SELECT context_id, lines, i FROM (SELECT context_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE regexp_matches(lines[i], 'token|password')),
        c AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY i) AS hit FROM h QUALIFY hit <= 5)
        SELECT context_id, 1 AS page_id, hit, k AS line_no, lines[k] AS line, k = i AS is_hit FROM (SELECT *, unnest(range(greatest(1, i - 1), least(len(lines), i + 1) + 1)) AS k FROM c)""",
    "count_documents": "SELECT doc_id AS context_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents",
    "sampled_turns": "WITH p AS (SELECT context_id, page_id, max(page_id) OVER (PARTITION BY context_id) AS n FROM (" + V.TURN_PAGES_SQL + ")) SELECT context_id, page_id FROM p WHERE n <= 3 OR page_id IN (1, round_even((n - 1) / 2.0, 0)::INT + 1, n)",
    "task_table": f"{_PAIRS}, e AS (SELECT CASE WHEN place = 1 THEN ['context'] ELSE [] END || CASE WHEN turn % 2 = 0 THEN [] ELSE ['scorer'] END AS e FROM p) SELECT rule, count(*) AS n FROM (SELECT unnest(CASE WHEN len(e) = 0 THEN ['valid'] ELSE e END) AS rule FROM e) GROUP BY 1",
    "text_terms": f"WITH t AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_filter({_TOK('text')}, lambda x: x NOT IN ({_STOP}))) AS term FROM documents) GROUP BY ALL) SELECT lang, term, n FROM t QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 20",
    "sentence_units": """
        WITH u AS (SELECT doc_id AS context_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda s: s <> '') AS p FROM documents),
        s AS (SELECT context_id, unnest(CASE WHEN len(p) = 0 THEN [''] ELSE flatten(list_transform(p, lambda s: list_filter(list_transform(range(0, (length(s) - 1) // 1200 + 1), lambda k: regexp_replace(substring(s, k * 1200 + 1, 1200), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> ''))) END) AS t FROM u)
        SELECT context_id, count(*) AS n, sum(length(t))::BIGINT AS chars, max(length(t)) AS longest FROM s GROUP BY 1""",
}
ORACLES["neighbour_turns"] = f"SELECT DISTINCT a.context_id, a.page_id FROM ({V.TURN_PAGES_SQL}) a JOIN ({ORACLES['question_search']}) b ON a.context_id = b.question_id AND a.page_id BETWEEN b.page_id - 1 AND b.page_id + 1"
#: Pages of 800 characters with 80 of overlap. A page ends behind the first mark that starts within the next 119 characters, marks by rank; else behind a line's end in the last 180; else where it is.
_MARK = lambda m, n: f"WHEN contains(w, {m}) THEN e0 + instr(w, {m}) - 1 + {n}"
_END = f"""(SELECT CASE WHEN e0 >= length(t) THEN length(t) {_MARK("chr(10) || chr(10)", 2)} {_MARK("chr(10)", 1)} {_MARK("'. '", 2)} {_MARK("'? '", 2)} {_MARK("'! '", 2)}
    WHEN contains(b, chr(10)) AND length(regexp_extract(b, '[^\\n]*$')) + 1 < 180 THEN greatest(s + 1, e0 - length(regexp_extract(b, '[^\\n]*$'))) ELSE e0 END
    FROM (SELECT e0, substring(t, e0 + 1, 119) AS w, substring(t, greatest(s, e0 - 300) + 1, e0 - greatest(s, e0 - 300)) AS b FROM (SELECT least(length(t), s + 800) AS e0)))"""
_PAGES = f"""
    WITH RECURSIVE g AS (SELECT context_id, t, 1 AS page_id, s, {_END} AS e FROM (SELECT doc_id AS context_id, coalesce(text, '') AS t, 0::BIGINT AS s FROM documents)
      UNION ALL SELECT context_id, t, page_id, s, {_END} AS e FROM (SELECT context_id, t, page_id + 1 AS page_id, greatest(s + 1, e - 80) AS s FROM g WHERE e < length(t))),
    l AS (SELECT *, substring(t, 1, s) AS h, substring(t, s + 1, e - s) AS x FROM g),
    pages AS (SELECT context_id, page_id, s AS char_start, e AS char_end, 1 + length(h) - length(replace(h, chr(10), '')) AS line_start, 1 + length(h) - length(replace(h, chr(10), '')) + length(x) - length(replace(x, chr(10), '')) AS line_end, greatest(1, (e - s) // 4) AS tokens_est FROM l)"""
ORACLES["pages_of_documents"] = f"{_PAGES} SELECT * FROM pages"
ORACLES["page_store"] = f"{_PAGES} SELECT context_id, count(*) AS page_count, max(char_end) AS chars, sum(tokens_est)::BIGINT AS tokens_est, min(tokens_est) AS min_tokens, max(tokens_est) AS max_tokens FROM pages GROUP BY 1"
ORACLES["grep_windows"] = """
    WITH p AS (SELECT doc_id AS context_id, length(text) AS n, list_transform(string_split(text, 'token'), lambda x: length(x)) AS l FROM documents), m AS (SELECT context_id, n, l, unnest(range(1, least(len(l), 21))) AS k FROM p),
    s AS (SELECT context_id, n, list_sum(l[1:k])::BIGINT + 5 * (k - 1) AS start FROM m) SELECT context_id, start, start + 5 AS "end", least(n, start + 45) - greatest(0, start - 40) AS chars FROM s"""
ORACLES["spread_pairs"] = f"""{_PAIRS}, g AS (SELECT conv_id, turn, place FROM p WHERE length(text) >= 20 AND length(substring(gold, 1, 4000)) >= 80),
    f AS (SELECT conv_id, list(turn) AS free, any_value(n) AS total, []::BIGINT[] AS taken FROM g JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c USING (conv_id) WHERE n >= 4 GROUP BY 1),
    """ + ", ".join(
    f"""s{k + 1} AS (SELECT conv_id, free, total, taken || list_transform(list_sort(list_transform(list_filter(free, lambda a: len(list_filter(taken, lambda x: abs(a - x) < 2)) = 0), lambda b: {{'d': abs(b - {share}::DOUBLE * total), 't': b}}))[1:1], lambda y: y.t) AS taken FROM {f"s{k}" if k else "f"})"""
    for k, share in enumerate((0.3, 0.5, 0.7, 0.9))
) + """ SELECT conv_id, turn, coalesce((SELECT length(string_agg(s, chr(10) || chr(10) ORDER BY turn)) FROM t WHERE t.conv_id = g.conv_id AND t.place < g.place), 0) AS context_chars
    FROM g JOIN (SELECT conv_id, unnest(taken) AS turn FROM s4) USING (conv_id, turn)"""
ORACLES["episode_chunks"] = """
    WITH d AS (SELECT doc_id AS context_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), 'The and attion') AS p FROM documents)
    SELECT context_id, count(*) AS n, sum(c)::BIGINT AS chars FROM (
      SELECT context_id, unnest(list_transform(p[2:], lambda x: length(x) + 14) || CASE WHEN regexp_matches(p[1], '[^ \\t\\n\\x0B\\f\\r]') THEN [length(p[1])] ELSE [] END) AS c FROM d WHERE len(p) > 1
      UNION ALL SELECT context_id, least(2000, length(t) - s) AS c FROM (SELECT context_id, t, unnest(range(0, greatest(length(t) - 1, 0) + 1, 1900)) AS s FROM d WHERE len(p) = 1)) GROUP BY 1"""
# As in question_terms, letters beyond ASCII are word characters.
ORACLES["carriers"] = """
    WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') AND NOT regexp_matches(regexp_replace(x, '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g'), '^\\s*(?:The|Thing)\\b')
        AND NOT (length(x) <= 240 AND regexp_matches(regexp_replace(x, '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g'), '(?i)\\b(?:the|and|der|que)\\b'))) AS kept FROM documents),
    c AS (SELECT doc_id, array_to_string(kept, chr(10)) AS t FROM l), n AS (SELECT greatest(1, count(*)) AS n FROM documents),
    s AS (SELECT item_id, text AS passage, substring(t, 1, 500) || chr(10) || chr(10) || text || chr(10) || chr(10) || right(t, 500) AS x FROM benchmark CROSS JOIN n JOIN c ON c.doc_id = item_id % n)
    SELECT item_id, length(x) AS chars, contains(x, passage) AS whole FROM s"""
ORACLES["carrier_tasks"] = """
    WITH l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') AND NOT regexp_matches(regexp_replace(x, '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g'), '^\\s*(?:The|Thing)\\b')
        AND NOT (length(x) <= 240 AND regexp_matches(regexp_replace(x, '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g'), '(?i)\\b(?:the|and|der|que)\\b'))) AS kept FROM documents),
    c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, coalesce(array_to_string(kept, chr(10)), '') AS t, length(text) AS raw FROM l), n AS (SELECT count(*) AS m FROM c),
    p AS (
      SELECT a.doc_id, a.raw, k, b.t, coalesce(sum(length(b.t)) OVER (PARTITION BY a.doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
      FROM c a CROSS JOIN n CROSS JOIN LATERAL (SELECT unnest(range(3 * m)) AS k) JOIN c b ON b.i = (a.i + k) % m WHERE b.t <> ''),
    s AS (SELECT doc_id, any_value(raw) AS raw, string_agg(t, chr(10) || chr(10) ORDER BY k) AS carrier FROM p WHERE had < greatest(1, 2 * raw) GROUP BY doc_id)
    SELECT c.doc_id, CASE WHEN length(carrier) >= s.raw THEN length(carrier) END AS chars, CASE WHEN length(carrier) >= s.raw THEN sha1(carrier) END AS sha1 FROM c LEFT JOIN s USING (doc_id)"""
