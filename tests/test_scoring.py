"""Scorers and text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import scoring
from foliant.functions import text as T


@pytest.mark.parametrize(
    "scorer, gold, answer, wanted",
    [
        ("numeric_075", "10", "11", 0.75), ("numeric_075", "10", "1,000", 0.75**9), ("numeric_075", "ten", "10", 0.0), ("oolong_text_ci", "incorrect", "Label: incorrect", 1.0),
        ("oolong_comparison_ci", "the same frequency", "Answer: incorrect is same frequency before 2024-12-20", 1.0), ("date_ci", "2023-10-21", "Date: October 21, 2023", 1.0), ("date_ci", "2023-10-21", "21st Oct 2023", 1.0),
        ("date_ci", "datetime.date(2023, 1, 5)", "2023-01-05", 1.0), ("month_year_ci", "October 2022", "Answer: Oct 2022", 1.0), ("csv_overlap_ci", "a, b, c", "B,a", 2 / 3), ("csv_set_ci", "apple,football", "football, apple", 1.0),
        ("csv_set_ci", "apple,football", "apple,milk", 0.0), ("multiple_choice", "b", "I say B.", 1.0), ("multiple_choice", "b", "b", 0.0), ("exact", "x", ' "x" ', 1.0), ("exact_ci", "X", "x", 1.0), ("substring_ci", " Cat ", "a cat sat", 1.0), ("exact", "x", None, 0.0),
    ],
)
def test_scorers(spark, scorer, gold, answer, wanted):
    row = spark.createDataFrame([(scorer, gold, answer)], "scorer string, gold_answer string, answer string")
    got = scoring.score_runs(row).first()
    assert got["score"] == pytest.approx(wanted)
    assert got["correct"] == (wanted >= 1)


def test_aliases_take_the_best(spark):
    row = spark.createDataFrame([("exact", "a", ["b", "c"], "c")], "scorer string, gold_answer string, gold_answer_aliases array<string>, answer string")
    assert scoring.score_runs(row).first()["score"] == 1.0


def test_answer_tail_and_fallback(spark):
    rows = spark.createDataFrame([(1, 'x {"answer": "a"} y {"answer": "b"}'), (2, "thinking\n```\nFinal answer: c\n```"), (3, '{"answer": "a", "more": 1}\nlast'), (4, ""), (5, None)], "id int, raw string")
    text, mode = T.answer_with_fallback(F.col("raw"))
    got = {r["id"]: (r["t"], r["m"]) for r in rows.select("id", text.alias("t"), mode.alias("m")).collect()}
    assert got[1] == ("b", "json") and got[2] == ("c", "text_fallback") and got[3] == ("last", "text_fallback") and got[4][1] == "empty" and got[5][1] == "failed"


def test_overlap_scores():
    assert scoring.overlap_scores("a b c d", "a b c d") == (1.0, 1.0, pytest.approx(1.0))
    assert scoring.common_length(list("abcbdab"), list("bdcaba")) == 4
    assert scoring.overlap_scores("", "a") == (0.0, 0.0, 0.0)


def test_relaxed(spark):
    rows = spark.createDataFrame([("the office", "office", 1.0), ("No record of it", "unknown", 1.0), ("C", "C", 1.0), ("it is in the garden now", "garden", 1.0), ("park", "school", 0.0), (None, "x", 0.0)], "answer string, gold string, wanted double")
    for r in rows.withColumn("got", scoring.relaxed(F.col("answer"), F.col("gold"))).collect():
        assert r["got"] == r["wanted"], r


def test_text_functions(spark):
    row = spark.createDataFrame([("What did Mary Jane eat 12 days ago, and where are the Cats?",)], "q string")
    got = row.select(
        T.requested_age(F.col("q")).alias("age"), T.focus_entities(F.col("q")).alias("e"), T.capitalised_terms(F.col("q")).alias("c"), T.morph_variants(F.array(F.lit("cats"), F.lit("go"))).alias("m"), T.ranked_terms(F.col("q")).alias("r"),
        T.preview(F.lit(" a  b\nc d "), 5).alias("p"), T.sanitise(F.lit("a b/c"), "dash").alias("s"), T.tokens_est(F.lit("")).alias("t"), T.judge_verdict(F.lit('so {"equivalent": true}')).alias("j"), T.code_answer(F.lit("submit_answer('x y')")).alias("a"),
    ).first()
    assert (got["age"], got["e"], got["t"], got["j"], got["a"], got["s"]) == (12, ["mary", "jane", "cats"], 1, True, "x y", "a-b-c")
    assert got["c"] == ["Mary Jane", "Cats"] and got["m"] == ["cats", "cat", "catsed", "catsing", "go"] and got["p"] == "a b…"
    assert got["r"][:3] == ["mary", "cats", "jane"] or set(got["r"][:3]) == {"mary", "jane", "cats"}
