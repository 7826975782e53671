import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.functions import verdicts as V
from prefloom.operators import judging

TEXTS = ["equal", "both", "Answer: B", "TIE", "", "A", " a\n", "b"]


def readings(spark, name, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i INT, raw STRING")
    sign = V.READINGS[name](F.col("raw"))
    return [row[0] for row in frame.orderBy("i").select(V.letter(sign)).collect()]


def test_readings(spark):
    assert readings(spark, "tie_aware", TEXTS) == ["A", "B", "TIE", "TIE", "TIE", "A", "A", "B"]
    assert readings(spark, "forced", TEXTS) == ["A", "B", "B", "B", "B", "A", "A", "B"]
    assert readings(spark, "strict", TEXTS) == [None, None, None, "TIE", None, "A", "A", "B"]
    for name in V.READINGS:
        assert readings(spark, name, [None]) == [None]


def candidates(spark, n):
    return spark.range(n).select(
        F.col("id").alias("cand_id"), F.concat(F.lit("p"), "id").alias("prompt"),
        F.concat(F.lit("a"), "id").alias("response_a"), F.concat(F.lit("b"), "id").alias("response_b"),
    )


def attempts(spark, rows):
    return spark.createDataFrame(rows, "cand_id BIGINT, attempt INT, raw STRING")


def swaps(spark, n):
    rows = judging.with_swap(candidates(spark, n), ["cand_id"], "s").collect()
    return {row.cand_id: row.swapped for row in rows}


def test_swap_is_a_repeatable_fair_coin(spark):
    flips = swaps(spark, 2000)
    assert flips == swaps(spark, 2000)
    assert 900 < sum(flips.values()) < 1100


def test_first_attempt_with_text_wins(spark):
    rows = attempts(spark, [
        (0, 0, None), (0, 1, "B"), (0, 2, "A"),
        (1, 0, ""), (1, 1, "A"),
        (2, 0, None), (2, 1, None), (2, 2, None), (2, 3, "A"),
    ])
    resolved = judging.resolve_attempts(rows, ["cand_id"], "forced")
    assert {row.cand_id: (row.sign, row.answered) for row in resolved.collect()} == {
        0: (V.B, True), 1: (V.B, True), 2: (None, False),
    }


def test_label_pairs_unswaps_and_defaults(spark):
    flips = swaps(spark, 40)
    rows = [(i, 0, "A" if i % 2 else "B") for i in range(30)] + [(i, n, None) for i in range(30, 35) for n in range(3)]
    rows = attempts(spark, rows)
    labelled = judging.label_pairs(candidates(spark, 40), rows, "s").collect()
    assert sorted(row.cand_id for row in labelled) == list(range(35))
    for row in labelled:
        i = row.cand_id
        shown = "A" if i >= 30 or i % 2 else "B"
        assert row.defaulted == (i >= 30)
        verdict = shown if not flips[i] else {"A": "B", "B": "A"}[shown]
        assert row.verdict == verdict
        sides = (f"a{i}", f"b{i}") if verdict == "A" else (f"b{i}", f"a{i}")
        assert (row.chosen_response, row.rejected_response) == sides


def test_pair_transcripts(spark):
    labelled = judging.label_pairs(candidates(spark, 1), attempts(spark, [(0, 0, "A")]), "s")
    row = judging.pair_transcripts(labelled, "ai").first()
    assert {row.chosen, row.rejected} == {"p0 a0", "p0 b0"} and row.labeler == "ai"


def test_unswap_twice_is_identity(spark):
    frame = spark.sql("SELECT s, w FROM VALUES (1), (-1), (0) AS a(s) JOIN VALUES (true), (false) AS b(w) ON true")
    twice = V.unswap(V.unswap(F.col("s"), F.col("w")), F.col("w"))
    assert frame.where(twice != F.col("s")).count() == 0


@pytest.mark.parametrize("rubric", [judging.TIE_RUBRIC, judging.FORCED_RUBRIC])
def test_requests_keep_texts_as_they_are(spark, rubric):
    awkward = "100% {prompt} {response_b} \\ '"
    rows = spark.createDataFrame(
        [(i, awkward, f"{awkward}A", f"{awkward}B") for i in range(20)],
        "cand_id BIGINT, prompt STRING, response_a STRING, response_b STRING",
    )
    requests = judging.judge_requests(rows, ["cand_id"], rubric, "s").collect()
    assert {row.swapped for row in requests} == {True, False}
    for row in requests:
        first, second = ("B", "A") if row.swapped else ("A", "B")
        assert f"Prompt:\n{awkward}\n\nResponse A:\n{awkward}{first}\n\nResponse B:\n{awkward}{second}\n\n" in row.request
        assert row.request.startswith("You are ") and row.request.endswith("\n")


def test_verdicts_are_hashed_not_sorted(spark):
    rows = attempts(spark, [(0, 0, "A")])
    plan = judging.resolve_attempts(rows, ["cand_id"], "tie_aware")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.sampled_from([None, *TEXTS])), max_size=30,
                unique_by=lambda row: row[:2]))
def test_resolution_matches_a_loop(spark, rows):
    want = {}
    for item, attempt, raw in sorted(rows, key=lambda row: row[:2]):
        if attempt < 3 and raw is not None and item not in want:
            text = raw.upper()
            want[item] = ("A" in text) - ("B" in text)
    got = judging.resolve_attempts(attempts(spark, rows), ["cand_id"], "tie_aware").collect()
    assert {row.cand_id: row.sign for row in got if row.answered} == want
    assert {row.cand_id for row in got} == {item for item, attempt, _ in rows if attempt < 3}


def test_unreadable_answers_are_not_missing_ones(spark):
    rows = attempts(spark, [(0, 0, "both"), (1, 0, None), (2, 1, "A"), (2, 1, "B"), (2, 2, "A")])
    got = {r.cand_id: (r.sign, r.answered) for r in judging.resolve_attempts(rows, ["cand_id"], "strict").collect()}
    assert got == {0: (None, True), 1: (None, False), 2: (-1, True)}
    judged = {r.cand_id: (r.sign is None, r.defaulted) for r in judging.decide(candidates(spark, 4), rows, ["cand_id"], "strict", "s").collect()}
    assert judged == {0: (True, False), 1: (False, True), 2: (False, False), 3: (True, False)}


def test_compare_readings(spark):
    rows = attempts(spark, [(0, 0, "A"), (0, 1, "both"), (1, 0, "both"), (1, 1, None)])
    got = {(r.tie_aware, r.forced, r.strict): r.replies for r in judging.compare_readings(rows).collect()}
    assert got == {("A", "A", "A"): 1, ("B", "B", "none"): 2}


def test_a_third_of_all_replies_on_one_item(spark):
    """Map tasks combine an item's replies, so a hot item sends one row per task."""
    hot = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("cand_id"),
        F.when(F.col("id") < 10_000, F.col("id") % 3).otherwise(0).cast("int").alias("attempt"),
        F.when((F.col("id") < 10_000) & (F.col("id") % 3 == 0), None).otherwise("B").alias("raw"),
    )
    resolved = judging.resolve_attempts(hot, ["cand_id"], "forced")
    assert "partial_min(" in resolved._jdf.queryExecution().executedPlan().toString()
    rows = {row.cand_id: row.sign for row in resolved.collect()}
    assert len(rows) == 20_001 and set(rows.values()) == {V.B}
