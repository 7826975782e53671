from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from prefloom.operators import judging, matchups
from tests.conftest import plan_of

NAMES = ["dpo", "dpo_b", "ppo", "sft"]


def roster(spark, names=NAMES):
    return spark.createDataFrame([(name,) for name in names], "model STRING")


def prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("prompt_id"))


@pytest.mark.parametrize("count", [2, 3, 7])
def test_model_pairs(spark, count):
    names = [f"m{i}" for i in range(count)]
    pairs = matchups.model_pairs(roster(spark, names[::-1]))
    assert sorted(map(tuple, pairs.collect())) == list(combinations(names, 2))
    numbered = matchups.numbered_pairs(roster(spark, names), count).orderBy("pair_no").collect()
    assert [(r.pair_no, r.name_a, r.name_b) for r in numbered] == [
        (i, *pair) for i, pair in enumerate(combinations(names, 2))
    ]


def test_one_model_is_refused(spark):
    for call in (matchups.model_pairs, matchups.require_models):
        with pytest.raises(ValueError, match="at least 2"):
            call(roster(spark, ["sft"]))


def test_match_items(spark):
    items = matchups.match_items(prompts(spark, 5), roster(spark))
    want = [(i, a, b) for i in range(5) for a, b in combinations(NAMES, 2)]
    assert sorted(map(tuple, items.collect())) == want
    plan = plan_of(items)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_generation_gaps(spark):
    made = [(i, name, "x") for i, name in product(range(6), NAMES) if (i + len(name)) % 4]
    generations = spark.createDataFrame(made, "prompt_id BIGINT, model STRING, response STRING")
    gaps = matchups.generation_gaps(prompts(spark, 6), roster(spark), generations)
    want = set(product(range(6), NAMES)) - {row[:2] for row in made}
    assert {tuple(row) for row in gaps.collect()} == want


def test_match_texts(spark):
    rows = {(i, name): f"{name}{i}" for i, name in product(range(4), NAMES) if (i, name) != (2, "ppo") and i != 3}
    generations = spark.createDataFrame([(*k, v) for k, v in rows.items()], "prompt_id BIGINT, model STRING, response STRING")
    texts = matchups.match_texts(prompts(spark, 4), generations, roster(spark))
    want = [
        (i, a, b, rows.get((i, a)), rows.get((i, b)), (i, a) not in rows or (i, b) not in rows)
        for i in range(4)
        for a, b in combinations(NAMES, 2)
    ]
    assert sorted(map(tuple, texts.collect()), key=lambda r: r[:3]) == want


def test_texts_are_never_dealt_by_a_model_name(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = [f"m{i:03}" for i in range(200)]
    generations = spark.range(10).select(F.col("id").alias("prompt_id"), F.lit("m001").alias("model"), F.lit("x").alias("response"))
    plan = plan_of(matchups.match_texts(prompts(spark, 10), generations, roster(spark, names)))
    assert "hashpartitioning(prompt_id" in plan and "hashpartitioning(name" not in plan and "hashpartitioning(model" not in plan


def judged(spark, n=12, winner=None):
    """Every displayed verdict chosen so that `winner` (or side A) wins after the un-swap."""
    items = matchups.match_items(prompts(spark, n), roster(spark))
    swapped = judging.with_swap(items, matchups.MATCH_KEYS, "s")
    a_wins = F.col("name_a") == winner if winner else F.lit(True)
    b_wins = F.col("name_b") == winner if winner else F.lit(False)
    shown = (
        F.when(a_wins, F.when(F.col("swapped"), "B").otherwise("A"))
        .when(b_wins, F.when(F.col("swapped"), "A").otherwise("B"))
        .otherwise("TIE")
    )
    attempts = swapped.select(*matchups.MATCH_KEYS, F.lit(0).alias("attempt"), shown.alias("raw"))
    return matchups.judge_matches(items, attempts, "s")


def test_counts_and_board(spark):
    n = 12
    counts = matchups.match_counts(judged(spark, n, "ppo"), roster(spark))
    rows = {(r.name_a, r.name_b): (r.a_wins, r.b_wins, r.ties) for r in counts.collect()}
    assert rows[("dpo", "ppo")] == (0, n, 0) and rows[("ppo", "sft")] == (n, 0, 0)
    assert rows[("dpo", "sft")] == (0, 0, n)
    assert all(sum(row) == n for row in rows.values())

    board = matchups.leaderboard(counts, roster(spark)).collect()
    assert [r.model for r in board] == ["ppo", "dpo", "dpo_b", "sft"]
    assert [r.wins for r in board] == [3 * n, 0, 0, 0]
    assert {r.played for r in board} == {3 * n}
    assert board[0].win_rate == board[0].decided_rate == 1.0
    assert board[1].decided_rate == 0.0

    totals = matchups.match_totals(counts).first()
    assert totals.total == 6 * n == totals.ties + sum(r.wins for r in board)


def test_models_and_pairs_without_verdicts_keep_rows(spark):
    only = judged(spark, 3).where("name_a = 'dpo' AND name_b = 'ppo'")
    counts = matchups.match_counts(only, roster(spark))
    assert counts.count() == 6
    assert counts.where("a_wins + b_wins + ties = 0").count() == 5
    board = {r.model: r for r in matchups.leaderboard(counts, roster(spark)).collect()}
    assert board["dpo"].wins == 3 and board["sft"].wins == 0
    assert board["sft"].win_rate is None and board["ppo"].win_rate == 0.0


def test_items_without_a_text_default_and_items_never_attempted_count_nowhere(spark):
    items = matchups.match_items(prompts(spark, 50), roster(spark))
    none = spark.createDataFrame([], "prompt_id BIGINT, name_a STRING, name_b STRING, attempt INT, raw STRING")
    tried = items.select("*", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("raw"))
    rows = matchups.judge_matches(items, tried, "s").collect()
    assert len(rows) == 300 and all(row.defaulted for row in rows)
    assert all(row.sign == (-1 if row.swapped else 1) for row in rows)
    counts = matchups.match_counts(matchups.judge_matches(items, none, "s"), roster(spark))
    assert {tuple(r)[2:] for r in counts.collect()} == {(0, 0, 0, 0, 50)}
    board = matchups.leaderboard(counts, roster(spark)).collect()
    assert {(r.wins, r.played, r.win_rate, r.unjudged) for r in board} == {(0, 0, None, 150)}
    assert tuple(matchups.match_totals(counts).first()) == (0, 0, 0, 300)


def test_registry_filter(spark):
    listing = roster(spark, ["sft", "reward_model", "reward_model_ai", "ppo", "ppo_checkpoint"])
    assert [r.model for r in matchups.comparable_models(listing).collect()] == ["ppo", "ppo_checkpoint", "sft"]
    kept = matchups.comparable_models(listing, exclude=["ppo_checkpoint"])
    assert [r.model for r in kept.collect()] == ["ppo", "sft"]


def test_win_tables_never_read_texts(spark):
    counts = matchups.match_counts(judged(spark), roster(spark))
    assert "response" not in plan_of(counts)


def test_repeated_and_null_generations_are_met(spark):
    rows = [(0, "ppo", "b"), (0, "ppo", "a"), (0, "ppo", "a"), (0, "sft", None), (0, "sft", "s"), (0, None, "x"), (None, "ppo", "y")]
    rows += [(1, "dpo", None), (1, "other", "z"), (1, "dpo_b", "")]
    generations = spark.createDataFrame(rows * 3, "prompt_id BIGINT, model STRING, response STRING")
    texts = {(r.prompt_id, r.name_a, r.name_b): (r.response_a, r.response_b, r.missing) for r in
             matchups.match_texts(prompts(spark, 2), generations, roster(spark)).collect()}
    assert len(texts) == 12
    assert texts[0, "ppo", "sft"] == ("a", "s", False) and texts[0, "dpo", "ppo"] == (None, "a", True)
    assert texts[1, "dpo", "dpo_b"] == (None, "", True)


def test_bucketed_tables_meet_without_a_shuffle(spark, conf, tmp_path):
    from prefloom.sources.sinks import write_bucketed

    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(i, name, f"{name}{i}") for i, name in product(range(40), NAMES)]
    generations = spark.createDataFrame(rows * 2, "prompt_id BIGINT, model STRING, response STRING")
    asked = write_bucketed(prompts(spark, 40), "asked_b", "prompt_id", 5, str(tmp_path / "asked"))
    made = write_bucketed(generations, "made_b", "prompt_id", 5, str(tmp_path / "made"))
    texts = matchups.match_texts(asked, made, roster(spark))
    assert "hashpartitioning" not in plan_of(texts)
    got = sorted(map(tuple, texts.collect()))
    assert got == sorted(map(tuple, matchups.match_texts(prompts(spark, 40), generations, roster(spark)).collect()))
    assert len(got) == 240 and not any(row[-1] for row in got)
    for table in ("asked_b", "made_b"):
        spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("count", [1, 63, 64, 65, 130])
def test_gaps_for_every_roster_size(spark, count):
    names = [f"m{i:03}" for i in range(count)]
    made = {(p, n) for p in range(5) for i, n in enumerate(names) if (p * 7 + i) % 5 and p != 3}
    rows = [(*key, None) for key in sorted(made)] * 2 + [(0, None, "x"), (0, "stranger", "x"), (None, names[0], "x")]
    generations = spark.createDataFrame(rows, "prompt_id BIGINT, model STRING, response STRING")
    gaps = matchups.generation_gaps(prompts(spark, 5), roster(spark, names), generations)
    assert sorted(map(tuple, gaps.collect())) == sorted(set(product(range(5), names)) - made)


def test_gaps_shuffle_one_row_per_prompt(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    generations = spark.createDataFrame([(1, "ppo", "x")], "prompt_id BIGINT, model STRING, response STRING")
    plan = plan_of(matchups.generation_gaps(prompts(spark, 3), roster(spark), generations))
    assert "Generate" in plan and "hashpartitioning(model" not in plan and "partial_bit_or" in plan


def test_tally_equals_counts_over_all_items(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [
        (i, a, b, attempt, None if i % 6 == 0 else [None, "A", "B", "TIE", "both", ""][(i * 7 + len(a) + 3 * len(b) + attempt) % 6])
        for i in range(30) for a, b in combinations(NAMES + ["stranger"], 2) for attempt in range(4) if (i + len(b)) % 4
    ]
    rows += [(None, "dpo", "ppo", 0, "A"), (3, None, "ppo", 0, "A"), (3, "sft", "dpo", 0, "A"), (99, "dpo", "ppo", 0, "A")]
    attempts = spark.createDataFrame(rows, "prompt_id BIGINT, name_a STRING, name_b STRING, attempt INT, raw STRING")
    items = matchups.match_items(prompts(spark, 30), roster(spark))
    want = matchups.match_counts(matchups.judge_matches(items, attempts, "s"), roster(spark))
    tally = matchups.match_tally(prompts(spark, 30), attempts, roster(spark), "s")
    assert sorted(map(tuple, tally.collect())) == sorted(map(tuple, want.select(*tally.columns).collect()))
    assert tally.where("unjudged > 0 AND defaulted > 0").count() > 0
    nobody = matchups.match_tally(prompts(spark, 30), attempts.where("false"), roster(spark), "s").collect()
    assert {tuple(r)[2:] for r in nobody} == {(0, 0, 0, 0, 30)}
