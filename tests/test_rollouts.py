import math
import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators import rollouts

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n,batch", [(5, 16), (16, 16), (17, 16), (50, 16), (1, 4), (3, 4)])
def test_cursor_matches_slicing(spark, n, batch):
    steps = 25
    prompts = list(range(n))
    want = []
    for step in range(3, steps):
        begin = (step * batch) % n
        taken = prompts[begin:begin + batch]
        taken = taken + prompts[: batch - len(taken)]
        want += [(step, slot, p) for slot, p in enumerate(taken)]
    slots = rollouts.batch_slots(spark, 3, steps, batch)
    got = rollouts.cursor_positions(slots, n, batch).select("step", "slot", "position")
    assert sorted(map(tuple, got.collect())) == want


def test_batch_cursor_uses_key_order(spark):
    prompts = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "prompt_id BIGINT, prompt STRING")
    got = rollouts.batch_cursor(rollouts.batch_slots(spark, 0, 2, 2), prompts, batch_size=2)
    assert [r.prompt for r in got.orderBy("step", "slot").collect()] == ["a", "b", "c", "a"]


def test_clean_rewards(spark):
    rows = [(i, x) for i, x in enumerate([NAN, INF, -INF, 1.5, None])]
    frame = spark.createDataFrame(rows, "i INT, reward DOUBLE")
    got = rollouts.clean_rewards(frame).orderBy("i").collect()
    assert [r.reward for r in got] == [0.0, 10.0, -10.0, 1.5, None]


def rewards(spark, n_steps=40, seed=1):
    rng = random.Random(seed)
    rows = [
        (run, step, slot, rng.choice([NAN, INF, -INF]) if rng.random() < 0.1 else rng.gauss(-3, 1.5))
        for run in (0, 1) for step in range(n_steps) for slot in range(4)
    ]
    return rows, spark.createDataFrame(rows, "run_id BIGINT, step BIGINT, slot BIGINT, reward DOUBLE")


def cleaned(value):
    if math.isnan(value):
        return 0.0
    return max(-10.0, min(10.0, value)) if math.isinf(value) else value


def test_step_means(spark):
    rows, frame = rewards(spark)
    got = {(r.run_id, r.step): r.mean_reward for r in rollouts.reward_by_step(frame).collect()}
    assert len(got) == 80
    for (run, step), mean in got.items():
        values = [cleaned(r[3]) for r in rows if r[:2] == (run, step)]
        assert mean == pytest.approx(sum(values) / 4)


def test_scaled_rewards_match_a_loop(spark):
    rows, frame = rewards(spark)
    got = {(r.run_id, r.step, r.slot): r.scaled for r in rollouts.scale_rewards(frame).collect()}
    assert len(got) == len(rows)
    for run, step, slot, value in rows:
        seen = [cleaned(r[3]) for r in rows if r[0] == run and r[1] <= step]
        mean = sum(seen) / len(seen)
        std = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen))
        want = max(-3.0, min(3.0, (cleaned(value) - mean) / std))
        assert got[run, step, slot] == pytest.approx(want, abs=1e-9)


def test_constant_rewards_scale_to_zero(spark):
    frame = spark.range(40).select(
        F.lit(0).cast("bigint").alias("run_id"), (F.col("id") / 4).cast("bigint").alias("step"),
        (F.col("id") % 4).alias("slot"), F.lit(0.1).alias("reward"),
    )
    assert {r.scaled for r in rollouts.scale_rewards(frame).collect()} == {0.0}


@pytest.mark.parametrize("base,spread", [(1e8, 0.5), (0.0, 1e-7), (-3.0, 1e-7)])
def test_large_means_and_small_spreads_keep_their_digits(spark, base, spread):
    dice = random.Random(1)
    rows = [(0, step, slot, base + spread * dice.uniform(-1, 1)) for step in range(30) for slot in range(4)]
    frame = spark.createDataFrame(rows, "run_id BIGINT, step BIGINT, slot BIGINT, reward DOUBLE")
    got = {(r.step, r.slot): r.scaled for r in rollouts.scale_rewards(frame).collect()}
    for _, step, slot, value in rows:
        seen = [r[3] for r in rows if r[1] <= step]
        mean = math.fsum(seen) / len(seen)
        std = math.sqrt(math.fsum((x - mean) ** 2 for x in seen) / len(seen))
        assert got[step, slot] == pytest.approx(max(-3.0, min(3.0, (value - mean) / std)), abs=1e-5)


def test_null_rewards_stay_null(spark):
    frame = spark.createDataFrame(
        [(0, 0, 0, None), (0, 0, 1, 1.0), (0, 0, 2, 3.0), (1, 0, 0, None)],
        "run_id BIGINT, step BIGINT, slot BIGINT, reward DOUBLE",
    )
    got = {(r.run_id, r.slot): r.scaled for r in rollouts.scale_rewards(frame).collect()}
    assert got == {(0, 0): None, (0, 1): -1.0, (0, 2): 1.0, (1, 0): None}


def test_zip(spark):
    keys = "run_id BIGINT, step BIGINT, slot BIGINT"
    cursor = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 6)], f"{keys}, prompt_id BIGINT")
    scores = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0)], f"{keys}, reward DOUBLE")
    responses = spark.createDataFrame([(0, 0, 1, "s"), (0, 0, 0, "r")], f"{keys}, response STRING")
    got = rollouts.zip_rollout(cursor, scores, responses).orderBy("slot").collect()
    assert [(r.prompt_id, r.reward, r.response) for r in got] == [(5, 1.0, "r"), (6, 2.0, "s")]
