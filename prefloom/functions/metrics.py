"""Reward and step-metric expressions.

Spark treats NaN as equal to NaN, so `x != x` never finds one: isnan is used throughout.
"""

from functools import reduce

from pyspark.sql import functions as F

NAN, POS_INF, NEG_INF = float("nan"), float("inf"), float("-inf")

# Replacements for rewards that are not finite.
REWARD_NAN, REWARD_POS_INF, REWARD_NEG_INF = 0.0, 10.0, -10.0

# Snapshot and checkpoint cadence, KL target with its stop factor, ratio limit,
# score clip and batch size of a run.
SNAPSHOT_EVERY = 10
CHECKPOINT_EVERY = 100
KL_TARGET, KL_STOP_FACTOR = 6.0, 1.5
RATIO_LIMIT = 10.0
SCORE_CLIP = 3.0
BATCH_SIZE = 16


def clean_reward(reward):
    return (
        F.when(F.isnan(reward), REWARD_NAN)
        .when(reward == POS_INF, REWARD_POS_INF)
        .when(reward == NEG_INF, REWARD_NEG_INF)
        .otherwise(reward)
    )


def any_nan(*metrics):
    """True when a metric is NaN or missing. Infinities are not NaN."""
    return reduce(
        lambda left, right: left | right,
        [F.isnan(F.coalesce(metric, F.lit(NAN))) for metric in metrics],
    )


def is_nan_step():
    return any_nan(F.col("kl"), F.col("val_var_explained"), F.col("policy_loss"))


def is_snapshot_step(step):
    return F.pmod(step, F.lit(SNAPSHOT_EVERY)) == 0


def is_checkpoint_step(step):
    return (step > 0) & (F.pmod(step, F.lit(CHECKPOINT_EVERY)) == 0)
