"""Rollout batches, reward clean-up and step statistics."""

from functools import reduce

from pyspark.sql import functions as F

from prefloom.functions import metrics as M
from prefloom.operators.ordering import running_aggregates, with_position
from prefloom.operators.sums import exact_sums, grid_exponent, grid_limbs, grid_value, on_grid

SLOT_KEYS = ["run_id", "step", "slot"]


def batch_slots(spark, start, steps, batch_size=M.BATCH_SIZE):
    """Every (step, slot) for steps in [start, steps)."""
    return spark.range(start, steps).select(
        F.col("id").alias("step"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batch_size - 1).cast("bigint"))).alias("slot"),
    )


def cursor_positions(slots, n_prompts, batch_size=M.BATCH_SIZE):
    """Add the prompt position each slot reads; slots that read nothing are left out.

    A batch starts at (step * batch_size) modulo the number of prompts and wraps to the front
    once. With fewer prompts than slots the batch stays short, as it does when lists are sliced.
    `n_prompts` is a number or a scalar subquery.
    """
    total = F.lit(n_prompts) if isinstance(n_prompts, int) else n_prompts
    staged = slots.withColumn("_n", total.cast("bigint"))
    start = F.pmod(F.col("step") * batch_size, F.col("_n"))
    staged = staged.withColumn("_start", start)
    head = F.least(F.lit(batch_size), F.col("_n") - F.col("_start"))
    slot = F.col("slot")
    position = F.when(slot < head, F.col("_start") + slot).otherwise(slot - head)
    return staged.withColumn("position", position).where(F.col("position") < F.col("_n")).drop(
        "_n", "_start"
    )


def batch_cursor(slots, prompts, key="prompt_id", batch_size=M.BATCH_SIZE):
    """The prompt of every slot, prompts standing in key order."""
    count = prompts.agg(F.count("*")).scalar()
    placed = cursor_positions(slots, count, batch_size)
    return placed.join(with_position(prompts, key), "position")


def zip_rollout(*parts, keys=SLOT_KEYS):
    """Join tables of the same slots: prompt ids, rewards, responses.

    Put narrow tables first, and attach prompt texts by prompt id afterwards: a prompt is read
    by many slots, so its text should not travel through these joins.
    """
    return reduce(lambda left, right: left.join(right, list(keys)), parts)


def clean_rewards(rollouts):
    return rollouts.withColumn("reward", M.clean_reward(F.col("reward")))


def reward_by_step(rollouts):
    """Mean reward of each step, after the clean-up; the same however rows are dealt to partitions."""
    summed = exact_sums(clean_rewards(rollouts), ["run_id", "step"], {"r": F.col("reward"), "one": F.lit(1.0)})
    return summed.select(
        "run_id", "step", F.col("one_n").alias("n_slots"), F.try_divide("r", "r_n").alias("mean_reward")
    )


def scale_rewards(rollouts, clip=M.SCORE_CLIP):
    """Each reward normalised by the statistics of its run up to its step, then clipped.

    Rows become sums per step first; the running statistics walk over steps, not rows, and in blocks,
    so a run that holds most of the data is still spread out. All sums are of integers on a grid
    2**-57 of the run's range fine, so results do not depend on partitions. Squares are of distances
    from the run's mean, so large rewards of a small spread lose no digits. The deviation is zero only where all rewards so far are equal.
    """
    cleaned = clean_rewards(rollouts)
    reward = F.col("reward")
    low, high = F.col("r_low"), F.col("r_high")
    runs = exact_sums(cleaned, ["run_id"], {"r": reward}).select(
        "run_id",
        F.try_divide("r", "r_n").alias("_centre"),
        grid_exponent(F.greatest(F.abs(low), F.abs(high))).alias("_grid_x"),
        grid_exponent(high - low).alias("_grid_s"),
        grid_exponent((high - low) * (high - low)).alias("_grid_q"),
    )
    off = reward - F.col("_centre")
    sums = {"x": reward, "s": off, "q": off * off}
    limbs = {name: (f"_{name}_hi", f"_{name}_lo") for name in sums}
    grids = [f"_grid_{name}" for name in sums]
    placed = cleaned.select("run_id", "step", "reward").join(runs, "run_id").withColumns(
        {f"_{name}": on_grid(column, F.col(f"_grid_{name}")) for name, column in sums.items()}
    )
    cut = placed.select(
        "run_id", "step", "reward", *grids, *[part for name in sums for part in grid_limbs(F.col(f"_{name}"), limbs[name])]
    )
    # The grids are the same in all rows of a run.
    per_step = cut.groupBy("run_id", "step", *grids).agg(
        F.count("reward").alias("_n"),
        F.max("reward").alias("_high"),
        F.max(-reward).alias("_low"),
        *[F.sum(part).alias(part) for parts in limbs.values() for part in parts],
    )
    running = running_aggregates(
        per_step,
        "step",
        {
            "n": ("sum", F.col("_n")),
            "high": ("max", F.col("_high")),
            "low": ("max", F.col("_low")),
            **{part[1:]: ("sum", F.col(part)) for parts in limbs.values() for part in parts},
        },
        by=["run_id"],
    )
    x, s, q = [
        F.try_divide(grid_value(F.col(f"{name}_hi"), F.col(f"{name}_lo"), F.col(f"_grid_{name}")), F.col("n"))
        for name in sums
    ]
    moments = running.select(
        "run_id",
        "step",
        x.alias("running_mean"),
        F.when(F.col("high") == -F.col("low"), F.lit(0.0))
        .otherwise(F.sqrt(F.greatest(q - s * s, F.lit(0.0))))
        .alias("running_std"),
    )
    centred = (reward - F.col("running_mean")) / F.col("running_std")
    scaled = F.when(F.col("running_std") == 0, F.lit(0.0) * reward).otherwise(centred)
    return cleaned.join(moments, ["run_id", "step"]).withColumn(
        "scaled",
        F.when(scaled.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))),
    )
