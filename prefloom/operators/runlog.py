"""Training logs and step metrics: parsing, failed steps, rollback targets, run health."""

from decimal import Decimal

from pyspark.sql import functions as F

from prefloom.functions import logs as L
from prefloom.functions import metrics as M
from prefloom.operators.ordering import running_aggregates


def parse_log(lines):
    """One row per metric or event line; other lines carry nothing and are left out.

    Step and rollback lines are most of what is kept. Their kind has already checked their
    format, so their fields are cut out between fixed separators, at a fraction of the cost of
    matching the pattern again for every field.
    """
    line, kind = F.col("value"), F.col("kind")
    tagged = lines.withColumn("kind", L.line_kind(line)).where(kind.isNotNull())
    is_step, is_failed = kind == "step", kind == "nan_rollback"
    is_metric = is_step | is_failed

    def match(name, pattern, group, cast):
        return F.when(kind == name, L.field(line, pattern, group, cast))

    step = F.when(is_metric, F.substring_index(L.before(line, "/"), " ", -1).try_cast("bigint"))
    return tagged.select(
        "run_id",
        "line_no",
        "kind",
        F.coalesce(step, match("checkpoint", L.CHECKPOINT_LINE, 1, "bigint")).alias("step"),
        F.when(is_metric, L.after(line, "/").try_cast("bigint")).alias("steps_requested"),
        F.when(is_step, L.after(line, "mean_reward=").try_cast("double")).alias("mean_reward"),
        F.when(is_metric, L.after(line, "kl=").try_cast("double")).alias("kl"),
        F.when(is_step, L.after(line, "val_var_explained=").try_cast("double")).alias("val_var_explained"),
        F.when(is_metric, L.before(L.after(line, "policy_loss="), ")").try_cast("double")).alias("policy_loss"),
        match("ratio_skip", L.RATIO_LINE, 1, "double").alias("ratio"),
        match("ratio_skip", L.RATIO_LINE, 2, "double").alias("ratio_threshold"),
        match("negative_kl", L.NEGATIVE_KL_LINE, 1, "double").alias("negative_kl"),
        match("checkpoint", L.CHECKPOINT_LINE, 2, "string").alias("path"),
        match("out_of_memory", L.OUT_OF_MEMORY_LINE, 1, "double").alias("memory_wanted"),
    )


_WORD = 1 << 64


def _packed(high, low):
    """Two numbers as one that orders by the first, then by the second; unlike a pair of them it is
    aggregated in a hash table. High numbers stay below 5 * 10**18."""
    shifted = low.cast("decimal(20,0)") + F.lit(Decimal(_WORD // 2)).cast("decimal(20,0)")
    return high.cast("decimal(19,0)") * F.lit(Decimal(_WORD)).cast("decimal(20,0)") + shifted


def _unpacked(packed):
    word = F.lit(Decimal(_WORD)).cast("decimal(20,0)")
    low = F.pmod(packed, word)
    return F.call_function("div", packed - low, word), (low - F.lit(Decimal(_WORD // 2)).cast("decimal(20,0)")).cast("bigint")


def mark_superseded(parsed):
    """Add `superseded` and `restart` to the lines of runs that may have been resumed.

    A resumed run starts again at a step that it logged before: a later metric line of the same or a
    lower step. What was logged from that step on did not lead to the final weights; those lines are
    superseded, whether or not the later attempt came as far. A line without a step belongs to the
    next metric line. `restart` marks the last metric line before a step that does not rise, so a
    run has one attempt more than restarts. (run_id, line_no) must be unique; rows without one of
    them are left out.

    Lines are walked backwards once, in blocks, so a run of any length is spread over tasks.
    """
    line, step, metric = F.col("line_no"), F.col("step"), _is_metric() & F.col("step").isNotNull()
    lines = parsed.where("run_id IS NOT NULL AND line_no IS NOT NULL").withColumn("_back", -line)
    walked = running_aggregates(
        lines,
        "_back",
        {
            # The lowest later step, the last line of it, and the next metric line.
            "_lowest": ("max", F.when(metric, _packed(-step, line))),
            "_next": ("max", F.when(metric, _packed(-line, step))),
        },
        by=["run_id"],
        inclusive=False,
    )
    (lowest, lowest_line), (next_line, next_step) = _unpacked(F.col("_lowest")), _unpacked(F.col("_next"))
    again = -lowest <= step
    # The next line is superseded if the lowest step comes again after it.
    event = lowest_line != -next_line
    return walked.withColumns(
        {
            "superseded": F.coalesce(F.when(step.isNotNull(), again).otherwise(event), F.lit(False)),
            "restart": F.coalesce(metric & (next_step <= step), F.lit(False)),
        }
    ).drop("_back", "_lowest", "_next")


def current_lines(marked):
    """The lines of the attempts that count: each step once."""
    return marked.where("NOT superseded").drop("superseded", "restart")


def attempts(marked):
    """Attempts of each run, and its lines that later ones supersede."""
    return marked.groupBy("run_id").agg(
        (F.count_if("restart") + 1).alias("attempts"), F.count_if("superseded").alias("superseded_lines")
    )


def nan_steps(metrics):
    return metrics.where(M.is_nan_step())


def rollback_targets(metrics, order="step"):
    """For each failed step the newest snapshot before it; null is the state at run start.

    A snapshot is taken at every tenth step that is not itself failed. The newest one is the
    running maximum of snapshot steps, which is carried across blocks of steps. A run that was
    resumed may log a step twice: order it by its line number instead.
    """
    step = F.col("step")
    keys = ["run_id", "step"] if order == "step" else ["run_id", "step", order]
    flagged = metrics.select(*keys, M.is_nan_step().alias("_nan"))
    taken = step if order == "step" else F.struct(order, "step")
    snapshot = F.when(~F.col("_nan") & M.is_snapshot_step(step), taken)
    newest = running_aggregates(
        flagged, order, {"restore_step": ("max", snapshot)}, by=["run_id"], inclusive=False
    ).where("_nan")
    if order != "step":
        newest = newest.withColumn("restore_step", F.col("restore_step.step"))
    return newest.drop("_nan")


def saved_steps(metrics):
    """Which steps take an in-memory snapshot and which write a checkpoint."""
    step = F.col("step")
    snapshot = ~M.is_nan_step() & M.is_snapshot_step(step)
    checkpoint = M.is_checkpoint_step(step)
    return metrics.select(
        "run_id", "step", snapshot.alias("snapshot"), checkpoint.alias("checkpoint")
    ).where(F.col("snapshot") | F.col("checkpoint"))


def unstable_steps(metrics, kl_target=M.KL_TARGET, factor=M.KL_STOP_FACTOR):
    """Steps whose KL is past the early-stop limit. NaN sorts above every number, so it is cut."""
    kl = F.col("kl")
    return metrics.where(~F.isnan(kl) & (kl > kl_target * factor))


def unstable_batches(parsed, limit=M.RATIO_LIMIT):
    """Batches skipped because their probability ratio went past the limit."""
    return parsed.where((F.col("kind") == "ratio_skip") & (F.col("ratio") > limit))


def _trend(counted):
    """Reward slope over steps and spread of KL; readings that are not finite are left out, counted."""

    def finite(name):
        return ~F.isnan(F.col(name)) & (F.abs(F.col(name)) != float("inf"))

    def usable(name):
        return F.when(finite(name), F.col(name))

    return [
        F.count_if(counted).alias("steps"),
        F.regr_slope(usable("mean_reward"), F.col("step").cast("double")).alias("reward_slope"),
        F.stddev_pop(usable("kl")).alias("kl_spread"),
        F.count_if(counted & M.is_nan_step()).alias("nan_steps"),
        F.count_if(counted & ~(finite("mean_reward") & finite("kl"))).alias("not_finite"),
    ]


def _summary():
    def kinds(name):
        return F.count_if(F.col("kind") == name)

    return [
        kinds("step").alias("steps_logged"),
        F.max("steps_requested").alias("steps_requested"),
        F.max(F.when(_is_metric(), F.col("step"))).alias("last_step"),
        kinds("nan_rollback").alias("nan_rollbacks"),
        kinds("ratio_skip").alias("ratio_skips"),
        F.max("ratio").alias("max_ratio"),
        kinds("negative_kl").alias("negative_kl_warnings"),
        kinds("checkpoint").alias("checkpoints"),
        (kinds("out_of_memory") > 0).alias("out_of_memory"),
    ]


def _is_metric():
    return F.col("kind").isin("step", "nan_rollback")


def run_trend(metrics):
    """Trend of each run from its step metrics."""
    return metrics.groupBy("run_id").agg(*_trend(F.lit(True)))


def run_summary(parsed):
    """What a run's log says about it, one row per run."""
    return parsed.groupBy("run_id").agg(*_summary())


def run_health(parsed):
    """Summary and trend of each run in one pass over its parsed log."""
    return parsed.groupBy("run_id").agg(*_summary(), *_trend(_is_metric()))


def resumed_health(parsed):
    """`run_health` of runs that may have been resumed: superseded lines count only as such.

    One aggregation over the marked lines; a run of which every line is superseded cannot be.
    """
    marked = mark_superseded(parsed)
    return run_health(current_lines(marked)).join(attempts(marked), "run_id")
