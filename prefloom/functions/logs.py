"""Patterns of training-log lines."""

from pyspark.sql import functions as F

# The line formats a training run prints.
STEP_LINE = (
    r"^step ([0-9]+)/([0-9]+)  mean_reward=([^ ]+)  kl=([^ ]+)  "
    r"val_var_explained=([^ ]+)  policy_loss=([^ ]+)$"
)
NAN_LINE = r"^step ([0-9]+)/([0-9]+)  NaN detected \(kl=([^ ]+) policy_loss=([^ )]+)\)"
CHECKPOINT_LINE = r"\[checkpoint saved at step ([0-9]+) -> (.*)\]"
RATIO_LINE = (
    r"The average ratio of batch \(([^)]+)\) exceeds threshold ([0-9.]+)\. Skipping batch"
)
NEGATIVE_KL_LINE = r"KL divergence is starting to become negative: ([^ ]+)"
OUT_OF_MEMORY_LINE = r"OutOfMemoryError: CUDA out of memory\. Tried to allocate ([0-9.]+) ([A-Za-z]+)"

# Kind, a fragment every line of that kind holds, and its pattern.
KINDS = [
    ("step", "mean_reward=", STEP_LINE),
    ("nan_rollback", "NaN detected", NAN_LINE),
    ("checkpoint", "checkpoint saved", CHECKPOINT_LINE),
    ("ratio_skip", "average ratio", RATIO_LINE),
    ("negative_kl", "become negative", NEGATIVE_KL_LINE),
    ("out_of_memory", "OutOfMemoryError", OUT_OF_MEMORY_LINE),
]


def line_kind(line):
    """The kind of a line, null for a line that carries no metric or event.

    Most lines of a log carry neither, so a plain substring test spares them the patterns.
    """
    pick = F.lit(None).cast("string")
    for name, fragment, pattern in reversed(KINDS):
        matches = F.contains(line, F.lit(fragment)) & F.rlike(line, F.lit(pattern))
        pick = F.when(matches, name).otherwise(pick)
    return pick


def field(line, pattern, group, cast):
    return F.regexp_extract(line, pattern, group).try_cast(cast)


def before(text, mark):
    """Up to the first mark, or everything."""
    return F.substring_index(text, mark, 1)


def after(text, mark):
    """The word that follows the last mark."""
    return before(F.substring_index(text, mark, -1), " ")
