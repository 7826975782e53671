"""Checks on preference pairs. Each is one aggregate with map-side combine."""

from pyspark.sql import functions as F

from prefloom.functions import text as T
from prefloom.operators.sums import exact_sums


def pair_sides(pairs):
    """Transcript pairs with prompts and responses split off."""
    chosen, rejected = F.col("chosen"), F.col("rejected")
    return pairs.select(
        *[name for name in pairs.columns if name not in ("chosen", "rejected")],
        T.prompt_of(chosen).alias("prompt"),
        T.prompt_of(rejected).alias("rejected_prompt"),
        T.response_of(chosen).alias("chosen_response"),
        T.response_of(rejected).alias("rejected_response"),
        (T.has_marker(chosen) & T.has_marker(rejected)).alias("has_marker"),
    )


def _is_usable():
    chosen, rejected = T.strip(F.col("chosen_response")), T.strip(F.col("rejected_response"))
    return (chosen != "") & (rejected != "") & (chosen != rejected)


def usable_pairs(labelled):
    """Pairs whose responses are both non-empty and differ."""
    return labelled.where(_is_usable())


def _length_audit():
    chosen, rejected = F.col("chosen_response"), F.col("rejected_response")
    longer = (F.length(chosen) > F.length(rejected)).cast("int")
    return [
        F.count("*").alias("n_pairs"),
        F.count_if(chosen == "").alias("empty_chosen"),
        F.count_if(rejected == "").alias("empty_rejected"),
        F.count_if(chosen == rejected).alias("identical"),
        F.avg(F.length(chosen)).alias("avg_chosen_chars"),
        F.avg(F.length(rejected)).alias("avg_rejected_chars"),
        F.avg(longer).alias("chosen_longer_share"),
    ]


def label_audit(labelled):
    """Length bias and broken rows of freshly labelled pairs, and how many labels are defaults."""
    responses = [F.col("chosen_response"), F.col("rejected_response")]
    marked = responses[0].contains(T.ASSISTANT_MARKER) | responses[1].contains(T.ASSISTANT_MARKER)
    return labelled.agg(
        *_length_audit(),
        F.count_if(marked).alias("marker_in_response"),
        F.count_if("defaulted").alias("defaulted"),
        F.avg(F.col("defaulted").cast("int")).alias("defaulted_share"),
    )


def pair_audit(pairs, by=("labeler",)):
    """The length audit of transcript pairs per labeler, and rows that do not split cleanly."""
    return pair_sides(pairs).groupBy(*by).agg(
        *_length_audit(),
        F.count_if(~F.col("has_marker")).alias("no_marker"),
        F.count_if(F.col("prompt") != F.col("rejected_prompt")).alias("prompt_differs"),
    )


def all_pairs(*pair_tables):
    """Pairs of several labelers under one schema."""
    first, *rest = pair_tables
    for table in rest:
        first = first.unionByName(table)
    return first


def score_profile(scored, by=()):
    """Mean, spread and pairwise accuracy of reward scores; an equal score is a miss.

    Pairs without both scores are left out. The spread is taken around the mean, in a second pass;
    sums are of integers, so the result does not depend on partitions. Without `by` an empty table
    gives one row of no pairs.
    """
    by = list(by)
    chosen, rejected = F.col("score_chosen"), F.col("score_rejected")
    pairs = scored.where(chosen.isNotNull() & rejected.isNotNull()).select(*by, chosen, rejected)
    centre = exact_sums(pairs, by, {"c": chosen, "r": rejected}).select(
        *by, F.try_divide(F.col("c") + F.col("r"), F.col("c_n") * 2).alias("_mean")
    )
    if by:
        same = [F.col(f"p.{name}").eqNullSafe(F.col(f"m.{name}")) for name in by]
        placed = pairs.alias("p").join(centre.alias("m"), same).select("p.*", "_mean")
    else:
        placed = pairs.withColumn("_mean", centre.scalar())
    off_chosen, off_rejected = chosen - F.col("_mean"), rejected - F.col("_mean")
    summed = exact_sums(
        placed,
        by,
        {
            "mean": F.col("_mean"),
            "q": off_chosen * off_chosen + off_rejected * off_rejected,
            "hit": (chosen > rejected).cast("double"),
            "equal": (chosen == rejected).cast("double"),
        },
    )
    n = F.col("mean_n")
    return summed.select(
        *by,
        n.alias("n_pairs"),
        F.col("mean_low").alias("mean_score"),
        F.sqrt(F.try_divide("q", n * 2)).alias("std_score"),
        F.try_divide("hit", n).alias("accuracy"),
        F.coalesce(F.col("equal").cast("bigint"), F.lit(0)).cast("bigint").alias("equal_scores"),
    )
