"""All-pairs model comparison.

A win table depends only on verdicts, which are keyed by ids, so texts never take part in it.
The roster is the listing of one results folder; prompts are the table that grows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from prefloom.operators.judging import decide, decided, resolve_attempts, with_swap
from prefloom.operators.ordering import fan_out

MATCH_KEYS = ["prompt_id", "name_a", "name_b"]


def comparable_models(registry, exclude=()):
    """Registry entries that can be compared: reward models and `exclude` are left out."""
    kept = registry.where(~F.startswith("model", F.lit("reward_model")))
    if exclude:
        kept = kept.where(~F.col("model").isin(*exclude))
    return kept.orderBy("model")


def require_models(roster, minimum=2):
    """The number of models; raises when there is nothing to compare."""
    count = roster.count()
    if count < minimum:
        raise ValueError(f"need at least {minimum} models to compare, found {count}")
    return count


def numbered_models(roster):
    """Models numbered by name. The roster is a folder listing, never the data."""
    position = F.row_number().over(Window.orderBy("model")) - 1
    return roster.select("model", position.alias("model_no"))


def numbered_pairs(roster, count):
    """Every unordered pair of models in name order, numbered from 0, for a roster of any size.

    Model i emits the numbers of its later partners and meets them in an equi-join.
    """
    numbered = numbered_models(roster)
    first = (
        numbered.where(F.col("model_no") < count - 1)
        .withColumnRenamed("model", "name_a")
        .withColumn("partner_no", F.explode(F.sequence(F.col("model_no") + 1, F.lit(count - 1))))
    )
    second = numbered.select(F.col("model").alias("name_b"), F.col("model_no").alias("partner_no"))
    model = F.col("model_no").cast("bigint")
    before = F.floor(model * (2 * count - model - 1) / 2)
    return first.join(second, "partner_no").select(
        (before + F.col("partner_no") - model - 1).cast("int").alias("pair_no"), "name_a", "name_b"
    )


def model_pairs(roster):
    """Every unordered pair of models in name order."""
    return numbered_pairs(roster, require_models(roster)).drop("pair_no")


def match_items(prompts, roster):
    """One item per prompt and pair: what a judge has to decide."""
    count = require_models(roster)
    return fan_out(
        prompts.select("prompt_id"), numbered_pairs(roster, count), "pair_no", count * (count - 1) // 2
    )


def expected_generations(prompts, roster):
    """One row per prompt and model: every response a comparison needs."""
    return fan_out(prompts.select("prompt_id"), numbered_models(roster), "model_no", require_models(roster, 1))


def roster_names(roster):
    """The models in name order as one array, a scalar subquery: rows look names up, nothing is joined."""
    return roster.agg(F.sort_array(F.collect_list("model"))).scalar()


def generation_gaps(prompts, roster, generations):
    """Prompts and models that still need a response.

    Every response sets its model's bit in a number per prompt (and 64 models), combined before the
    shuffle; only bits that stay unset become rows. Models outside the roster and null ones set none.
    """
    require_models(roster, 1)
    names = roster_names(roster)
    numbered = generations.withColumn("_number", F.array_position(names, F.col("model")) - 1).where("_number >= 0")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_number").bitwiseAND(F.lit(63)).cast("int"))
    made = (
        numbered.select("prompt_id", F.shiftright("_number", 6).alias("_word"), bit.alias("_bit"))
        .groupBy("prompt_id", "_word")
        .agg(F.bit_or("_bit").alias("_made"))
    )
    last = F.size(names) - 1
    words = F.sequence(F.lit(0).cast("bigint"), F.shiftright(last, 6).cast("bigint"))
    needed = prompts.select("prompt_id", F.explode(words).alias("_word"))
    places = F.sequence(F.lit(0), F.least(F.lit(63).cast("bigint"), last - 64 * F.col("_word")).cast("int"))
    unset = F.filter("_places", lambda n: F.getbit(F.coalesce("_made", F.lit(0).cast("bigint")), n) == 0)
    gaps = needed.join(made, ["prompt_id", "_word"], "left").withColumn("_places", places)
    return gaps.select("prompt_id", "_word", F.explode(unset).alias("_place")).select(
        "prompt_id", F.get(names, (64 * F.col("_word") + F.col("_place")).cast("int")).alias("model")
    )


def match_texts(prompts, generations, roster):
    """Both responses for every prompt and pair; one that was never made is null, `missing` says so.

    A prompt's responses meet in one row, as long as the roster, and every pair of the prompt looks
    its two up there: texts are shuffled once, by prompt, and never by a model's name. Prompts and
    generations stored by `write_bucketed` on prompt_id meet without any shuffle.

    Where a prompt has several responses of one model, the smallest in byte order is taken, so a
    file that was appended twice changes nothing and the order of rows does not matter. Null
    responses count as not made; null models and prompts are left out.
    """
    require_models(roster)
    names = roster_names(roster)
    whole = generations.where("prompt_id IS NOT NULL AND model IS NOT NULL AND response IS NOT NULL")
    # Equal repeats are combined before the shuffle.
    sets = whole.groupBy("prompt_id").agg(
        F.array_sort(F.collect_set(F.struct("model", "response"))).alias("_made")
    )
    first = F.filter(
        "_made", lambda made, i: F.coalesce(F.get("_made", i - 1)["model"] != made["model"], F.lit(True))
    )
    by_model = sets.select("prompt_id", F.map_from_entries(first).alias("_responses"))
    last = F.size("_names") - 1
    a, b = F.col("_responses")[F.col("name_a")], F.col("_responses")[F.col("name_b")]
    return (
        prompts.select("prompt_id")
        .join(by_model, "prompt_id", "left")
        .withColumn("_names", names)
        .select("*", F.explode(F.sequence(F.lit(0), last - 1)).alias("_first"))
        .select("*", F.explode(F.sequence(F.col("_first") + 1, last)).alias("_second"))
        .select(
            "prompt_id", "_responses", F.get("_names", "_first").alias("name_a"), F.get("_names", "_second").alias("name_b")
        )
        .select(*MATCH_KEYS, a.alias("response_a"), b.alias("response_b"), (a.isNull() | b.isNull()).alias("missing"))
    )


def judge_matches(items, attempts, seed):
    return decide(items, attempts, MATCH_KEYS, "tie_aware", seed)


def match_counts(judged, roster):
    """Wins and ties per pair; a pair nobody judged keeps a row of zeros.

    `defaulted` says how many of these verdicts are defaults. `unjudged` items have no verdict and
    are in none of the other counts.
    """
    counts = judged.groupBy("name_a", "name_b").agg(
        F.count_if(F.col("sign") > 0).alias("a_wins"),
        F.count_if(F.col("sign") < 0).alias("b_wins"),
        F.count_if(F.col("sign") == 0).alias("ties"),
        F.count_if("defaulted").alias("defaulted"),
        F.count_if(F.col("sign").isNull()).alias("unjudged"),
    )
    filled = ["a_wins", "b_wins", "ties", "defaulted", "unjudged"]
    return model_pairs(roster).join(counts, ["name_a", "name_b"], "left").na.fill(0, filled)


def match_tally(prompts, attempts, roster, seed):
    """`match_counts` without an item per prompt and pair: only verdicts are counted.

    Verdict rows carry their keys, so wins are counted from those whose prompt is asked for and whose
    models are both in the roster, in name order; what is left of prompts x pairs is unjudged.
    `prompts` has each prompt_id once.
    """
    names = roster_names(roster)
    listed = F.array_contains(names, F.col("name_a")) & F.array_contains(names, F.col("name_b"))
    known = attempts.where((F.col("name_a") < F.col("name_b")) & listed)
    asked = prompts.select("prompt_id")
    # An item with an attempt has a verdict or a default.
    tried = resolve_attempts(known, MATCH_KEYS, "tie_aware").join(asked, "prompt_id", "left_semi")
    judged = decided(with_swap(tried, MATCH_KEYS, seed))
    counts = match_counts(judged, roster)
    decisions = F.col("a_wins") + F.col("b_wins") + F.col("ties")
    return counts.withColumn("unjudged", asked.agg(F.count("*")).scalar() - decisions)


def match_totals(counts):
    """Ties, matches, defaults and unjudged items over all pairs, from the aggregated pair table."""
    return counts.agg(
        F.sum("ties").alias("ties"),
        F.sum(F.col("a_wins") + F.col("b_wins") + F.col("ties")).alias("total"),
        F.sum("defaulted").alias("defaulted"),
        F.sum("unjudged").alias("unjudged"),
    )


def leaderboard(counts, roster):
    """Wins and win rates per model, best first, equal wins by name.

    `win_rate` keeps ties in the denominator, `decided_rate` leaves them out; both are null for
    a model without matches.
    """
    def side(name, won, lost):
        return F.struct(
            F.col(name).alias("model"),
            F.col(won).alias("wins"),
            F.col(lost).alias("losses"),
            "ties",
            "defaulted",
            "unjudged",
        )

    both = F.inline(F.array(side("name_a", "a_wins", "b_wins"), side("name_b", "b_wins", "a_wins")))
    sides = counts.select(both).groupBy("model").agg(
        *[F.sum(name).alias(name) for name in ("wins", "losses", "ties", "defaulted", "unjudged")]
    )
    board = roster.select("model").join(sides, "model", "left").na.fill(0)
    decided = F.col("wins") + F.col("losses")
    played = decided + F.col("ties")
    return board.select(
        "model",
        "wins",
        played.alias("played"),
        F.try_divide("wins", played).alias("win_rate"),
        F.try_divide("wins", decided).alias("decided_rate"),
        "defaulted",
        "unjudged",
    ).orderBy(F.desc("wins"), "model")
