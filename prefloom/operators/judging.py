"""From candidates and raw judge replies to labelled pairs."""

from pyspark.sql import functions as F

from prefloom.functions import text as T
from prefloom.functions import verdicts as V

MAX_ATTEMPTS = 3
# The code of an answer that cannot be read; signs -1, 0 and 1 have the codes below it.
_UNREADABLE = 3

# The two rubrics a judge is asked with. {prompt}, {response_a} and {response_b}
# mark where the texts go.
TIE_RUBRIC = """You are judging two AI assistant responses to the same prompt.
Pick the one that is more helpful, honest, and harmless. Ties are allowed only
if truly indistinguishable.

Prompt:
{prompt}

Response A:
{response_a}

Response B:
{response_b}

Reply with exactly one token: "A", "B", or "TIE".
"""
FORCED_RUBRIC = """You are labeling which of two AI assistant responses is more helpful,
honest, and harmless, for training data purposes. Pick the better one.

Prompt:
{prompt}

Response A:
{response_a}

Response B:
{response_b}

Reply with exactly one token: "A" or "B". No ties -- if genuinely equal, pick
either, but do not reply anything else.
"""


def with_swap(items, keys, seed):
    """Add `swapped`: whether side B is shown first."""
    return items.withColumn("swapped", V.is_swapped(seed, *[F.col(key) for key in keys]))


def judge_requests(items, keys, rubric, seed):
    """The request text for each item, sides in the order they are shown. Nothing is called.

    The rubric is cut at its three slots and concatenated, never formatted, so texts may hold
    braces and percent signs.
    """
    before, rest = rubric.split("{prompt}")
    middle, rest = rest.split("{response_a}")
    between, after = rest.split("{response_b}")
    swapped, a, b = F.col("swapped"), F.col("response_a"), F.col("response_b")
    request = F.concat(
        F.lit(before),
        F.col("prompt"),
        F.lit(middle),
        F.when(swapped, b).otherwise(a),
        F.lit(between),
        F.when(swapped, a).otherwise(b),
        F.lit(after),
    )
    return with_swap(items, keys, seed).select(*keys, "swapped", request.alias("request"))


def resolve_attempts(attempts, keys, reading, max_attempts=MAX_ATTEMPTS):
    """The first attempt with a text decides: one row (keys, sign, answered) per attempted item.

    An empty text is an answer. `sign` is null for an item without an answer and for an answer that
    the reading cannot read; `answered` tells them apart. Should an attempt number repeat, the
    reply of the smaller code decides. Replies are read before the shuffle and packed with their
    attempt into one number, so each map task sends at most one fixed-width row per item however
    many attempts or copies an item has.
    """
    tried = attempts.where((F.col("attempt") >= 0) & (F.col("attempt") < max_attempts))
    code = F.coalesce(V.READINGS[reading](F.col("raw")) + 1, F.lit(_UNREADABLE))
    packed = F.when(F.col("raw").isNotNull(), F.col("attempt") * (_UNREADABLE + 1) + code)
    first = tried.select(*keys, packed.alias("_first")).groupBy(*keys).agg(F.min("_first").alias("_first"))
    code = F.col("_first") % (_UNREADABLE + 1)
    return first.select(
        *keys,
        F.when(code < _UNREADABLE, code - 1).cast("int").alias("sign"),
        F.col("_first").isNotNull().alias("answered"),
    )


def decide(items, attempts, keys, reading, seed):
    """Add the position-free verdict of each item: `swapped`, `defaulted` and `sign`.

    An item whose attempts all lack a text gets side A as shown, which after the un-swap is a coin
    flip; `defaulted` marks those. An item that was never attempted, or whose answer cannot be
    read, has a null sign: it is unjudged.
    """
    resolved = resolve_attempts(attempts, keys, reading)
    return decided(with_swap(items, keys, seed).join(resolved, keys, "left"))


def decided(resolved):
    """Resolved attempts with `swapped` as the position-free verdict."""
    defaulted = F.coalesce(~F.col("answered"), F.lit(False))
    shown = F.when(defaulted, F.lit(V.A)).otherwise(F.col("sign"))
    return resolved.withColumns(
        {"defaulted": defaulted, "sign": V.unswap(shown, F.col("swapped"))}
    ).drop("answered")


def label_pairs(candidates, attempts, seed):
    """Judged candidates as preference pairs; unjudged ones have no label and are left out."""
    judged = decide(candidates, attempts, ["cand_id"], "forced", seed).where(F.col("sign").isNotNull())
    a, b, a_wins = F.col("response_a"), F.col("response_b"), F.col("sign") > 0
    return judged.select(
        "cand_id",
        "swapped",
        "defaulted",
        V.letter(F.col("sign")).alias("verdict"),
        "prompt",
        F.when(a_wins, a).otherwise(b).alias("chosen_response"),
        F.when(a_wins, b).otherwise(a).alias("rejected_response"),
    )


def pair_transcripts(labelled, labeler):
    """Labelled pairs in the transcript form every pair reader expects."""
    prompt = F.col("prompt")
    return labelled.select(
        F.col("cand_id").alias("pair_id"),
        T.transcript_of(prompt, F.col("chosen_response")).alias("chosen"),
        T.transcript_of(prompt, F.col("rejected_response")).alias("rejected"),
        F.lit(labeler).alias("labeler"),
    )


def compare_readings(attempts):
    """How the loose readings of each reply differ from taking only an exact token."""
    raw = F.col("raw")
    read = attempts.where(raw.isNotNull()).select(
        *[F.coalesce(V.letter(V.READINGS[name](raw)), F.lit("none")).alias(name) for name in V.READINGS]
    )
    return read.groupBy(*V.READINGS).agg(F.count("*").alias("replies"))
