"""Inputs derived from the given tables, standing in for what models and judges produce.

Texts, replies, rewards and log lines are functions of row ids, so the work of every chain grows
with the tables and any engine can derive the same rows.
"""

from pyspark.sql import functions as F

from prefloom.functions import text as T
from prefloom.functions import metrics as M
from prefloom.operators.matchups import match_items
from prefloom.operators.transcripts import split_transcripts

SEED = "s"
REPLIES = ["A", "B", "TIE", " a\n", "Answer: B", "both", "I think B", "equal"]
RUNS = 4
STEPS_REQUESTED = 500


# The columns read of each table. Declared, so that no job looks into files to infer them.
TABLES = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING",
    "events": "event_id BIGINT, value DOUBLE",
    "supplier": "s_suppkey BIGINT",
}


def table(spark, folder, name):
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def transcripts(spark, folder):
    """One transcript per conversation: the turns up to its last assistant turn, or all without one.

    A transcript is one string, so its turns have to meet in one row; that row is the only thing
    a group builds. `trailing` counts the turns after the last assistant turn.
    """
    turn = F.struct("turn", "role", "text")
    assistant_turn = F.when(F.col("role") == "assistant", F.col("turn"))
    grouped = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.min(assistant_turn).alias("first_turn"),
        F.max(assistant_turn).alias("last_turn"),
    )
    speaker = F.create_map(*[F.lit(part) for pair in T.SPEAKERS.items() for part in pair])

    def line(t):
        return F.concat(F.lit("\n\n"), speaker[t["role"]], F.lit(": "), t["text"])

    kept = F.filter("turns", lambda t: t["turn"] <= F.coalesce("last_turn", t["turn"]))
    opening = F.filter("turns", lambda t: t["turn"] == F.col("first_turn"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform(kept, line), "").alias("transcript"),
        F.get(opening, F.lit(0))["text"].alias("first_response"),
        F.coalesce(F.col("first_turn") < F.col("last_turn"), F.lit(False)).alias("several"),
        (F.size("turns") - F.size(kept)).alias("trailing"),
    )


def candidates(spark, folder):
    """Two responses per prompt: the last assistant turn, and the first one or half the last.

    Some second responses are empty, equal to the first or hold a turn marker, as broken ones do.
    """
    a, conv = F.col("response"), F.col("conv_id")
    half = F.left(a, F.floor(F.length(a) / 2).cast("int"))
    other = F.when(F.col("several"), F.col("first_response")).otherwise(half)
    other = (
        F.when(conv % 17 == 3, "")
        .when(conv % 19 == 5, a)
        .when(conv % 23 == 7, F.concat(other, F.lit(T.ASSISTANT_MARKER), F.lit(" again")))
        .otherwise(other)
    )
    return split_transcripts(transcripts(spark, folder)).select(
        F.col("conv_id").alias("cand_id"),
        "prompt",
        F.col("response").alias("response_a"),
        T.strip(other).alias("response_b"),
    )


def human_pairs(spark, folder):
    prompt = F.col("prompt")
    return candidates(spark, folder).select(
        F.col("cand_id").alias("pair_id"),
        T.transcript_of(prompt, F.col("response_a")).alias("chosen"),
        T.transcript_of(prompt, F.col("response_b")).alias("rejected"),
        F.lit("human").alias("labeler"),
    )


def prompt_ids(spark, folder):
    """Ids of the conversations that yield a prompt; texts are never read."""
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "assistant")
        .select(F.col("conv_id").alias("prompt_id"))
        .distinct()
    )


def _with_replies(items, tag, keys):
    tried = items.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    key = F.concat_ws("|", F.lit(tag), *[F.col(name).cast("string") for name in [*keys, "attempt"]])
    pick = F.pmod(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int"), F.lit(16))
    replies = F.array(*[F.lit(reply) for reply in REPLIES])
    return tried.withColumn("raw", F.get(replies, pick))


def label_attempts(spark, folder):
    """Replies to every eleventh candidate were never asked for."""
    ids = prompt_ids(spark, folder).withColumnRenamed("prompt_id", "cand_id").where("cand_id % 11 <> 5")
    return _with_replies(ids, "v", ["cand_id"])


def roster(spark):
    """The compared checkpoints, as a folder listing would give them."""
    return spark.sql("SELECT model FROM VALUES ('dpo'), ('ppo'), ('sft'), ('zero') AS models(model)")


def checkpoints(spark, folder):
    """Checkpoint folders by name, how often something was saved to each, and whether it is whole."""
    number = F.floor(F.col("s_suppkey") / 5)
    prefix = F.when(number % 5 == 0, "reward_model_").otherwise("")
    return table(spark, folder, "supplier").select(
        F.concat(prefix, F.lit("run_"), number.cast("string")).alias("model"), (number % 2 == 0).alias("whole")
    )


def generations(spark, folder):
    """Each model's response per prompt."""
    a, b = F.col("response_a"), F.col("response_b")
    texts = {"sft": a, "dpo": b, "ppo": T.strip(F.left(a, F.lit(80))), "zero": F.left(a, F.lit(1))}
    rows = [
        F.struct(F.lit(name).alias("model"), text.alias("response")) for name, text in texts.items()
    ]
    return candidates(spark, folder).select(
        F.col("cand_id").alias("prompt_id"), F.inline(F.array(*rows))
    )


def repeated_generations(spark, folder):
    """Responses as files hold them that were appended to twice: some stand there again, some of those
    with another text, some without a model or a text."""
    made, prompt, model, text = generations(spark, folder), F.col("prompt_id"), F.col("model"), F.col("response")
    again = F.array(
        F.struct(model.alias("model"), text.alias("response")),
        F.when(prompt % 3 == 0, F.struct(model.alias("model"), text.alias("response"))),
        F.when(prompt % 5 == 1, F.struct(model.alias("model"), F.concat(F.lit("!"), text).alias("response"))),
        F.when(prompt % 7 == 2, F.struct(F.lit(None).cast("string").alias("model"), text.alias("response"))),
    )
    rows = made.select("prompt_id", F.inline(F.filter(again, lambda row: row.isNotNull())))
    lost = (prompt % 11 == 4) & (model == "ppo")
    return rows.select("prompt_id", "model", F.when(~lost | model.isNull(), text).alias("response"))


def match_attempts(spark, folder):
    """Replies for the pairs that were judged: none with `zero`, and some prompts are missing."""
    items = match_items(prompt_ids(spark, folder), roster(spark))
    items = items.where("name_b <> 'zero' AND NOT (prompt_id % 13 = 4 AND name_a = 'dpo')")
    return _with_replies(items, "e", ["prompt_id", "name_a", "name_b"])


def rollouts(spark, folder):
    event, index = F.col("event_id"), F.floor(F.col("event_id") / RUNS)
    reward = (
        F.when(event % 97 == 0, M.NAN)
        .when(event % 101 == 0, M.POS_INF)
        .when(event % 103 == 0, M.NEG_INF)
        .otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select(
        (event % RUNS).alias("run_id"),
        F.floor(index / M.BATCH_SIZE).alias("step"),
        (index % M.BATCH_SIZE).alias("slot"),
        reward.alias("reward"),
    )


def step_metrics(spark, folder):
    event, value = F.col("event_id"), F.col("value")
    return table(spark, folder, "events").select(
        (event % RUNS).alias("run_id"),
        F.floor(event / RUNS).alias("step"),
        (value / 50).alias("mean_reward"),
        F.when(event % 37 == 0, M.NAN).otherwise(value / 10).alias("kl"),
        # Whole thousandths: engines disagree on how to print a half in the fourth place.
        F.when(event % 41 == 0, M.NAN).otherwise(F.floor(value) / 1000).alias("val_var_explained"),
        F.when(event % 43 == 0, M.NAN).otherwise(value / 100).alias("policy_loss"),
    )


def log_lines(spark, folder):
    """The lines a run would print for each step."""
    return _printed(table(spark, folder, "events").withColumn("base", F.col("event_id") * 8))


# A resumed run goes back so many steps every so many steps.
RESUMED, GOES_BACK = 100, 10


def resumed_log(spark, folder):
    """The lines of runs that die after every hundredth step and are resumed ten steps before it: those
    steps are printed twice, with other numbers the first time."""
    events, event = table(spark, folder, "events"), F.col("event_id")
    century = F.floor(event / (RUNS * RESUMED))
    repeated = F.floor(event / RUNS) % RESUMED >= RESUMED - GOES_BACK
    times = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    passes = events.select("event_id", "value", F.explode(times).alias("time"), repeated.alias("repeated"))
    place = (2 * century + F.col("time")) * (RUNS * RESUMED) + event % (RUNS * RESUMED)
    value = F.when(F.col("repeated") & (F.col("time") == 0), F.col("value") + 1).otherwise(F.col("value"))
    return _printed(passes.select("event_id", value.alias("value"), (8 * place).alias("base")))


def _printed(events):
    event, value = F.col("event_id"), F.col("value")
    step = F.floor(event / RUNS)

    def fixed(number, digits):
        return number.cast(f"decimal(20, {digits})").cast("string")

    ratio = F.concat(
        F.lit("UserWarning: The average ratio of batch ("),
        fixed(value, 2),
        F.lit(") exceeds threshold 10.00. Skipping batch."),
    )
    negative = F.concat(
        F.lit("UserWarning: KL divergence is starting to become negative: -"),
        F.when(event % 120 == 0, "inf").otherwise(fixed(value, 2)),
        F.lit(" - this might be a precursor for failed training."),
    )
    head = F.concat(F.lit("step "), step.cast("string"), F.lit(f"/{STEPS_REQUESTED}  "))
    metrics = F.concat(
        F.lit("mean_reward="),
        fixed(value / 50, 3),
        F.lit("  kl="),
        fixed(value / 10, 4),
        F.lit("  val_var_explained="),
        fixed(F.floor(value) / 1000, 3),
        F.lit("  policy_loss="),
        fixed(value / 100, 4),
    )
    failed = F.concat(
        F.lit("NaN detected (kl=nan policy_loss="),
        fixed(value / 100, 4),
        F.lit(") -- rolling back to last known-good weights and continuing"),
    )
    saved = F.concat(
        F.lit("  [checkpoint saved at step "), step.cast("string"), F.lit(" -> results/ppo_checkpoint]")
    )
    memory = F.concat(
        F.lit("torch.OutOfMemoryError: CUDA out of memory. Tried to allocate "), fixed(value, 2), F.lit(" GiB.")
    )
    lines = F.array(
        F.when(event % 50 == 0, ratio),
        F.when(event % 60 == 0, negative),
        F.concat(head, F.when(event % 37 == 0, failed).otherwise(metrics)),
        F.when(M.is_checkpoint_step(step), saved),
        F.when(event % 500 == 2, memory),
    )
    return (
        events.select("event_id", "base", F.posexplode(lines).alias("k", "value"))
        .where(F.col("value").isNotNull())
        .select((F.col("event_id") % RUNS).alias("run_id"), (F.col("base") + F.col("k")).alias("line_no"), "value")
    )
