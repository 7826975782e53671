"""Transcripts into prompts, responses and training rows. All narrow: no shuffle anywhere."""

from pyspark.sql import functions as F

from prefloom.functions import text as T


def split_transcripts(df, transcript="transcript"):
    """Add prompt, response and whether the transcript had a marker at all."""
    source = F.col(transcript)
    return df.withColumns(
        {
            "prompt": T.prompt_of(source),
            "response": T.response_of(source),
            "has_marker": T.has_marker(source),
        }
    )


def prompts_only(df, transcript="transcript", key="pair_id"):
    return df.select(key, T.prompt_of(F.col(transcript)).alias("prompt"))


def sft_rows(pairs):
    """Supervised text from the chosen side only."""
    chosen = F.col("chosen")
    return pairs.select(
        "pair_id", T.transcript_of(T.prompt_of(chosen), T.response_of(chosen)).alias("text")
    )


def dpo_triples(pairs):
    """The chosen side's prompt and both responses; every other column is dropped."""
    chosen, rejected = F.col("chosen"), F.col("rejected")
    return pairs.select(
        "pair_id",
        T.prompt_of(chosen).alias("prompt"),
        T.response_of(chosen).alias("chosen"),
        T.response_of(rejected).alias("rejected"),
    )


def reward_model_rows(pairs, budget=1024):
    """Both sides as word tokens cut to the budget, with full lengths and cut flags.

    Words stand in for a model's own subword vocabulary, which is not part of this engine.
    """
    columns = [F.col("pair_id")]
    staged = pairs.select(
        "pair_id",
        T.tokens(F.col("chosen")).alias("_chosen"),
        T.tokens(F.col("rejected")).alias("_rejected"),
    )
    for side in ("chosen", "rejected"):
        words = F.col(f"_{side}")
        columns += [
            T.keep_tokens(words, budget).alias(f"tokens_{side}"),
            F.size(words).alias(f"n_tokens_{side}"),
            (F.size(words) > budget).alias(f"truncated_{side}"),
        ]
    return staged.select(*columns)


def token_budget(df, key, column, budget, side="head"):
    """Token count, cut flag and the text that fits the budget, tokens joined by one space."""
    words = F.col("_words")
    return df.select(key, T.tokens(F.col(column)).alias("_words")).select(
        key,
        F.size(words).alias("n_tokens"),
        (F.size(words) > budget).alias("truncated"),
        F.array_join(T.keep_tokens(words, budget, side), " ").alias("kept"),
    )


def reward_inputs(df):
    return df.withColumn("reward_input", T.reward_input_of(F.col("prompt"), F.col("response")))


def strip_columns(df, *columns):
    """Strip generated text."""
    return df.withColumns({name: T.strip(F.col(name)) for name in columns})
