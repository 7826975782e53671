"""Named queries over the given tables, one or more per operator."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from prefloom.operators import audit, judging, matchups, ordering, rollouts, runlog, transcripts
from prefloom.plans import chains, inputs
from prefloom.session import scratch_folder
from prefloom.sources import files, sinks

SEED = inputs.SEED
EVAL_PROMPTS = 50
SEQUENCE_BUDGET = 1024
PROMPT_BUDGET = 512


def stored(spark, table):
    """A models-sized table that several outputs are built from, written once."""
    path = scratch_folder(spark)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _rounded(df, *columns, digits=6):
    return df.withColumns({name: F.round(F.col(name), digits) for name in columns})


# --- transcripts -----------------------------------------------------------------------------


def split_transcripts(spark, folder):
    split = transcripts.split_transcripts(inputs.transcripts(spark, folder))
    return split.select("conv_id", "prompt", "response", "has_marker")


def prompts(spark, folder):
    return transcripts.prompts_only(inputs.transcripts(spark, folder), key="conv_id")


def sft_rows(spark, folder):
    return transcripts.sft_rows(inputs.human_pairs(spark, folder))


def dpo_triples(spark, folder):
    return transcripts.dpo_triples(inputs.human_pairs(spark, folder))


def reward_model_rows(spark, folder):
    rows = transcripts.reward_model_rows(inputs.human_pairs(spark, folder), SEQUENCE_BUDGET)
    return rows.withColumns(
        {name: F.array_join(name, " ") for name in ("tokens_chosen", "tokens_rejected")}
    )


def token_budget(spark, folder):
    pairs = inputs.human_pairs(spark, folder)
    return transcripts.token_budget(pairs, "pair_id", "chosen", SEQUENCE_BUDGET)


def prompt_budget(spark, folder):
    """Prompts cut from the front, so that the marker at their end survives."""
    split = transcripts.prompts_only(inputs.transcripts(spark, folder), key="conv_id")
    return transcripts.token_budget(split, "conv_id", "prompt", PROMPT_BUDGET, "tail")


def document_budget(spark, folder):
    """The sequence budget on the longest texts at hand."""
    return transcripts.token_budget(
        inputs.table(spark, folder, "documents"), "doc_id", "text", SEQUENCE_BUDGET
    ).select("doc_id", "n_tokens", "truncated", F.md5("kept").alias("kept_md5"))


def _asked(spark, folder):
    return inputs.candidates(spark, folder).withColumnRenamed("cand_id", "prompt_id")


def reward_inputs(spark, folder):
    generations = inputs.generations(spark, folder)
    asked = _asked(spark, folder).select("prompt_id", "prompt")
    return transcripts.reward_inputs(generations.join(asked, "prompt_id")).select(
        "prompt_id", "model", "reward_input"
    )


# --- labelling -------------------------------------------------------------------------------


def _labelled(spark, folder):
    return judging.label_pairs(
        inputs.candidates(spark, folder), inputs.label_attempts(spark, folder), SEED
    )


def _ai_pairs(spark, folder):
    return judging.pair_transcripts(_labelled(spark, folder), "ai")


def judge_requests(spark, folder):
    return judging.judge_requests(
        inputs.candidates(spark, folder), ["cand_id"], judging.FORCED_RUBRIC, SEED
    )


def label_pairs(spark, folder):
    return _labelled(spark, folder)


def labelled_in_steps(spark, folder):
    """Labels of a store to which replies are added twice: late first attempts, and those of a few candidates."""
    store = scratch_folder(spark)
    chains.store_candidates(inputs.candidates(spark, folder), store, buckets=16)
    late = "cand_id % 40 = 7 OR cand_id % 10 = 2 AND attempt = 0"
    attempts = inputs.label_attempts(spark, folder)
    chains.add_verdicts(attempts.where(f"NOT ({late})"), store, SEED)
    return chains.add_verdicts(attempts.where(late), store, SEED)


def labelled_transcripts(spark, folder):
    return _ai_pairs(spark, folder)


def usable_pairs(spark, folder):
    return audit.usable_pairs(_labelled(spark, folder)).select(
        "cand_id", "chosen_response", "rejected_response"
    )


def verdict_readings(spark, folder):
    return judging.compare_readings(inputs.label_attempts(spark, folder))


AUDIT_MEANS = ["avg_chosen_chars", "avg_rejected_chars", "chosen_longer_share"]


def transcript_audit(spark, folder):
    """What becomes of every turn: conversations without an answer, and turns after the last one."""
    return inputs.transcripts(spark, folder).agg(
        F.count("*").alias("conversations"),
        F.count_if(F.col("first_response").isNull()).alias("unanswered"),
        F.sum("trailing").alias("trailing_turns"),
    )


def pair_audit(spark, folder):
    return _rounded(audit.label_audit(_labelled(spark, folder)), *AUDIT_MEANS, "defaulted_share")


def pair_audit_by_labeler(spark, folder):
    pairs = audit.all_pairs(inputs.human_pairs(spark, folder), _ai_pairs(spark, folder))
    return _rounded(audit.pair_audit(pairs), *AUDIT_MEANS)


def reward_profile(spark, folder):
    sides = audit.pair_sides(_ai_pairs(spark, folder))
    scored = sides.select(
        F.length("chosen_response").alias("score_chosen"),
        F.length("rejected_response").alias("score_rejected"),
    )
    return _rounded(audit.score_profile(scored), "mean_score", "std_score", "accuracy")


def candidate_file(spark, folder):
    """Candidates written as JSON lines and read back with ids from file order."""
    path = scratch_folder(spark)
    sinks.write_candidates(inputs.candidates(spark, folder), path, order="cand_id")
    return files.read_candidates(spark, path, stored_ids=False)


def labelled_file(spark, folder):
    """Labelled pairs written as JSON lines and read back, with their ids, as a preference source."""
    path = scratch_folder(spark)
    sinks.write_labelled_pairs(_ai_pairs(spark, folder), path)
    return files.read_preference_pairs(spark, data_file=path)


def human_pair_file(spark, folder):
    """The train split of human pairs, beside another split of a longer name."""
    root = scratch_folder(spark)
    pairs = inputs.human_pairs(spark, folder).withColumn("line", F.to_json(F.struct("chosen", "rejected")))
    for split, rest in (("train", 0), ("train_old", 1)):
        part = pairs.where(F.pmod("pair_id", F.lit(2)) == rest).orderBy("pair_id")
        part.select("line").write.text(f"{root}/{files.HUMAN_SUBSET}/{split}.jsonl", lineSep="\n\n")
    return files.read_preference_pairs(spark, root=root, split="train")


def verdict_file(spark, folder):
    """Recorded replies of both kinds, written as JSON lines and as parquet and read back."""
    path = scratch_folder(spark)
    inputs.label_attempts(spark, folder).write.json(f"{path}/labels")
    inputs.match_attempts(spark, folder).write.parquet(f"{path}/matches")
    labels = files.read_verdicts(spark, f"{path}/labels", form="json")
    matches = files.read_verdicts(spark, f"{path}/matches", "match")
    none = F.lit(None).cast("string")
    return labels.select(
        F.col("cand_id").alias("item_id"), none.alias("name_a"), none.alias("name_b"), "attempt", "raw"
    ).unionAll(matches.select("prompt_id", "name_a", "name_b", "attempt", "raw"))


def generation_file(spark, folder):
    """Responses with white space around them, written as JSON lines and read back stripped."""
    path = scratch_folder(spark)
    padded = F.concat(F.lit(" \n"), "response", F.lit("\u00a0\t"))
    inputs.generations(spark, folder).withColumn("response", padded).write.json(path)
    return files.read_generations(spark, path, form="json")


def registry(spark, folder):
    """Models of a results folder, which a partitioned writer made: some have no config, some are
    reward models, which are left out. The order is by name."""
    path = scratch_folder(spark)
    made = inputs.checkpoints(spark, folder)
    for whole, kind in ((True, "json"), (False, "csv")):
        made.where(F.col("whole") == whole).select("model", "whole").write.partitionBy("model").mode("append").format(kind).save(path)
    models = matchups.comparable_models(files.read_registry(spark, path, "*.json"))
    return models.select("model", F.row_number().over(Window.orderBy("model")).alias("rank"))


LINES_PER_PART = 500


def log_file(spark, folder):
    """Each run's log rotated into numbered parts, read back as one sequence of lines."""
    path = scratch_folder(spark)
    lines = inputs.log_lines(spark, folder)
    ordered = lines.repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no")
    ordered.select("run_id", "value").write.partitionBy("run_id").option("maxRecordsPerFile", LINES_PER_PART).text(path)
    read = files.read_log(spark, f"{path}/run_id=*", parts="folder")
    # Runs are known by the first lines that only they print.
    return runlog.parse_log(read).groupBy("kind").agg(
        F.count("*").alias("lines"), F.count_distinct("run_id").alias("runs"), F.sum("line_no").alias("line_numbers")
    )


# --- evaluation ------------------------------------------------------------------------------


def match_items(spark, folder):
    return matchups.match_items(inputs.prompt_ids(spark, folder), inputs.roster(spark))


def match_requests(spark, folder):
    asked = _asked(spark, folder).select("prompt_id", "prompt")
    # A response of no text was never made.
    made = inputs.generations(spark, folder).where("response <> ''")
    texts = matchups.match_texts(asked, made, inputs.roster(spark))
    return judging.judge_requests(
        texts.where("NOT missing").join(asked, "prompt_id"), matchups.MATCH_KEYS, judging.TIE_RUBRIC, SEED
    )


BUCKETS = 16


def bucketed_matches(spark, folder):
    """Both responses of every pair, from bucketed tables with repeated responses and null models."""
    base = scratch_folder(spark)
    name = f"prefloom_{base.rsplit('/', 1)[-1]}"
    asked = sinks.write_bucketed(inputs.prompt_ids(spark, folder), f"{name}_asked", "prompt_id", BUCKETS, f"{base}/asked")
    made = sinks.write_bucketed(
        inputs.repeated_generations(spark, folder), f"{name}_made", "prompt_id", BUCKETS, f"{base}/made"
    )
    return matchups.match_texts(asked, made, inputs.roster(spark))


def generation_gaps(spark, folder):
    # A response too short to fill the shortest model's cut counts as not made.
    made = inputs.generations(spark, folder).where(F.length("response") >= 80)
    return matchups.generation_gaps(inputs.prompt_ids(spark, folder), inputs.roster(spark), made)


def _counts(spark, folder):
    return matchups.match_tally(
        inputs.prompt_ids(spark, folder), inputs.match_attempts(spark, folder), inputs.roster(spark), SEED
    )


def match_verdicts(spark, folder):
    items = match_items(spark, folder)
    judged = matchups.judge_matches(items, inputs.match_attempts(spark, folder), SEED)
    return judged.select(*matchups.MATCH_KEYS, "swapped", "defaulted", "sign")


def match_counts(spark, folder):
    return _counts(spark, folder)


def match_totals(spark, folder):
    return matchups.match_totals(_counts(spark, folder))


def leaderboard(spark, folder):
    board = matchups.leaderboard(_counts(spark, folder), inputs.roster(spark))
    return _rounded(board, "win_rate", "decided_rate")


def _stored_evaluation(spark, folder, generations):
    asked = _asked(spark, folder).join(inputs.prompt_ids(spark, folder), "prompt_id", "left_semi")
    return sinks.write_eval_raw(
        asked.select("prompt_id", "prompt"),
        generations,
        _counts(spark, folder),
        inputs.roster(spark),
        scratch_folder(spark),
    )


def eval_document(spark, folder):
    """The evaluation's one JSON document, written in parts and read back line by line in file order."""
    made = inputs.repeated_generations(spark, folder).where("model IS NOT NULL")
    path = scratch_folder(spark)
    sinks.write_eval_document_parts(_stored_evaluation(spark, folder, made), path)
    return files.with_file_order(spark.read.text(path), "line_no").select("line_no", "value")


def eval_raw(spark, folder):
    """The stored evaluation read back: a row per prompt, response, match-up and model."""
    stored = _stored_evaluation(spark, folder, inputs.generations(spark, folder))

    def rows(part, key, *values):
        value = F.concat_ws("|", *[F.col(name).cast("string") for name in values])
        return stored[part].select(F.lit(part).alias("part"), key.cast("string").alias("key"), value.alias("value"))

    return (
        rows("prompts", F.col("prompt_id"), "prompt")
        .unionAll(rows("generations", F.concat_ws("|", "model", F.col("prompt_id").cast("string")), "response"))
        .unionAll(rows("matchups", F.concat("name_a", F.lit("_vs_"), "name_b"), "a_wins", "b_wins", "ties"))
        .unionAll(rows("wins", F.col("model"), "wins"))
    )


def eval_report(spark, folder):
    counts = stored(spark, _counts(spark, folder))
    return sinks.report_lines(
        counts,
        matchups.leaderboard(counts, inputs.roster(spark)),
        matchups.match_totals(counts),
        "recorded",
        inputs.prompt_ids(spark, folder).count(),
    ).select("section", "value")


# --- rollouts --------------------------------------------------------------------------------


def positions(spark, folder):
    return ordering.with_position(inputs.prompt_ids(spark, folder), "prompt_id")


def first_prompts(spark, folder):
    return ordering.first_n(
        transcripts.prompts_only(inputs.transcripts(spark, folder), key="conv_id"), EVAL_PROMPTS, "conv_id"
    )


def batch_cursor(spark, folder):
    """The prompt of every slot, for as many steps as the longest run logged."""
    last = inputs.rollouts(spark, folder).agg(F.max("step")).first()[0]
    slots = rollouts.batch_slots(spark, 0, last + 1)
    return rollouts.batch_cursor(slots, inputs.prompt_ids(spark, folder))


def rollout_rows(spark, folder):
    """Prompt, response, cleaned reward and reward input of every slot."""
    rewards = rollouts.clean_rewards(inputs.rollouts(spark, folder))
    zipped = rollouts.batch_cursor(rewards, inputs.prompt_ids(spark, folder)).drop("position")
    answer = F.when(F.col("step") % 2 == 0, F.col("response_a")).otherwise(F.col("response_b"))
    texts = zipped.join(_asked(spark, folder), "prompt_id").withColumn("response", answer)
    return transcripts.reward_inputs(texts).select(
        *rollouts.SLOT_KEYS, "prompt_id", "reward", F.md5("reward_input").alias("input_md5")
    )


def reward_clean(spark, folder):
    return rollouts.clean_rewards(inputs.rollouts(spark, folder))


def reward_by_step(spark, folder):
    return _rounded(rollouts.reward_by_step(inputs.rollouts(spark, folder)), "mean_reward")


def reward_scaled(spark, folder):
    scaled = rollouts.scale_rewards(inputs.rollouts(spark, folder))
    return _rounded(scaled, "running_mean", "running_std", "scaled")


# --- run logs --------------------------------------------------------------------------------


def nan_steps(spark, folder):
    return runlog.nan_steps(inputs.step_metrics(spark, folder)).select("run_id", "step")


def saved_steps(spark, folder):
    return runlog.saved_steps(inputs.step_metrics(spark, folder))


def rollback_targets(spark, folder):
    return runlog.rollback_targets(inputs.step_metrics(spark, folder))


def unstable_steps(spark, folder):
    return runlog.unstable_steps(inputs.step_metrics(spark, folder)).select("run_id", "step", "kl")


def unstable_batches(spark, folder):
    parsed = runlog.parse_log(inputs.log_lines(spark, folder))
    return runlog.unstable_batches(parsed).select("run_id", "line_no", "ratio")


def run_trend(spark, folder):
    trend = runlog.run_trend(inputs.step_metrics(spark, folder))
    return _rounded(_rounded(trend, "kl_spread"), "reward_slope", digits=9)


def log_metrics(spark, folder):
    return runlog.parse_log(inputs.log_lines(spark, folder))


def run_summary(spark, folder):
    return runlog.run_summary(runlog.parse_log(inputs.log_lines(spark, folder)))


def resumed_lines(spark, folder):
    """Which lines of resumed runs count."""
    marked = runlog.mark_superseded(runlog.parse_log(inputs.resumed_log(spark, folder)))
    return marked.select("run_id", "line_no", "kind", "step", "superseded", "restart")


def resumed_health(spark, folder):
    """Summary and trend of resumed runs, every step counted once."""
    health = runlog.resumed_health(runlog.parse_log(inputs.resumed_log(spark, folder)))
    return _rounded(_rounded(health, "kl_spread"), "reward_slope", digits=9)


def resumed_rollbacks(spark, folder):
    """Rollback targets among the steps that count, with their reward."""
    marked = runlog.mark_superseded(runlog.parse_log(inputs.resumed_log(spark, folder)))
    current = runlog.current_lines(marked).where("kind IN ('step', 'nan_rollback')")
    return runlog.rollback_targets(current)


QUERIES = {
    query.__name__: query
    for query in (
        split_transcripts,
        prompts,
        sft_rows,
        dpo_triples,
        reward_model_rows,
        token_budget,
        prompt_budget,
        document_budget,
        reward_inputs,
        judge_requests,
        label_pairs,
        labelled_in_steps,
        labelled_transcripts,
        usable_pairs,
        verdict_readings,
        transcript_audit,
        pair_audit,
        pair_audit_by_labeler,
        reward_profile,
        candidate_file,
        labelled_file,
        human_pair_file,
        verdict_file,
        generation_file,
        registry,
        log_file,
        eval_raw,
        eval_document,
        match_items,
        match_requests,
        bucketed_matches,
        generation_gaps,
        match_verdicts,
        match_counts,
        match_totals,
        leaderboard,
        eval_report,
        positions,
        first_prompts,
        batch_cursor,
        rollout_rows,
        reward_clean,
        reward_by_step,
        reward_scaled,
        nan_steps,
        saved_steps,
        rollback_targets,
        unstable_steps,
        unstable_batches,
        run_trend,
        log_metrics,
        run_summary,
        resumed_lines,
        resumed_health,
        resumed_rollbacks,
    )
}
