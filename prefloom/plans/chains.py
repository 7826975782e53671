"""The chains a user runs on files: label candidates, evaluate models, training tables, runs."""

from pyspark.sql import functions as F

from prefloom import schemas
from prefloom.operators import audit, judging, matchups, rollouts, runlog, transcripts
from prefloom.sources import files, sinks


def request_labels(spark, candidates_path, out_path, seed, max_samples=None):
    """Write the judge requests for a candidate file."""
    candidates = files.read_candidates(spark, candidates_path, max_samples)
    requests = judging.judge_requests(candidates, ["cand_id"], judging.FORCED_RUBRIC, seed)
    requests.write.mode("overwrite").parquet(out_path)


def label_candidates(spark, candidates_path, verdicts_path, out_path, seed, max_samples=None):
    """Label a candidate file with its recorded replies; returns the audit of the labels.

    The labels are stored once, as parquet in `out_path`/labelled, and both the JSON lines in
    `out_path`/pairs and the audit are taken from there.
    """
    candidates = files.read_candidates(spark, candidates_path, max_samples)
    attempts = files.read_verdicts(spark, verdicts_path)
    judging.label_pairs(candidates, attempts, seed).write.mode("overwrite").parquet(f"{out_path}/labelled")
    labelled = spark.read.parquet(f"{out_path}/labelled")
    sinks.write_labelled_pairs(judging.pair_transcripts(labelled, "ai"), f"{out_path}/pairs")
    return audit.label_audit(labelled)


LABEL_BUCKETS = 64


def _bucketed(df, buckets):
    return df.withColumn("bucket", F.pmod(F.xxhash64("cand_id"), F.lit(buckets)).cast("int"))


def store_candidates(candidates, store, buckets=LABEL_BUCKETS):
    """Store candidates for labelling in steps: folders of hashed ids, numbers of which are kept with them.

    Labels of an earlier store at that place are gone.
    """
    spark = candidates.sparkSession
    for name, table in (("candidates", candidates), ("verdicts", None), ("labelled", None)):
        if table is None:
            schema = schemas.LABEL_VERDICT if name == "verdicts" else schemas.LABELLED
            table = spark.createDataFrame([], schema)
        by_bucket = _bucketed(table, buckets).repartition(buckets, "bucket")
        by_bucket.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{store}/{name}")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{store}/layout")


def add_verdicts(attempts, store, seed):
    """Add judge replies to a store and label anew only the buckets that they fall into; returns all labels.

    Other buckets are neither read nor written. A step that failed half-way is run again as a whole:
    repeated replies change no label, and a bucket is replaced when its new labels are complete.
    """
    spark = attempts.sparkSession
    buckets = spark.read.parquet(f"{store}/layout").first().buckets
    added = _bucketed(attempts.select("cand_id", "attempt", "raw").where("cand_id IS NOT NULL"), buckets)
    added.repartition(buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{store}/verdicts")
    # As many numbers as there are buckets at most.
    touched = [row.bucket for row in added.select("bucket").distinct().collect()]

    def stored(name, schema):
        return spark.read.schema(f"{schema}, bucket INT").parquet(f"{store}/{name}").where(F.col("bucket").isin(touched))

    candidates = stored("candidates", schemas.CANDIDATE)
    verdicts = stored("verdicts", schemas.LABEL_VERDICT).drop("bucket")
    labelled = _bucketed(judging.label_pairs(candidates.drop("bucket"), verdicts, seed), buckets)
    if touched:
        labelled.repartition(buckets, "bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket").parquet(f"{store}/labelled")
    return spark.read.schema(f"{schemas.LABELLED}, bucket INT").parquet(f"{store}/labelled").drop("bucket")


def _test_prompts(spark, pairs_root, n_prompts, path):
    """The prompts of the test split, stored: every use of them would number the files anew."""
    pairs = files.read_human_pairs(spark, pairs_root, "test", n_prompts)
    prompts = transcripts.prompts_only(pairs, "chosen").withColumnRenamed("pair_id", "prompt_id")
    prompts.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def request_matches(spark, results, pairs_root, generations_path, out_path, seed, n_prompts=None, exclude=()):
    """Write the judge requests of a model comparison; returns the responses that are missing."""
    roster = matchups.comparable_models(files.read_registry(spark, results), exclude)
    matchups.require_models(roster)
    prompts = _test_prompts(spark, pairs_root, n_prompts, f"{out_path}/prompts")
    texts = matchups.match_texts(prompts, files.read_generations(spark, generations_path), roster)
    texts.write.mode("overwrite").parquet(f"{out_path}/texts")
    texts = spark.read.parquet(f"{out_path}/texts")
    asked = texts.where("NOT missing").join(prompts, "prompt_id")
    requests = judging.judge_requests(asked, matchups.MATCH_KEYS, judging.TIE_RUBRIC, seed)
    requests.write.mode("overwrite").parquet(f"{out_path}/requests")
    return texts.where("missing").select(*matchups.MATCH_KEYS)


def training_tables(spark, pairs_path, out_path, budget=1024, max_samples=None, stored_ids=None):
    """Write the supervised, preference and reward-model tables of a file of labelled pairs."""
    pairs = files.read_preference_pairs(spark, data_file=pairs_path, max_samples=max_samples, stored_ids=stored_ids)
    pairs.write.mode("overwrite").parquet(f"{out_path}/pairs")
    pairs = spark.read.parquet(f"{out_path}/pairs")
    for name, table in (
        ("sft", transcripts.sft_rows(pairs)),
        ("dpo", transcripts.dpo_triples(pairs)),
        ("reward_model", transcripts.reward_model_rows(pairs, budget)),
    ):
        table.write.mode("overwrite").parquet(f"{out_path}/{name}")


def rollout_tables(spark, rollouts_path, prompts, out_path):
    """Write a run's rewards with their prompts and scaled values; returns the mean of each step.

    `prompts` has a prompt_id per row, standing in its order.
    """
    rewards = rollouts.scale_rewards(files.read_rollouts(spark, rollouts_path))
    placed = rollouts.batch_cursor(rewards, prompts.select("prompt_id")).drop("position")
    placed.write.mode("overwrite").parquet(f"{out_path}/rewards")
    return rollouts.reward_by_step(spark.read.parquet(f"{out_path}/rewards"))


def evaluate_models(
    spark, results, pairs_root, generations_path, verdicts_path, seed, judge, n_prompts=None, exclude=()
):
    """Write the raw evaluation and its report below `results`; returns the leaderboard.

    `n_prompts` caps the test prompts; None takes all. Responses that were never made are written to
    `results`/eval_raw/gaps; the parts in `results`/eval_raw/document are one JSON document.
    """
    roster = matchups.comparable_models(files.read_registry(spark, results), exclude)
    matchups.require_models(roster)
    prompts = _test_prompts(spark, pairs_root, n_prompts, f"{results}/eval_prompts")
    generations = files.read_generations(spark, generations_path).join(
        prompts.select("prompt_id"), "prompt_id", "left_semi"
    )
    gaps = matchups.generation_gaps(prompts, roster, generations)
    gaps.write.mode("overwrite").parquet(f"{results}/eval_raw/gaps")
    counts = matchups.match_tally(prompts, files.read_verdicts(spark, verdicts_path, "match"), roster, seed)
    stored = sinks.write_eval_raw(prompts, generations, counts, roster, f"{results}/eval_raw")
    sinks.write_eval_document_parts(stored, f"{results}/eval_raw/document")
    lines = sinks.report_lines(
        stored["matchups"],
        stored["wins"],
        matchups.match_totals(stored["matchups"]),
        judge,
        stored["prompts"].count(),
    )
    sinks.write_eval_report(lines, f"{results}/eval_report")
    return stored["wins"].orderBy(F.desc("wins"), "model")


def run_health(spark, log_path, runs=None, parts="file", resumed=False):
    """Summary and trend of each run from its log.

    With `resumed` a run that went back counts each step once, and its attempts are counted; only
    then lines have to be numbered.
    """
    parsed = runlog.parse_log(files.read_log(spark, log_path, runs, numbered=resumed, parts=parts))
    return runlog.resumed_health(parsed) if resumed else runlog.run_health(parsed)
