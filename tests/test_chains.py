import json

import pytest
from pyspark.sql import functions as F

from prefloom import schemas
from prefloom.operators import judging
from prefloom.plans import chains
from prefloom.sources import files, sinks
from prefloom.streaming import follow

MARK = "\n\nAssistant:"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


def test_label_candidates(spark, tmp_path):
    lines = [{"prompt": f"\n\nHuman: q{i}{MARK}", "response_a": f"a{i}", "response_b": f"bb{i}"} for i in range(30)]
    write(tmp_path / "candidates.jsonl", map(json.dumps, lines))
    requests = str(tmp_path / "requests")
    chains.request_labels(spark, str(tmp_path / "candidates.jsonl"), requests, "s")
    asked = spark.read.parquet(requests)
    # A judge that always picks side B's text, wherever it is shown; item 7 gets an empty
    # reply and item 8 was never asked.
    reply = F.when(F.col("swapped"), "A").otherwise("B")
    reply = F.when(F.col("cand_id") != 7, reply)
    asked.where("cand_id <> 8").select("cand_id", F.lit(1).alias("attempt"), reply.alias("raw")).write.parquet(
        str(tmp_path / "verdicts")
    )
    out = str(tmp_path / "pairs")
    audit = chains.label_candidates(
        spark, str(tmp_path / "candidates.jsonl"), str(tmp_path / "verdicts"), out, "s"
    ).first()
    assert (audit.n_pairs, audit.defaulted) == (29, 1)
    rows = files.read_preference_pairs(spark, data_file=f"{out}/pairs").orderBy("pair_id").collect()
    assert [r.pair_id for r in rows] == [i for i in range(30) if i != 8]
    for row in rows:
        i = row.pair_id
        if i != 7:
            assert row.chosen == f"\n\nHuman: q{i}{MARK} bb{i}" and row.rejected == f"\n\nHuman: q{i}{MARK} a{i}"


def evaluation_files(spark, tmp_path, models):
    results = tmp_path / "results"
    for name in [*models, "reward_model_x"]:
        write(results / name / "config.json", ["{}"])
    pairs = [{"chosen": f"\n\nHuman: q{i}{MARK} c", "rejected": f"\n\nHuman: q{i}{MARK} r"} for i in range(12)]
    write(tmp_path / "human" / "helpful-base" / "test.jsonl", map(json.dumps, pairs))
    rows = [(i, m, f" {m} {i} ") for i in range(12) for m in models]
    spark.createDataFrame(rows, schemas.GENERATION).write.parquet(str(tmp_path / "generations"))
    return results


def test_evaluate_models(spark, tmp_path):
    models = ["dpo", "ppo", "sft"]
    results = evaluation_files(spark, tmp_path, models)
    items = [(i, a, b) for i in range(12) for a, b in (("dpo", "ppo"), ("dpo", "sft"), ("ppo", "sft"))]
    frame = spark.createDataFrame(items, "prompt_id BIGINT, name_a STRING, name_b STRING")
    swapped = judging.with_swap(frame, ["prompt_id", "name_a", "name_b"], "s")
    reply = F.when(F.col("name_b") == "sft", F.when(F.col("swapped"), "A").otherwise("B")).otherwise("TIE")
    swapped.select("prompt_id", "name_a", "name_b", F.lit(0).alias("attempt"), reply.alias("raw")).write.parquet(
        str(tmp_path / "verdicts")
    )
    board = chains.evaluate_models(
        spark, str(results), str(tmp_path / "human"), str(tmp_path / "generations"),
        str(tmp_path / "verdicts"), "s", "recorded", n_prompts=10,
    ).collect()
    assert [(r.model, r.wins, r.played) for r in board] == [("sft", 20, 20), ("dpo", 0, 20), ("ppo", 0, 20)]
    (part,) = (results / "eval_report").glob("part-*")
    report = part.read_text()
    assert "Judge: recorded | Prompts: 10" in report and "Ties: 10 / 30 matchups" in report
    stored = {n: spark.read.parquet(str(results / "eval_raw" / n)) for n in ("prompts", "generations", "matchups", "wins")}
    assert spark.read.parquet(str(results / "eval_raw" / "gaps")).count() == 0
    sinks.write_eval_document(stored, str(results / "document"))
    document = json.loads(spark.read.text(str(results / "document")).first().value)
    assert document["generations"]["ppo"] == [f"ppo {i}" for i in range(10)]
    assert document["wins"] == {"dpo": 0, "ppo": 0, "sft": 20}


def test_request_matches_reports_missing_responses(spark, tmp_path):
    results = evaluation_files(spark, tmp_path, ["dpo", "sft"])
    spark.createDataFrame([(0, "dpo", "x"), (0, "sft", "y"), (1, "dpo", "x")], schemas.GENERATION).write.parquet(str(tmp_path / "some"))
    missing = chains.request_matches(
        spark, str(results), str(tmp_path / "human"), str(tmp_path / "some"), str(tmp_path / "asked"), "s"
    )
    assert sorted(r.prompt_id for r in missing.collect()) == list(range(1, 12))
    (row,) = spark.read.parquet(str(tmp_path / "asked" / "requests")).collect()
    assert row.prompt_id == 0 and "Human: q0" in row.request


def test_training_and_rollout_tables(spark, tmp_path):
    write(tmp_path / "pairs.jsonl", [json.dumps({"chosen": f"q{i}{MARK} y", "rejected": f"q{i}{MARK} n"}) for i in range(6)])
    out = str(tmp_path / "tables")
    chains.training_tables(spark, str(tmp_path / "pairs.jsonl"), out)
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in ("sft", "dpo", "reward_model")} == dict.fromkeys(("sft", "dpo", "reward_model"), 6)
    rows = [(1, step, slot, float(step + slot)) for step in range(4) for slot in range(16)]
    spark.createDataFrame(rows, schemas.ROLLOUT).write.json(str(tmp_path / "r.jsonl"))
    prompts = spark.range(40).select(F.col("id").alias("prompt_id"))
    means = chains.rollout_tables(spark, str(tmp_path / "r.jsonl"), prompts, out).orderBy("step").collect()
    assert [r.mean_reward for r in means] == [step + 7.5 for step in range(4)]
    stored = spark.read.parquet(f"{out}/rewards").where("step = 2").orderBy("slot").collect()
    assert [r.prompt_id for r in stored] == [*range(32, 40), *range(8)]


def test_an_empty_results_folder_is_no_roster(spark, tmp_path):
    with pytest.raises(ValueError, match="at least 2"):
        chains.evaluate_models(spark, str(tmp_path), "none", "none", "none", "s", "recorded")


def test_evaluation_needs_two_models(spark, tmp_path):
    results = evaluation_files(spark, tmp_path, ["sft"])
    with pytest.raises(ValueError, match="at least 2"):
        chains.evaluate_models(
            spark, str(results), str(tmp_path / "human"), str(tmp_path / "generations"),
            str(tmp_path / "none"), "s", "recorded",
        )


def test_run_health(spark, tmp_path):
    lines = ["starting"] + [
        f"step {s}/100  mean_reward={-s / 10:.3f}  kl={s % 3:.4f}  val_var_explained=0.900  policy_loss=0.0100"
        for s in range(50)
    ]
    write(tmp_path / "logs" / "run.log", lines)
    row = chains.run_health(spark, str(tmp_path / "logs")).first()
    assert (row.steps_logged, row.last_step, row.steps_requested) == (50, 49, 100)
    assert row.reward_slope == pytest.approx(-0.1) and (row.steps, row.nan_steps) == (50, 0)


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_followed_folders_match_the_batch_readers(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "logs" / f"{i}.log", [
            "noise", f"step {i}/9  mean_reward=1.000  kl=0.5000  val_var_explained=0.900  policy_loss=0.0100",
        ])
        write(tmp_path / "pairs" / f"{i}.jsonl", [json.dumps({"chosen": f"q{MARK} y{i}", "rejected": f"q{MARK} n{i}"})])
    log = drain(follow.follow_log(spark, str(tmp_path / "logs"), 1), "followed_log")
    assert sorted((r.kind, r.step, r.kl) for r in log.collect()) == [("step", i, 0.5) for i in range(3)]
    assert log.select("run_id").distinct().count() == 3
    pairs = drain(follow.follow_pairs(spark, str(tmp_path / "pairs"), 1), "followed_pairs")
    assert sorted(map(tuple, pairs.collect())) == [(f"q{MARK}", f"y{i}", f"n{i}") for i in range(3)]


def test_new_verdicts_relabel_their_buckets_only(spark, tmp_path):
    store = str(tmp_path / "store")
    candidates = spark.range(200).selectExpr("id AS cand_id", "concat('p', id) AS prompt", "'a' AS response_a", "'b' AS response_b")
    attempts = spark.range(200).selectExpr("id AS cand_id", "1 AS attempt", "IF(id % 3 = 0, 'B', 'A') AS raw")
    late = spark.createDataFrame([(5, 0, "B"), (6, 2, "A"), (300, 0, "A"), (None, 0, "A")], "cand_id BIGINT, attempt INT, raw STRING")

    def files_of():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "labelled").glob("bucket=*/part-*")}

    def want(replies):
        return sorted(map(tuple, judging.label_pairs(candidates, replies, "s").collect()))

    chains.store_candidates(candidates, store, buckets=16)
    first = chains.add_verdicts(attempts, store, "s")
    assert sorted(map(tuple, first.collect())) == want(attempts)
    before = files_of()
    for _ in range(2):  # the second time as after a failure
        labels = chains.add_verdicts(late, store, "s")
        assert sorted(map(tuple, labels.collect())) == want(attempts.unionAll(late))
    after = files_of()
    kept = {p for p in before if after.get(p) == before[p]}
    assert len(before) >= 14 and len(kept) >= len(before) - 3 and len(kept) < len(before)
    none = chains.add_verdicts(late.where("false"), store, "s")
    assert none.count() == 200 and files_of() == after
    chains.store_candidates(candidates, store, buckets=4)
    assert chains.add_verdicts(late.where("false"), store, "s").count() == 0
