import json

from pyspark.sql import functions as F

from prefloom import schemas
from prefloom.operators import matchups
from prefloom.sources import sinks


COUNTS = (
    "name_a STRING, name_b STRING, a_wins BIGINT, b_wins BIGINT, ties BIGINT, defaulted BIGINT, unjudged BIGINT"
)


def evaluation(spark):
    prompts = spark.createDataFrame([(2, "q2"), (10, "q10"), (1, "q1")], "prompt_id BIGINT, prompt STRING")
    rows = [(i, m, f"{m}{i}") for i in (10, 2, 1) for m in ("sft", "ppo", "dpo")]
    generations = spark.createDataFrame(rows, schemas.GENERATION).repartition(4)
    counts = spark.createDataFrame(
        [("dpo", "ppo", 1, 1, 1, 1, 0), ("dpo", "sft", 0, 3, 0, 0, 2), ("ppo", "sft", 2, 0, 1, 1, 0)],
        COUNTS,
    )
    roster = spark.createDataFrame([(m,) for m in ("dpo", "ppo", "sft")], "model STRING")
    return prompts, generations, counts, roster


WANT = {
    "prompts": ["q1", "q2", "q10"],
    "generations": {m: [f"{m}1", f"{m}2", f"{m}10"] for m in ("dpo", "ppo", "sft")},
    "wins": {"dpo": 1, "ppo": 3, "sft": 3},
    "matchups": {
        "dpo_vs_ppo": {"a_wins": 1, "b_wins": 1, "ties": 1},
        "dpo_vs_sft": {"a_wins": 0, "b_wins": 3, "ties": 0},
        "ppo_vs_sft": {"a_wins": 2, "b_wins": 0, "ties": 1},
    },
}


def test_eval_raw_tables_and_document(spark, tmp_path):
    path = str(tmp_path / "raw")
    stored = sinks.write_eval_raw(*evaluation(spark), path)
    assert set(stored) == {"prompts", "generations", "matchups", "wins"}
    sinks.write_eval_document(stored, f"{path}/document")
    line = spark.read.text(f"{path}/document").first().value
    assert json.loads(line) == WANT
    typed = spark.read.schema(schemas.EVAL_RAW).json(f"{path}/document").first()
    assert typed.wins == WANT["wins"] and typed.matchups["ppo_vs_sft"].a_wins == 2
    assert spark.read.parquet(f"{path}/generations").count() == 9


def test_document_parts_are_one_document(spark, tmp_path, conf):
    conf("spark.sql.adaptive.enabled", "false")
    prompts, generations, counts, roster = evaluation(spark)
    again = generations.unionAll(generations.withColumn("response", F.concat("response", F.lit("~"))))
    path = str(tmp_path / "raw")
    sinks.write_eval_document_parts(sinks.write_eval_raw(prompts, again, counts, roster, path), f"{path}/document")
    parts = sorted((tmp_path / "raw" / "document").glob("part-*"))
    assert len(parts) > 1 and json.loads("".join(part.read_text() for part in parts)) == WANT


def test_report(spark, tmp_path):
    _, _, counts, roster = evaluation(spark)
    board = matchups.leaderboard(counts, roster)
    lines = sinks.report_lines(counts, board, matchups.match_totals(counts), "recorded", 3)
    path = str(tmp_path / "report")
    sinks.write_eval_report(lines, path)
    (part,) = (tmp_path / "report").glob("part-*")
    assert part.read_text().splitlines() == [
        "# PPO vs DPO vs SFT — Eval Report", "", "Judge: recorded | Prompts: 3", "", "## Overall win counts", "",
        "| Model | Wins |", "|---|---|", "| ppo | 3 |", "| sft | 3 |", "| dpo | 1 |", "",
        "Ties: 2 / 9 matchups", "", "## Head-to-head", "", "| Matchup | A wins | B wins | Ties |",
        "|---|---|---|---|", "| dpo vs ppo | 1 | 1 | 1 |", "| dpo vs sft | 0 | 3 | 0 |",
        "| ppo vs sft | 2 | 0 | 1 |", "", "Defaulted: 2 | Unjudged: 2",
    ]


def test_report_orders_wins_as_numbers(spark):
    counts = spark.createDataFrame(
        [("a", "b", 2, 10, 0, 0, 0)], COUNTS
    )
    roster = spark.createDataFrame([("a",), ("b",)], "model STRING")
    board = matchups.leaderboard(counts, roster)
    lines = sinks.report_lines(counts, board, matchups.match_totals(counts), "j", 12)
    rows = lines.where(F.col("section") == 8).orderBy("place").collect()
    assert [r.value for r in rows] == ["| b | 10 |", "| a | 2 |"]
