"""Declared schemas. Readers use them, so no file is ever scanned to infer one."""

PAIR_FILE = "chosen STRING, rejected STRING"
CANDIDATE_FILE = "prompt STRING, response_a STRING, response_b STRING"

PAIR = "pair_id BIGINT, chosen STRING, rejected STRING, labeler STRING"
CANDIDATE = "cand_id BIGINT, prompt STRING, response_a STRING, response_b STRING"
LABEL_VERDICT = "cand_id BIGINT, attempt INT, raw STRING"
MATCH_VERDICT = "prompt_id BIGINT, name_a STRING, name_b STRING, attempt INT, raw STRING"
LABELLED = (
    "cand_id BIGINT, swapped BOOLEAN, defaulted BOOLEAN, verdict STRING, prompt STRING, "
    "chosen_response STRING, rejected_response STRING"
)
GENERATION = "prompt_id BIGINT, model STRING, response STRING"
ROLLOUT = "run_id BIGINT, step BIGINT, slot BIGINT, reward DOUBLE"
STEP_METRIC = (
    "run_id BIGINT, step BIGINT, mean_reward DOUBLE, kl DOUBLE, "
    "val_var_explained DOUBLE, policy_loss DOUBLE"
)
LOG = "run_id BIGINT, line_no BIGINT, value STRING"
EVAL_RAW = (
    "prompts ARRAY<STRING>, generations MAP<STRING, ARRAY<STRING>>, wins MAP<STRING, BIGINT>, "
    "matchups MAP<STRING, STRUCT<a_wins: BIGINT, b_wins: BIGINT, ties: BIGINT>>"
)
