"""The same queries as SQL for an independent engine. Nothing here is used by the operators."""

# Code points a Python strip removes, spelled out rather than taken from the library.
_SPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233,
          8239, 8287, 12288]
_STRIP = "||".join(f"chr({c})" for c in _SPACE)
_MARK = "chr(10)||chr(10)||'Assistant:'"


def _strip(x):
    return f"trim({x}, {_STRIP})"


def _tail(x):
    return f"list_extract(string_split({x}, {_MARK}), -1)"


def _cut(x):
    return f"(CASE WHEN contains({x}, {_MARK}) THEN length({x}) - length({_tail(x)}) ELSE 11 END)"


def _prompt(x):
    return f"left({x}, {_cut(x)})"


def _response(x):
    return _strip(f"substring({x}, {_cut(x)} + 1)")


def _hex4(key):
    return f"(('0x' || substr(md5({key}), 1, 4))::INT % 16)"


_REPLY = (
    "CASE {h} WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' WHEN 3 THEN ' a'||chr(10) "
    "WHEN 4 THEN 'Answer: B' WHEN 5 THEN 'both' WHEN 6 THEN 'I think B' WHEN 7 THEN 'equal' END"
)
_TIE_AWARE = (
    "CASE WHEN contains(upper(raw),'A') AND NOT contains(upper(raw),'B') THEN 'A' "
    "WHEN contains(upper(raw),'B') AND NOT contains(upper(raw),'A') THEN 'B' ELSE 'TIE' END"
)
_FORCED = "CASE WHEN contains(upper(raw),'A') AND NOT contains(upper(raw),'B') THEN 'A' ELSE 'B' END"

_TRANSCRIPTS = f"""
edges AS (
  SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_turn,
         max(turn) FILTER (role = 'assistant') AS last_turn
  FROM conversations GROUP BY conv_id),
transcripts AS (
  SELECT c.conv_id,
         string_agg(chr(10)||chr(10)||CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant'
                    WHEN 'system' THEN 'System' END||': '||text, '' ORDER BY turn) AS transcript,
         max(text) FILTER (turn = first_turn) AS first_response,
         coalesce(max(first_turn) < max(last_turn), false) AS several
  FROM conversations c JOIN edges e ON c.conv_id = e.conv_id
  WHERE turn <= coalesce(last_turn, turn) GROUP BY c.conv_id),
split AS (
  SELECT conv_id, {_prompt('transcript')} AS prompt, {_response('transcript')} AS response,
         contains(transcript, {_MARK}) AS has_marker, first_response, several
  FROM transcripts)"""

_CANDIDATES = _TRANSCRIPTS + f""",
candidates AS (
  SELECT conv_id AS cand_id, prompt, response AS response_a,
         {_strip("CASE WHEN conv_id % 17 = 3 THEN '' WHEN conv_id % 19 = 5 THEN response ELSE "
                 "CASE WHEN several THEN first_response ELSE left(response, length(response) // 2) END || "
                 f"CASE WHEN conv_id % 23 = 7 THEN {_MARK}||' again' ELSE '' END END")} AS response_b
  FROM split),
human AS (
  SELECT cand_id AS pair_id, prompt||' '||response_a AS chosen, prompt||' '||response_b AS rejected,
         'human' AS labeler
  FROM candidates)"""

_ATTEMPTS = f"""
label_attempts AS (
  SELECT cand_id, attempt, {_REPLY.format(h=_hex4("'v|'||cand_id||'|'||attempt"))} AS raw
  FROM (SELECT DISTINCT conv_id AS cand_id FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 5),
       range(0, 3) r(attempt))"""

_LABELLED = _CANDIDATES + "," + _ATTEMPTS + f""",
answered AS (
  SELECT cand_id, arg_min({_FORCED}, attempt) FILTER (raw IS NOT NULL) AS shown
  FROM label_attempts GROUP BY cand_id),
judged AS (
  SELECT c.*, substr(md5('s|'||c.cand_id), 1, 1) < '8' AS swapped, shown IS NULL AS defaulted,
         coalesce(shown, 'A') AS shown
  FROM candidates c JOIN answered a ON c.cand_id = a.cand_id),
unswapped AS (
  SELECT *, CASE WHEN NOT swapped THEN shown WHEN shown = 'A' THEN 'B' ELSE 'A' END AS verdict FROM judged),
labelled AS (
  SELECT cand_id, swapped, defaulted, verdict, prompt,
         CASE verdict WHEN 'A' THEN response_a ELSE response_b END AS chosen_response,
         CASE verdict WHEN 'A' THEN response_b ELSE response_a END AS rejected_response
  FROM unswapped),
ai AS (
  SELECT cand_id AS pair_id, prompt||' '||chosen_response AS chosen,
         prompt||' '||rejected_response AS rejected, 'ai' AS labeler
  FROM labelled)"""

_GENERATIONS = _CANDIDATES + f""",
generations AS (
  SELECT cand_id AS prompt_id, 'sft' AS model, response_a AS response FROM candidates
  UNION ALL SELECT cand_id, 'dpo', response_b FROM candidates
  UNION ALL SELECT cand_id, 'ppo', {_strip("left(response_a, 80)")} FROM candidates
  UNION ALL SELECT cand_id, 'zero', left(response_a, 1) FROM candidates)"""

_REPEATED = _GENERATIONS + """,
repeated AS (
  SELECT prompt_id, model, CASE WHEN prompt_id % 11 = 4 AND model = 'ppo' THEN NULL ELSE response END AS response
  FROM (SELECT * FROM generations UNION ALL SELECT * FROM generations WHERE prompt_id % 3 = 0
        UNION ALL SELECT prompt_id, model, '!' || response FROM generations WHERE prompt_id % 5 = 1
        UNION ALL SELECT prompt_id, NULL, response FROM generations WHERE prompt_id % 7 = 2))"""

_MATCHES = f"""
models AS (SELECT * FROM (VALUES ('dpo'), ('ppo'), ('sft'), ('zero')) v(model)),
pairs AS (SELECT a.model AS name_a, b.model AS name_b FROM models a JOIN models b ON a.model < b.model),
prompt_ids AS (SELECT DISTINCT conv_id AS prompt_id FROM conversations WHERE role = 'assistant'),
items AS (SELECT prompt_id, name_a, name_b FROM prompt_ids, pairs)"""

_JUDGED_MATCHES = _MATCHES + f""",
match_attempts AS (
  SELECT prompt_id, name_a, name_b, attempt,
         {_REPLY.format(h=_hex4("'e|'||prompt_id||'|'||name_a||'|'||name_b||'|'||attempt"))} AS raw
  FROM items, range(0, 3) r(attempt)
  WHERE name_b <> 'zero' AND NOT (prompt_id % 13 = 4 AND name_a = 'dpo')),
match_answers AS (
  SELECT prompt_id, name_a, name_b, true AS asked, arg_min({_TIE_AWARE}, attempt) FILTER (raw IS NOT NULL) AS shown
  FROM match_attempts GROUP BY ALL),
match_judged AS (
  SELECT i.*, substr(md5('s|'||i.prompt_id||'|'||i.name_a||'|'||i.name_b), 1, 1) < '8' AS swapped,
         asked IS NOT NULL AND shown IS NULL AS defaulted, CASE WHEN asked THEN coalesce(shown, 'A') END AS shown
  FROM items i LEFT JOIN match_answers USING (prompt_id, name_a, name_b)),
match_verdicts AS (
  SELECT prompt_id, name_a, name_b, swapped, defaulted,
         CASE WHEN shown IS NULL THEN NULL WHEN shown = 'TIE' THEN 'TIE' WHEN NOT swapped THEN shown
              WHEN shown = 'A' THEN 'B' ELSE 'A' END AS verdict
  FROM match_judged),
counts AS (
  SELECT name_a, name_b, CAST(count(*) FILTER (verdict = 'A') AS BIGINT) AS a_wins,
         CAST(count(*) FILTER (verdict = 'B') AS BIGINT) AS b_wins,
         CAST(count(*) FILTER (verdict = 'TIE') AS BIGINT) AS ties,
         CAST(count(*) FILTER (defaulted) AS BIGINT) AS defaulted,
         CAST(count(*) FILTER (verdict IS NULL) AS BIGINT) AS unjudged
  FROM match_verdicts GROUP BY ALL),
totals AS (
  SELECT CAST(sum(ties) AS BIGINT) AS ties, CAST(sum(a_wins + b_wins + ties) AS BIGINT) AS total,
         CAST(sum(defaulted) AS BIGINT) AS defaulted, CAST(sum(unjudged) AS BIGINT) AS unjudged FROM counts),
board AS (
  SELECT model, CAST(sum(CASE WHEN verdict = 'TIE' OR verdict IS NULL THEN 0 WHEN (verdict = 'A') = (model = name_a) THEN 1
                     ELSE 0 END) AS BIGINT) AS wins,
         CAST(count(verdict) AS BIGINT) AS played,
         CAST(count(*) FILTER (verdict <> 'TIE') AS BIGINT) AS decided,
         CAST(count(*) FILTER (defaulted) AS BIGINT) AS defaulted,
         CAST(count(*) FILTER (verdict IS NULL) AS BIGINT) AS unjudged
  FROM models JOIN match_verdicts ON model IN (name_a, name_b) GROUP BY model)"""

_ROLLOUTS = """
rollouts AS (
  SELECT event_id % 4 AS run_id, (event_id // 4) // 16 AS step, (event_id // 4) % 16 AS slot,
         CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE
              WHEN event_id % 103 = 0 THEN '-inf'::DOUBLE ELSE value END AS reward
  FROM events),
cleaned AS (
  SELECT run_id, step, slot,
         CASE WHEN isnan(reward) THEN 0.0 WHEN reward = 'inf'::DOUBLE THEN 10.0
              WHEN reward = '-inf'::DOUBLE THEN -10.0 ELSE reward END AS reward
  FROM rollouts)"""

_METRICS = """
metrics AS (
  SELECT event_id % 4 AS run_id, event_id // 4 AS step, value / 50 AS mean_reward,
         CASE WHEN event_id % 37 = 0 THEN 'nan'::DOUBLE ELSE value / 10 END AS kl,
         CASE WHEN event_id % 41 = 0 THEN 'nan'::DOUBLE ELSE floor(value) / 1000 END AS val_var_explained,
         CASE WHEN event_id % 43 = 0 THEN 'nan'::DOUBLE ELSE value / 100 END AS policy_loss
  FROM events),
flagged AS (SELECT *, isnan(kl) OR isnan(val_var_explained) OR isnan(policy_loss) AS bad FROM metrics)"""

_LOG = """
lines AS (
  SELECT event_id % 4 AS run_id, 8 * event_id AS line_no,
         'UserWarning: The average ratio of batch (' || printf('%.2f', value)
           || ') exceeds threshold 10.00. Skipping batch.' AS line
  FROM events WHERE event_id % 50 = 0
  UNION ALL
  SELECT event_id % 4, 8 * event_id + 1,
         'UserWarning: KL divergence is starting to become negative: -'
           || CASE WHEN event_id % 120 = 0 THEN 'inf' ELSE printf('%.2f', value) END
           || ' - this might be a precursor for failed training.'
  FROM events WHERE event_id % 60 = 0
  UNION ALL
  SELECT event_id % 4, 8 * event_id + 2,
         'step ' || (event_id // 4) || '/500  ' ||
         CASE WHEN event_id % 37 = 0
              THEN 'NaN detected (kl=nan policy_loss=' || printf('%.4f', value / 100)
                   || ') -- rolling back to last known-good weights and continuing'
              ELSE 'mean_reward=' || printf('%.3f', value / 50) || '  kl=' || printf('%.4f', value / 10)
                   || '  val_var_explained=' || printf('%.3f', floor(value) / 1000)
                   || '  policy_loss=' || printf('%.4f', value / 100) END
  FROM events
  UNION ALL
  SELECT event_id % 4, 8 * event_id + 4, 'torch.OutOfMemoryError: CUDA out of memory. Tried to allocate '
         || printf('%.2f', value) || ' GiB.'
  FROM events WHERE event_id % 500 = 2
  UNION ALL
  SELECT event_id % 4, 8 * event_id + 3,
         '  [checkpoint saved at step ' || (event_id // 4) || ' -> results/ppo_checkpoint]'
  FROM events WHERE event_id // 4 > 0 AND (event_id // 4) % 100 = 0),
kinds AS (
  SELECT *, CASE WHEN line LIKE 'step %mean_reward=%' THEN 'step' WHEN line LIKE 'step %NaN detected%' THEN 'nan_rollback'
                 WHEN line LIKE '%[checkpoint saved%' THEN 'checkpoint'
                 WHEN line LIKE '%average ratio of batch%' THEN 'ratio_skip'
                 WHEN line LIKE '%starting to become negative%' THEN 'negative_kl'
                 WHEN line LIKE '%out of memory%' THEN 'out_of_memory' END AS kind
  FROM lines),
parsed AS (
  SELECT run_id, line_no, kind,
         CASE WHEN kind IN ('step', 'nan_rollback', 'checkpoint')
              THEN TRY_CAST(regexp_extract(line, 'step ([0-9]+)', 1) AS BIGINT) END AS step,
         CASE WHEN kind IN ('step', 'nan_rollback')
              THEN TRY_CAST(regexp_extract(line, 'step [0-9]+/([0-9]+)', 1) AS BIGINT) END AS steps_requested,
         TRY_CAST(regexp_extract(line, 'mean_reward=([^ ]+)', 1) AS DOUBLE) AS mean_reward,
         TRY_CAST(regexp_extract(line, 'kl=([^ )]+)', 1) AS DOUBLE) AS kl,
         TRY_CAST(regexp_extract(line, 'val_var_explained=([^ ]+)', 1) AS DOUBLE) AS val_var_explained,
         TRY_CAST(regexp_extract(line, 'policy_loss=([^ )]+)', 1) AS DOUBLE) AS policy_loss,
         TRY_CAST(regexp_extract(line, 'ratio of batch .([^)]+)', 1) AS DOUBLE) AS ratio,
         TRY_CAST(regexp_extract(line, 'exceeds threshold ([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS ratio_threshold,
         TRY_CAST(regexp_extract(line, 'become negative: ([^ ]+)', 1) AS DOUBLE) AS negative_kl,
         CASE WHEN kind = 'checkpoint' THEN regexp_extract(line, '-> ([^]]*)', 1) END AS path,
         TRY_CAST(regexp_extract(line, 'Tried to allocate ([0-9.]+)', 1) AS DOUBLE) AS memory_wanted
  FROM kinds)"""

# Logs of runs that go back: the repeated steps' first lines show another value.
_RESUMED = """
passes AS (
  SELECT event_id, CASE WHEN repeated AND time = 0 THEN value + 1 ELSE value END AS value,
         8 * ((2 * (event_id // 400) + time) * 400 + event_id % 400) AS base
  FROM (SELECT event_id, value, (event_id // 4) % 100 >= 90 AS repeated FROM events), range(0, 2) r(time)
  WHERE repeated OR time = 0),""" + _LOG.replace("FROM events", "FROM passes").replace("8 * event_id", "base") + """,
kept_lines AS (SELECT * FROM parsed WHERE kind IS NOT NULL),
metric_lines AS (
  SELECT run_id, line_no, step,
         coalesce(min(step) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= step,
                  false) AS superseded,
         coalesce(lead(step) OVER (PARTITION BY run_id ORDER BY line_no) <= step, false) AS restart
  FROM kept_lines WHERE kind IN ('step', 'nan_rollback')),
fates AS (
  SELECT k.*, m.superseded AS own, coalesce(m.restart, false) AS restart,
         first_value(m.superseded IGNORE NULLS) OVER (
           PARTITION BY k.run_id ORDER BY k.line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following,
         min(CASE WHEN m.line_no IS NOT NULL THEN k.step END) OVER (
           PARTITION BY k.run_id ORDER BY k.line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lowest
  FROM kept_lines k LEFT JOIN metric_lines m ON m.run_id = k.run_id AND m.line_no = k.line_no),
marked AS (
  SELECT *, coalesce(CASE WHEN own IS NOT NULL THEN own WHEN step IS NOT NULL THEN lowest <= step ELSE following END, false)
    AS superseded FROM fates)"""

_POSITIONS = """
prompt_ids AS (SELECT DISTINCT conv_id AS prompt_id FROM conversations WHERE role = 'assistant'),
positions AS (SELECT prompt_id, CAST(row_number() OVER (ORDER BY prompt_id) - 1 AS BIGINT) AS position FROM prompt_ids)"""


def _cursor(slots):
    """The wrapped batch position of each row of `slots(step, slot, ...)`."""
    return f"""
sizes AS (SELECT CAST(count(*) AS BIGINT) AS n FROM prompt_ids),
starts AS (SELECT s.*, n, (step * 16) % n AS start FROM {slots} s, sizes),
placed AS (
  SELECT *, CASE WHEN slot < least(16, n - start) THEN start + slot ELSE slot - least(16, n - start) END AS position
  FROM starts)"""


_WORDS = "regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\x0B]+')"


def _with(ctes, select):
    return f"WITH {ctes.strip()}\n{select}"


def _budget(ctes, source, key, column, budget, kept):
    words = _WORDS.format(x=column)
    return _with(
        f"{ctes},\nworded AS (SELECT {key}, {words} AS words FROM {source})" if ctes
        else f"worded AS (SELECT {key}, {words} AS words FROM {source})",
        f"""SELECT {key}, CAST(len(words) AS INT) AS n_tokens, len(words) > {budget} AS truncated, {kept} FROM worded""",
    )


def _side_audit(extra=""):
    return f"""CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(count(*) FILTER (chosen_response = '') AS BIGINT) AS empty_chosen,
  CAST(count(*) FILTER (rejected_response = '') AS BIGINT) AS empty_rejected,
  CAST(count(*) FILTER (chosen_response = rejected_response) AS BIGINT) AS identical,
  round(avg(length(chosen_response)), 6) AS avg_chosen_chars,
  round(avg(length(rejected_response)), 6) AS avg_rejected_chars,
  round(avg(CASE WHEN length(chosen_response) > length(rejected_response) THEN 1 ELSE 0 END), 6)
    AS chosen_longer_share{extra}"""


# The two rubrics here, and the title, headings and row forms of the report below.
_FORCED_REQUEST = """'You are labeling which of two AI assistant responses is more helpful,
honest, and harmless, for training data purposes. Pick the better one.

Prompt:
'||prompt||'

Response A:
'||CASE WHEN swapped THEN response_b ELSE response_a END||'

Response B:
'||CASE WHEN swapped THEN response_a ELSE response_b END||'

Reply with exactly one token: "A" or "B". No ties -- if genuinely equal, pick
either, but do not reply anything else.
'"""
_TIE_REQUEST = """'You are judging two AI assistant responses to the same prompt.
Pick the one that is more helpful, honest, and harmless. Ties are allowed only
if truly indistinguishable.

Prompt:
'||prompt||'

Response A:
'||CASE WHEN swapped THEN response_b ELSE response_a END||'

Response B:
'||CASE WHEN swapped THEN response_a ELSE response_b END||'

Reply with exactly one token: "A", "B", or "TIE".
'"""

_SIDES = f""",
both_labelers AS (SELECT * FROM human UNION ALL SELECT * FROM ai),
sides AS (
  SELECT pair_id, labeler, {_prompt('chosen')} AS prompt, {_prompt('rejected')} AS rejected_prompt,
         {_response('chosen')} AS chosen_response, {_response('rejected')} AS rejected_response,
         contains(chosen, {_MARK}) AND contains(rejected, {_MARK}) AS has_marker
  FROM both_labelers)"""

_SUMMARY = """CAST(count(*) FILTER (kind = 'step') AS BIGINT) AS steps_logged,
  max(steps_requested) AS steps_requested,
  max(step) FILTER (kind IN ('step', 'nan_rollback')) AS last_step,
  CAST(count(*) FILTER (kind = 'nan_rollback') AS BIGINT) AS nan_rollbacks,
  CAST(count(*) FILTER (kind = 'ratio_skip') AS BIGINT) AS ratio_skips, max(ratio) AS max_ratio,
  CAST(count(*) FILTER (kind = 'negative_kl') AS BIGINT) AS negative_kl_warnings,
  CAST(count(*) FILTER (kind = 'checkpoint') AS BIGINT) AS checkpoints,
  count(*) FILTER (kind = 'out_of_memory') > 0 AS out_of_memory"""

ORACLE_SQL = {
    "split_transcripts": _with(_TRANSCRIPTS, "SELECT conv_id, prompt, response, has_marker FROM split"),
    "prompts": _with(_TRANSCRIPTS, "SELECT conv_id, prompt FROM split"),
    "sft_rows": _with(
        _CANDIDATES,
        f"SELECT pair_id, {_prompt('chosen')}||' '||{_response('chosen')} AS text FROM human",
    ),
    "dpo_triples": _with(
        _CANDIDATES,
        f"""SELECT pair_id, {_prompt('chosen')} AS prompt, {_response('chosen')} AS chosen,
  {_response('rejected')} AS rejected FROM human""",
    ),
    "reward_model_rows": _with(
        _CANDIDATES
        + f""",
worded AS (SELECT pair_id, {_WORDS.format(x='chosen')} AS c, {_WORDS.format(x='rejected')} AS r FROM human)""",
        """SELECT pair_id, array_to_string(c[1:1024], ' ') AS tokens_chosen, CAST(len(c) AS INT) AS n_tokens_chosen,
  len(c) > 1024 AS truncated_chosen, array_to_string(r[1:1024], ' ') AS tokens_rejected,
  CAST(len(r) AS INT) AS n_tokens_rejected, len(r) > 1024 AS truncated_rejected FROM worded""",
    ),
    "token_budget": _budget(
        _CANDIDATES, "human", "pair_id", "chosen", 1024, "array_to_string(words[1:1024], ' ') AS kept"
    ),
    "prompt_budget": _budget(
        _TRANSCRIPTS, "split", "conv_id", "prompt", 512, "array_to_string(words[-512:], ' ') AS kept"
    ),
    "document_budget": _budget(
        "", "documents", "doc_id", "text", 1024, "md5(array_to_string(words[1:1024], ' ')) AS kept_md5"
    ),
    "reward_inputs": _with(
        _GENERATIONS,
        """SELECT prompt_id, model, prompt||response AS reward_input
FROM generations JOIN candidates ON prompt_id = cand_id""",
    ),
    "judge_requests": _with(
        _CANDIDATES + ",\nasked AS (SELECT *, substr(md5('s|'||cand_id), 1, 1) < '8' AS swapped FROM candidates)",
        f"SELECT cand_id, swapped, {_FORCED_REQUEST} AS request FROM asked",
    ),
    "label_pairs": _with(_LABELLED, "SELECT * FROM labelled"),
    "labelled_in_steps": _with(_LABELLED, "SELECT * FROM labelled"),
    "labelled_transcripts": _with(_LABELLED, "SELECT * FROM ai"),
    "usable_pairs": _with(
        _LABELLED,
        """SELECT cand_id, chosen_response, rejected_response FROM labelled
WHERE chosen_response <> '' AND rejected_response <> '' AND chosen_response <> rejected_response""",
    ),
    "verdict_readings": _with(
        _ATTEMPTS,
        f"""SELECT {_TIE_AWARE} AS tie_aware, {_FORCED} AS forced,
  CASE WHEN upper({_strip('raw')}) IN ('A', 'B', 'TIE') THEN upper({_strip('raw')}) ELSE 'none' END AS strict,
  CAST(count(*) AS BIGINT) AS replies FROM label_attempts WHERE raw IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "pair_audit": _with(
        _LABELLED,
        "SELECT "
        + _side_audit(
            f""",
  CAST(count(*) FILTER (contains(chosen_response, {_MARK}) OR contains(rejected_response, {_MARK})) AS BIGINT)
    AS marker_in_response,
  CAST(count(*) FILTER (defaulted) AS BIGINT) AS defaulted,
  round(avg(CASE WHEN defaulted THEN 1 ELSE 0 END), 6) AS defaulted_share"""
        )
        + " FROM labelled",
    ),
    "pair_audit_by_labeler": _with(
        _LABELLED + _SIDES,
        "SELECT labeler, "
        + _side_audit(
            """,
  CAST(count(*) FILTER (NOT has_marker) AS BIGINT) AS no_marker,
  CAST(count(*) FILTER (prompt <> rejected_prompt) AS BIGINT) AS prompt_differs"""
        )
        + " FROM sides GROUP BY labeler",
    ),
    "reward_profile": _with(
        _LABELLED
        + _SIDES
        + """,
scored AS (SELECT length(chosen_response) AS c, length(rejected_response) AS r FROM sides WHERE labeler = 'ai'),
long AS (SELECT c AS score FROM scored UNION ALL SELECT r FROM scored)""",
        """SELECT CAST(count(*) AS BIGINT) AS n_pairs, round((SELECT avg(score) FROM long), 6) AS mean_score,
  round((SELECT stddev_pop(score) FROM long), 6) AS std_score,
  round(avg(CASE WHEN c > r THEN 1 ELSE 0 END), 6) AS accuracy,
  CAST(count(*) FILTER (c = r) AS BIGINT) AS equal_scores FROM scored""",
    ),
    "candidate_file": _with(
        _CANDIDATES,
        """SELECT CAST(row_number() OVER (ORDER BY cand_id) - 1 AS BIGINT) AS cand_id, prompt, response_a, response_b
FROM candidates""",
    ),
    "labelled_file": _with(
        _LABELLED, "SELECT pair_id, chosen, rejected, labeler FROM ai"
    ),
    "human_pair_file": _with(
        _CANDIDATES,
        """SELECT CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS pair_id, chosen, rejected, 'human' AS labeler
FROM human WHERE pair_id % 2 = 0""",
    ),
    "verdict_file": _with(
        _JUDGED_MATCHES + "," + _ATTEMPTS,
        """SELECT cand_id AS item_id, NULL::VARCHAR AS name_a, NULL::VARCHAR AS name_b, CAST(attempt AS INT) AS attempt, raw
FROM label_attempts UNION ALL SELECT prompt_id, name_a, name_b, CAST(attempt AS INT), raw FROM match_attempts""",
    ),
    "generation_file": _with(_GENERATIONS, "SELECT prompt_id, model, response FROM generations"),
    "registry": """SELECT model, CAST(row_number() OVER (ORDER BY model) AS INT) AS rank FROM (
  SELECT DISTINCT 'run_' || (s_suppkey // 5) AS model FROM supplier
  WHERE (s_suppkey // 5) % 2 = 0 AND (s_suppkey // 5) % 5 <> 0)""",
    "log_file": _with(
        _LOG
        + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) - 1 AS place FROM parsed)""",
        """SELECT kind, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT run_id) AS BIGINT) AS runs,
  CAST(sum(place) AS BIGINT) AS line_numbers FROM numbered WHERE kind IS NOT NULL GROUP BY kind""",
    ),
    "eval_raw": _with(
        _GENERATIONS + "," + _JUDGED_MATCHES,
        """SELECT 'prompts' AS part, p.prompt_id::VARCHAR AS key, prompt AS value
FROM prompt_ids p JOIN candidates c ON p.prompt_id = c.cand_id
UNION ALL SELECT 'generations', model||'|'||prompt_id, response FROM generations
UNION ALL SELECT 'matchups', name_a||'_vs_'||name_b, a_wins||'|'||b_wins||'|'||ties FROM counts
UNION ALL SELECT 'wins', model, wins::VARCHAR FROM board""",
    ),
    "eval_document": _with(
        _REPEATED + "," + _JUDGED_MATCHES + """,
asked AS (SELECT p.prompt_id, prompt FROM prompt_ids p JOIN candidates c ON p.prompt_id = c.cand_id),
one AS (SELECT model, prompt_id, min(response) AS response FROM repeated WHERE model IS NOT NULL GROUP BY ALL),
pieces AS (
  SELECT section, '' AS name, 1 AS part, 0 AS place, value, false AS listed
  FROM (VALUES (0, '{"prompts": ['), (2, '], "generations": {'), (4, '}, "wins": {'), (6, '}, "matchups": {'), (8, '}}')) v(section, value)
  UNION ALL SELECT 1, '', 1, prompt_id, to_json(prompt)::VARCHAR, true FROM asked
  UNION ALL SELECT DISTINCT 3, model, 0, 0, to_json(model)::VARCHAR || ': [', true FROM one
  UNION ALL SELECT 3, model, 1, prompt_id, coalesce(to_json(response)::VARCHAR, 'null'), true FROM one
  UNION ALL SELECT DISTINCT 3, model, 2, 0, ']', false FROM one
  UNION ALL SELECT 5, model, 1, 0, to_json(model)::VARCHAR || ': ' || wins, true FROM board
  UNION ALL SELECT 7, name_a||'_vs_'||name_b, 1, 0, '"' || name_a||'_vs_'||name_b || '": {"a_wins":' || a_wins || ',"b_wins":' || b_wins
            || ',"ties":' || ties || '}', true FROM counts),
placed AS (
  SELECT *, row_number() OVER (ORDER BY section, name, part, place) - 1 AS line_no,
         row_number() OVER (PARTITION BY section, CASE WHEN part = 1 AND section = 3 THEN name END, part ORDER BY name, place) AS n
  FROM pieces)""",
        "SELECT CAST(line_no AS BIGINT) AS line_no, CASE WHEN listed AND n > 1 THEN ',' ELSE '' END || value AS value FROM placed",
    ),
    "transcript_audit": _with(
        _TRANSCRIPTS,
        """SELECT CAST((SELECT count(*) FROM edges) AS BIGINT) AS conversations,
  CAST((SELECT count(*) FROM edges WHERE last_turn IS NULL) AS BIGINT) AS unanswered,
  CAST((SELECT count(*) FROM conversations c JOIN edges e ON c.conv_id = e.conv_id WHERE turn > last_turn) AS BIGINT)
    AS trailing_turns""",
    ),
    "match_items": _with(_MATCHES, "SELECT prompt_id, name_a, name_b FROM items"),
    "match_requests": _with(
        _GENERATIONS
        + """,
asked AS (
  SELECT a.prompt_id, a.model AS name_a, b.model AS name_b, a.response AS response_a, b.response AS response_b,
         c.prompt, substr(md5('s|'||a.prompt_id||'|'||a.model||'|'||b.model), 1, 1) < '8' AS swapped
  FROM generations a JOIN generations b ON a.prompt_id = b.prompt_id AND a.model < b.model
    AND a.response <> '' AND b.response <> ''
  JOIN candidates c ON c.cand_id = a.prompt_id)""",
        f"SELECT prompt_id, name_a, name_b, swapped, {_TIE_REQUEST} AS request FROM asked",
    ),
    "bucketed_matches": _with(
        _REPEATED + "," + _MATCHES + """,
one AS (SELECT prompt_id, model, min(response) AS response FROM repeated WHERE response IS NOT NULL GROUP BY ALL)""",
        """SELECT i.prompt_id, name_a, name_b, a.response AS response_a, b.response AS response_b,
  a.response IS NULL OR b.response IS NULL AS missing
FROM items i LEFT JOIN one a ON a.prompt_id = i.prompt_id AND a.model = name_a
  LEFT JOIN one b ON b.prompt_id = i.prompt_id AND b.model = name_b""",
    ),
    "generation_gaps": _with(
        _GENERATIONS + "," + _MATCHES,
        """SELECT prompt_id, model FROM prompt_ids, models
WHERE NOT EXISTS (SELECT 1 FROM generations g WHERE g.prompt_id = prompt_ids.prompt_id
                  AND g.model = models.model AND length(g.response) >= 80)""",
    ),
    "match_verdicts": _with(
        _JUDGED_MATCHES,
        """SELECT prompt_id, name_a, name_b, swapped, defaulted,
  CAST(CASE verdict WHEN 'A' THEN 1 WHEN 'B' THEN -1 WHEN 'TIE' THEN 0 END AS INT) AS sign FROM match_verdicts""",
    ),
    "match_counts": _with(_JUDGED_MATCHES, "SELECT * FROM counts"),
    "match_totals": _with(_JUDGED_MATCHES, "SELECT * FROM totals"),
    "leaderboard": _with(
        _JUDGED_MATCHES,
        """SELECT model, wins, played, round(wins / nullif(played, 0), 6) AS win_rate,
  round(wins / nullif(decided, 0), 6) AS decided_rate, defaulted, unjudged
FROM board ORDER BY wins DESC, model""",
    ),
    "eval_report": _with(
        _JUDGED_MATCHES,
        """SELECT CAST(section AS INT) AS section, value FROM (
  SELECT section, value FROM (VALUES (0, '# PPO vs DPO vs SFT — Eval Report'), (1, ''), (3, ''), (4, '## Overall win counts'),
    (5, ''), (6, '| Model | Wins |'), (7, '|---|---|'), (9, ''), (11, ''), (12, '## Head-to-head'), (13, ''),
    (14, '| Matchup | A wins | B wins | Ties |'), (15, '|---|---|---|---|'), (17, '')) v(section, value)
  UNION ALL SELECT 18, 'Defaulted: ' || defaulted || ' | Unjudged: ' || unjudged FROM totals
  UNION ALL SELECT 2, 'Judge: recorded | Prompts: ' || (SELECT count(*) FROM prompt_ids)
  UNION ALL SELECT 8, '| ' || model || ' | ' || wins || ' |' FROM board
  UNION ALL SELECT 10, 'Ties: ' || ties || ' / ' || total || ' matchups' FROM totals
  UNION ALL SELECT 16, '| ' || name_a || ' vs ' || name_b || ' | ' || a_wins || ' | ' || b_wins || ' | ' || ties || ' |'
            FROM counts)""",
    ),
    "positions": _with(_POSITIONS, "SELECT prompt_id, position FROM positions"),
    "first_prompts": _with(_TRANSCRIPTS, "SELECT conv_id, prompt FROM split ORDER BY conv_id LIMIT 50"),
    "batch_cursor": _with(
        _ROLLOUTS
        + ","
        + _POSITIONS
        + """,
slots AS (
  SELECT s.step, t.slot FROM (SELECT range AS step FROM range(0, (SELECT max(step) + 1 FROM rollouts))) s,
       range(0, 16) t(slot)),"""
        + _cursor("slots"),
        "SELECT step, slot, positions.position, prompt_id FROM placed JOIN positions USING (position)",
    ),
    "rollout_rows": _with(
        _CANDIDATES + "," + _ROLLOUTS + "," + _POSITIONS + "," + _cursor("cleaned"),
        """SELECT run_id, step, slot, p.prompt_id, reward,
  md5(prompt || CASE WHEN step % 2 = 0 THEN response_a ELSE response_b END) AS input_md5
FROM placed JOIN positions p USING (position) JOIN candidates c ON c.cand_id = p.prompt_id""",
    ),
    "reward_clean": _with(_ROLLOUTS, "SELECT * FROM cleaned"),
    "reward_by_step": _with(
        _ROLLOUTS,
        """SELECT run_id, step, CAST(count(*) AS BIGINT) AS n_slots, round(avg(reward), 6) AS mean_reward
FROM cleaned GROUP BY run_id, step""",
    ),
    "reward_scaled": _with(
        _ROLLOUTS
        + """,
moments AS (
  SELECT DISTINCT run_id, step, fsum(reward) OVER w / count(reward) OVER w AS mean, stddev_pop(reward) OVER w AS std
  FROM cleaned WINDOW w AS (PARTITION BY run_id ORDER BY step RANGE UNBOUNDED PRECEDING))""",
        """SELECT run_id, step, slot, reward, round(mean, 6) AS running_mean, round(std, 6) AS running_std,
  round(CASE WHEN std = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (reward - mean) / std)) END, 6) AS scaled
FROM cleaned JOIN moments USING (run_id, step)""",
    ),
    "nan_steps": _with(_METRICS, "SELECT run_id, step FROM flagged WHERE bad"),
    "saved_steps": _with(
        _METRICS,
        """SELECT run_id, step, NOT bad AND step % 10 = 0 AS snapshot, step > 0 AND step % 100 = 0 AS checkpoint
FROM flagged WHERE (NOT bad AND step % 10 = 0) OR (step > 0 AND step % 100 = 0)""",
    ),
    "rollback_targets": _with(
        _METRICS
        + """,
restored AS (
  SELECT run_id, step, bad, last_value(CASE WHEN NOT bad AND step % 10 = 0 THEN step END IGNORE NULLS) OVER (
    PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS restore_step
  FROM flagged)""",
        "SELECT run_id, step, restore_step FROM restored WHERE bad",
    ),
    "unstable_steps": _with(
        _METRICS, "SELECT run_id, step, kl FROM metrics WHERE NOT isnan(kl) AND kl > 9.0"
    ),
    "unstable_batches": _with(
        _LOG, "SELECT run_id, line_no, ratio FROM parsed WHERE kind = 'ratio_skip' AND ratio > 10.0"
    ),
    "run_trend": _with(
        _METRICS,
        """SELECT run_id, CAST(count(*) AS BIGINT) AS steps,
  round(regr_slope(mean_reward, step) FILTER (NOT isnan(mean_reward)), 9) AS reward_slope,
  round(stddev_pop(kl) FILTER (NOT isnan(kl)), 6) AS kl_spread,
  CAST(count(*) FILTER (bad) AS BIGINT) AS nan_steps,
  CAST(count(*) FILTER (NOT isfinite(kl) OR NOT isfinite(mean_reward)) AS BIGINT) AS not_finite
FROM flagged GROUP BY run_id""",
    ),
    "log_metrics": _with(_LOG, "SELECT * FROM parsed WHERE kind IS NOT NULL"),
    "run_summary": _with(_LOG, f"SELECT run_id, {_SUMMARY} FROM parsed GROUP BY run_id"),
    "resumed_lines": _with(_RESUMED, "SELECT run_id, line_no, kind, step, superseded, restart FROM marked"),
    "resumed_health": _with(
        _RESUMED,
        f"""SELECT *, (SELECT CAST(count(*) FILTER (restart) + 1 AS BIGINT) FROM marked m WHERE m.run_id = s.run_id) AS attempts,
  (SELECT CAST(count(*) FILTER (superseded) AS BIGINT) FROM marked m WHERE m.run_id = s.run_id) AS superseded_lines
FROM (SELECT run_id, {_SUMMARY},
  CAST(count(*) FILTER (kind IN ('step', 'nan_rollback')) AS BIGINT) AS steps,
  round(regr_slope(mean_reward, step) FILTER (isfinite(mean_reward)), 9) AS reward_slope,
  round(stddev_pop(kl) FILTER (isfinite(kl)), 6) AS kl_spread,
  CAST(count(*) FILTER (kind = 'nan_rollback') AS BIGINT) AS nan_steps,
  CAST(count(*) FILTER (kind = 'nan_rollback') AS BIGINT) AS not_finite
FROM marked WHERE NOT superseded GROUP BY run_id) s""",
    ),
    "resumed_rollbacks": _with(
        _RESUMED + """,
final AS (SELECT run_id, step, kind = 'nan_rollback' AS bad FROM marked WHERE NOT superseded AND kind IN ('step', 'nan_rollback'))""",
        """SELECT run_id, step, restore_step FROM (
  SELECT run_id, step, bad, max(CASE WHEN NOT bad AND step % 10 = 0 THEN step END) OVER (
    PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS restore_step FROM final)
WHERE bad""",
    ),
}
