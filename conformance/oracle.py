"""The registered queries in SQL for DuckDB, over the same parquet tables.

Written from the rules, not from the Spark code: upserts are window functions, hashes are built
character by character, globs are regular expressions translated by hand.
"""

from __future__ import annotations

from conformance.queries import ODD_IDS
from evalspark.operators.migrations import CURRENT_VERSION
from conformance.fixtures import MODEL_NAMES, REGISTERED_AT, RUBRIC, STAMP


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_MODELS = _values([(at, name, f"M{at}_OR") for at, name in enumerate(MODEL_NAMES)])

_ODD = ", ".join("'" + text.replace("'", "''") + "'" for text in ODD_IDS)

# JSON string escapes, ASCII only: short forms, then UTF-16 units in hex.
_ESCAPED = r"""array_to_string(list_transform(string_split(text, ''), lambda ch: CASE
    WHEN ch = '' THEN ''
    WHEN ch = '"' THEN '\"'
    WHEN ch = '\' THEN '\\'
    WHEN ch = chr(10) THEN '\n'
    WHEN ch = chr(13) THEN '\r'
    WHEN ch = chr(9) THEN '\t'
    WHEN ch = chr(8) THEN '\b'
    WHEN ch = chr(12) THEN '\f'
    WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch
    WHEN unicode(ch) < 65536 THEN printf('\u%04x', unicode(ch))
    ELSE printf('\u%04x', 55296 + (unicode(ch) - 65536) // 1024)
         || printf('\u%04x', 56320 + (unicode(ch) - 65536) % 1024)
  END), '')"""

_VIEWS = f"""
WITH fx_models(position, model, enum_name) AS (VALUES {_MODELS}),
counts AS (
  SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n_conv,
         (SELECT count(*) FROM documents) AS n_doc
),
turns AS (SELECT conv_id, turn, role, text, {_ESCAPED} AS escaped FROM conversations),
grouped AS (
  SELECT conv_id,
         count(*) AS n_messages,
         arg_min(role, turn) AS first_role,
         arg_max(role, turn) AS last_role,
         arg_max(text, turn) AS last_text,
         sha256('[' || string_agg('{{"content": "' || escaped || '", "role": "' || role || '"}}', ', ' ORDER BY turn) || ']')
           AS messages_hash
  FROM turns GROUP BY conv_id
),
chains AS (
  SELECT *,
         CASE WHEN conv_id % 2 = 0
              THEN ['cat_' || (conv_id % 3), 'grp_' || (conv_id % 5), 'conv_' || conv_id]
              ELSE ['cat_' || (conv_id % 3), 'conv_' || conv_id] END AS id_chain
  FROM grouped
),
fx_tasks AS (
  SELECT conv_id, id_chain, n_messages, last_text, messages_hash,
         array_to_string(id_chain, '::') AS chain,
         array_to_string(id_chain, ' / ') AS display_name,
         '/tasks/' || array_to_string(id_chain, '/') AS path,
         sha256(array_to_string(id_chain, '::') || '::' || messages_hash) AS task_id,
         conv_id % 4 <> 3 AS has_validator,
         first_role <> 'system' AS registered,
         first_role <> 'system' OR last_role = 'assistant' AS known
  FROM chains
),
registry AS (SELECT * FROM fx_tasks WHERE registered),
old_registry AS (SELECT * FROM fx_tasks WHERE known),
drawn AS (
  SELECT event_id, ts, event_type = 'error' AS failed, value,
         (user_id * 7 + event_id) % n_conv AS conv_id,
         event_id % n_doc AS doc_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS drawn
  FROM events, counts
),
shifted AS (
  SELECT *, CASE WHEN (conv_id + drawn) % 6 = 5 THEN (drawn + 1) % 8 ELSE drawn END AS mi FROM drawn
),
fx_attempts AS (
  SELECT e.event_id, e.doc_id, t.task_id, t.messages_hash, m.model,
         CASE WHEN failed THEN '' ELSE d.text END AS output,
         round(e.value * 100) AS duration_ms,
         CASE WHEN failed THEN 'API timeout' END AS error,
         CASE WHEN failed THEN 'none' WHEN l.quality IS NOT NULL THEN 'scored'
              WHEN e.doc_id % 3 = 0 THEN 'none' ELSE 'pending' END AS kind,
         l.quality, l.toxic, e.ts
  FROM shifted e
  JOIN fx_tasks t ON t.conv_id = e.conv_id
  JOIN fx_models m ON m.position = e.mi
  JOIN documents d ON d.doc_id = e.doc_id
  LEFT JOIN labels l ON l.doc_id = e.doc_id
),
flat AS (
  SELECT event_id, ts, sha256(task_id || '::' || model) AS execution_id, task_id, messages_hash, model,
         output, duration_ms, error,
         CASE WHEN kind = 'scored' THEN quality = 1 AND toxic = 0 END AS validation_passed,
         CASE WHEN kind = 'scored' AND quality = 0 THEN 0.0::DOUBLE
              WHEN kind = 'scored' AND toxic = 1 THEN 0.5::DOUBLE
              WHEN kind = 'scored' THEN 1.0::DOUBLE
              WHEN kind = 'pending' THEN 0.0::DOUBLE END AS validation_score,
         CASE WHEN kind = 'scored' AND quality = 0 THEN 'low quality' END AS validation_reason,
         CAST(NULL AS VARCHAR) AS validation_metadata,
         kind = 'pending' AS validation_pending,
         CASE WHEN kind = 'pending' THEN '{RUBRIC}' END AS validation_rubric,
         '{{"temperature": 0.0}}' AS run_config
  FROM fx_attempts
),
fx_runs AS (
  SELECT * EXCLUDE (ts, first_ts), strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at
  FROM (SELECT *, min(ts) OVER (PARTITION BY execution_id) AS first_ts FROM flat)
  QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY ts DESC, event_id DESC) = 1
),
fx_grades AS (
  SELECT execution_id,
         ['p', 'half', 'F', 's', ' 1 ', 'zzz'][event_id % 6 + 1] AS token,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'see event ' || event_id END AS reason,
         CAST([1.0, 0.5, 0.0, NULL, 1.0, NULL][event_id % 6 + 1] AS DOUBLE) AS score,
         ['graded', 'graded', 'graded', 'skipped', 'graded', 'invalid'][event_id % 6 + 1] AS outcome
  FROM fx_runs
),
fx_requests AS (
  SELECT [string_split(model, '/')[-1], upper(model), 'm' || position || '_or', 'M' || position, 'model-',
          regexp_replace(model, '/[^/]*$', ''), 'nope-' || position][event_id % 7 + 1] AS name
  FROM events JOIN fx_models ON position = event_id % 10
),
aliases AS (
  SELECT alias, arg_max(model, position) AS model
  FROM (SELECT position, model, unnest([lower(model), lower(string_split(model, '/')[-1]), lower(enum_name)]) AS alias FROM fx_models)
  GROUP BY alias
),
resolved AS (
  SELECT name,
         coalesce((SELECT model FROM aliases WHERE alias = lower(name)),
                  (SELECT CASE WHEN count(*) = 1 THEN max(model) END FROM aliases WHERE starts_with(alias, lower(name)))) AS model
  FROM (SELECT DISTINCT name FROM fx_requests)
),
orphans AS (
  SELECT DISTINCT task_id FROM fx_runs WHERE task_id NOT IN (SELECT task_id FROM registry)
)
"""

_RUN_COLUMNS = """execution_id, task_id, messages_hash, model, output, duration_ms, error, validation_passed,
  validation_score, validation_reason, validation_metadata, validation_pending, validation_rubric, run_config, created_at"""

_SINGLE = r"regexp_full_match(chain, 'cat_1::.*', 's')"
_DOUBLE_STAR = r"regexp_full_match(chain, 'cat_0::(?:[^:]+::)*conv_[^:]*[02468]')"
_SEVERAL = r"""(regexp_full_match(chain, 'cat_2::conv_.', 's')
  OR regexp_full_match(chain, '(?:[^:]+::)*grp_[1-3]::[^:]+')
  OR regexp_full_match(chain, 'cat_[^012]::.*', 's'))"""

_TOTALS = """count(*) AS total_runs,
  CAST(sum(CASE WHEN validation_passed THEN 1 ELSE 0 END) AS BIGINT) AS passed,
  100.0::DOUBLE * sum(CASE WHEN validation_passed THEN 1 ELSE 0 END) / count(*) AS pass_rate,
  avg(validation_score) AS avg_score"""

_BY_MODEL = f"""model, string_split(model, '/')[-1] AS model_name, {_TOTALS}, avg(duration_ms) AS avg_duration_ms"""

_DISPLAY = """t.display_name, r.task_id, r.model, r.validation_passed, r.validation_score, r.duration_ms,
  t.chain AS id_chain"""


def _validated(passed: str, score: str, reason: str, pending: str = "FALSE", rubric: str = "NULL") -> str:
    """Run rows with a new validation, NULL for failed runs and tasks without a validator."""
    has = "r.error IS NULL AND t.has_validator"
    return f"""SELECT execution_id, error,
      CASE WHEN {has} THEN {passed} END AS validation_passed,
      CASE WHEN {has} THEN {score} END AS validation_score,
      CASE WHEN {has} THEN {reason} END AS validation_reason,
      coalesce({has} AND {pending}, FALSE) AS validation_pending,
      CASE WHEN {has} THEN {rubric} END AS validation_rubric
    FROM fx_runs r JOIN fx_tasks t USING (task_id)"""


# the first rule: one of its own, of its group, of its category, or none
_WORD = "CASE WHEN conv_id % 4 = 0 THEN ['the', 'an', 'of'][conv_id % 3 + 1] WHEN len(id_chain) = 3 THEN 'the' END"
_BY_HAND = "len(id_chain) = 2 AND id_chain[1] = 'cat_1'"

# what is left after grades and a prune
_KEPT_RUNS = """(SELECT r.* REPLACE (
    CASE WHEN g.score IS NULL THEN r.validation_passed ELSE g.score = 1.0 END AS validation_passed,
    coalesce(g.score, r.validation_score) AS validation_score,
    r.validation_pending AND g.score IS NULL AS validation_pending)
  FROM fx_runs r JOIN fx_grades g USING (execution_id) WHERE r.task_id IN (SELECT task_id FROM registry))"""

_QUERIES = {
    "maintained_by_model": f"""SELECT {_BY_MODEL} FROM {_KEPT_RUNS} WHERE error IS NULL
      GROUP BY model ORDER BY avg_score DESC, model""",
    "maintained_by_task": f"""SELECT t.display_name, r.task_id, {_TOTALS}
      FROM {_KEPT_RUNS} r LEFT JOIN registry t ON r.task_id = t.task_id
      WHERE r.error IS NULL AND lower(r.model) LIKE '%model-%'
        AND r.task_id IN (SELECT task_id FROM registry WHERE {_DOUBLE_STAR})
      GROUP BY t.display_name, r.task_id ORDER BY avg_score DESC, r.task_id""",
    "maintained_counts": f"""SELECT (SELECT count(*) FROM registry) AS tasks, count(*) AS runs, count(error) AS errors,
        count(*) FILTER (validation_pending AND error IS NULL) AS pending FROM {_KEPT_RUNS}""",
    "validate_rule_table": _validated(
        f"contains(output, {_WORD})",
        f"CASE WHEN contains(output, {_WORD}) THEN 1.0::DOUBLE WHEN {_WORD} IS NOT NULL OR {_BY_HAND} THEN 0.0::DOUBLE END",
        f"CASE WHEN contains(output, {_WORD}) THEN NULL WHEN conv_id % 4 = 0 THEN 'Missing ''' || {_WORD} || '''' WHEN len(id_chain) = 3 THEN 'not found' END",
        pending=_BY_HAND,
        rubric=f"CASE WHEN {_BY_HAND} THEN '{RUBRIC}' END",
    ),
    "match_rule_table": """SELECT task_id, conv_id AS rule, chain AS pattern FROM fx_tasks WHERE conv_id % 4 = 0
      UNION ALL SELECT task_id, 1000000000000 + CAST(substr(id_chain[2], 5) AS BIGINT), '**::' || id_chain[2] || '::**' FROM fx_tasks WHERE len(id_chain) = 3
      UNION ALL SELECT task_id, 2000000000000, 'cat_1::conv_*' FROM fx_tasks WHERE len(id_chain) = 2 AND id_chain[1] = 'cat_1'""",
    "messages_hashes": "SELECT conv_id, messages_hash FROM fx_tasks",
    "task_ids": "SELECT conv_id, task_id, display_name FROM fx_tasks",
    "execution_ids": """SELECT task_id, model, sha256(task_id || '::' || model) AS execution_id
      FROM fx_tasks CROSS JOIN fx_models""",
    "task_list": """SELECT chain, has_validator, CAST(n_messages AS INTEGER) AS messages FROM fx_tasks ORDER BY id_chain""",
    "task_tree": """SELECT array_to_string(node, '::') AS chain, CAST(len(node) AS INTEGER) AS depth, node[-1] AS name,
        count(*) > count(*) FILTER (len(node) = len(id_chain)) AS is_branch,
        count(*) AS tasks,
        count(*) FILTER (len(node) = len(id_chain)) AS own_tasks,
        count(*) FILTER (len(node) = len(id_chain) AND has_validator) AS own_validators
      FROM (SELECT id_chain, has_validator, id_chain[1:unnest(range(1, len(id_chain) + 1))] AS node FROM fx_tasks)
      GROUP BY node ORDER BY node""",
    "glob_single": f"SELECT chain FROM fx_tasks WHERE {_SINGLE}",
    "glob_double_star": f"""SELECT chain AS id_chain, {_DOUBLE_STAR} AS even, TRUE AS everything,
      regexp_full_match(chain, '(?:[^:]+::)*grp_2(?:::[^:]+)*') AS in_group FROM fx_tasks""",
    "glob_any": f"SELECT task_id, chain AS id_chain FROM fx_tasks WHERE {_SEVERAL}",
    "upsert_tasks": f"""SELECT task_id, chain AS id_chain, display_name, '/moved' || path AS path, messages_hash,
        CASE WHEN known THEN '{REGISTERED_AT}.000000' ELSE '{STAMP}.000000' END AS created_at,
        '{STAMP}.000000' AS updated_at
      FROM fx_tasks""",
    "parse_prompts": "SELECT conv_id, 'conv_' || conv_id AS id, turn, role, text AS content FROM conversations",
    "parse_errors": """SELECT conv_id,
        CASE WHEN conv_id % 6 = 5 THEN 'conv_' || conv_id END AS id,
        CASE conv_id % 6 WHEN 0 THEN 'unknown header' WHEN 1 THEN 'unknown header' WHEN 2 THEN 'invalid id'
             WHEN 3 THEN 'unsupported frontmatter' WHEN 4 THEN 'unsupported frontmatter' END AS parse_error,
        CASE WHEN conv_id % 6 = 5 THEN n_messages ELSE 0 END AS messages
      FROM fx_tasks""",
    "discover_tasks": """SELECT path, chain AS id_chain, has_validator, task_id, CAST(n_messages AS INTEGER) AS messages
      FROM fx_tasks""",
    "tree_problems": """SELECT DISTINCT id_chain[1] || '/' || id_chain[2] AS directory, 'missing description' AS kind
      FROM fx_tasks WHERE len(id_chain) = 3""",
    "existing_executions": """SELECT execution_id FROM fx_runs JOIN registry USING (task_id)""",
    "missing_executions": """SELECT t.task_id, m.model, sha256(t.task_id || '::' || m.model) AS execution_id,
        t.chain AS id_chain, CAST(t.n_messages AS INTEGER) AS messages, t.last_text AS last_message
      FROM fx_tasks t CROSS JOIN fx_models m
      WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE r.task_id = t.task_id AND r.model = m.model)""",
    "cache_counts": """SELECT tasks, models, tasks * models AS planned, runs AS cached, tasks * models - runs AS missing
      FROM (SELECT (SELECT count(*) FROM fx_tasks) AS tasks, (SELECT count(*) FROM fx_models) AS models,
                   (SELECT count(*) FROM fx_runs) AS runs)""",
    "resolve_models": """SELECT name, r.model, count(*) AS requests
      FROM fx_requests JOIN resolved r USING (name) GROUP BY name, r.model""",
    "unresolved_models": """SELECT name,
        (SELECT string_agg(short, ',' ORDER BY short) FROM (SELECT DISTINCT string_split(model, '/')[-1] AS short FROM fx_models)) AS available
      FROM resolved WHERE model IS NULL""",
    "upsert_runs": f"SELECT {_RUN_COLUMNS} FROM fx_runs",
    "migrate_old_runs": """SELECT execution_id, validation_passed, validation_score, FALSE AS validation_pending,
        CAST(NULL AS VARCHAR) AS validation_rubric FROM fx_runs""",
    "task_runs_by_model_eq": f"SELECT {_RUN_COLUMNS} FROM fx_runs WHERE model = '{MODEL_NAMES[3]}' ORDER BY created_at DESC",
    "task_runs_by_task_eq": f"""SELECT {_RUN_COLUMNS} FROM fx_runs
      WHERE task_id = (SELECT min(task_id) FROM fx_tasks) ORDER BY created_at DESC""",
    "model_like": "SELECT model, count(*) AS runs FROM fx_runs WHERE lower(model) LIKE '%model_%' GROUP BY model",
    "summary_by_model": f"""SELECT {_BY_MODEL} FROM fx_runs WHERE error IS NULL
      GROUP BY model ORDER BY avg_score DESC, model""",
    "summary_by_model_filtered": f"""SELECT {_BY_MODEL} FROM fx_runs
      WHERE error IS NULL AND lower(model) LIKE '%model_%' AND task_id IN (
        SELECT task_id FROM registry WHERE {_SINGLE} OR regexp_full_match(chain, '(?:[^:]+::)*grp_0::[^:]+'))
      GROUP BY model ORDER BY avg_score DESC, model""",
    "summary_by_task": f"""SELECT t.display_name, r.task_id, {_TOTALS}
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id WHERE r.error IS NULL
      GROUP BY t.display_name, r.task_id ORDER BY avg_score DESC, r.task_id""",
    "summary_by_task_filtered": f"""SELECT t.display_name, r.task_id, {_TOTALS}
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id
      WHERE r.error IS NULL AND lower(r.model) LIKE '%model-%'
        AND r.task_id IN (SELECT task_id FROM registry WHERE {_DOUBLE_STAR})
      GROUP BY t.display_name, r.task_id ORDER BY avg_score DESC, r.task_id""",
    "runs_display": f"""SELECT coalesce(t.display_name, left(r.task_id, 8)) AS name,
        string_split(r.model, '/')[-1] AS model_name, {_DISPLAY}
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id
      WHERE r.error IS NULL ORDER BY t.display_name, r.model""",
    "runs_display_filtered": f"""SELECT {_DISPLAY}
      FROM fx_runs r JOIN registry t ON r.task_id = t.task_id
      WHERE r.error IS NULL AND lower(r.model) LIKE '%model_%' AND {_SEVERAL}
      ORDER BY t.display_name, r.model""",
    "export_rows": """SELECT t.display_name AS task, CAST(t.id_chain AS VARCHAR) AS id_chain, r.model, validation_passed,
        validation_score, validation_reason, duration_ms, error, created_at
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id ORDER BY t.display_name, r.model""",
    "db_stats": """SELECT (SELECT count(*) FROM registry) AS tasks, count(*) AS runs, count(error) AS errors,
        count(*) FILTER (validation_pending AND error IS NULL) AS pending FROM fx_runs""",
    "runs_per_model": """SELECT model, string_split(model, '/')[-1] AS model_name, count(*) AS runs
      FROM fx_runs GROUP BY model ORDER BY count(*) DESC, model""",
    "outcome_tally": """SELECT
        count(*) FILTER (validation_score IS NOT NULL AND validation_passed) AS passed,
        count(*) FILTER (validation_score IS NOT NULL AND NOT coalesce(validation_passed, FALSE) AND NOT validation_pending) AS failed,
        count(*) FILTER (error IS NOT NULL) AS errors,
        count(*) FILTER (validation_score IS NULL AND error IS NULL) AS no_validation,
        count(*) FILTER (validation_pending) AS pending
      FROM flat""",
    "pending_grades": """SELECT r.execution_id, r.task_id, r.model, r.output, r.validation_rubric, r.created_at,
        t.display_name, t.chain AS id_chain, t.path
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id
      WHERE r.validation_pending = TRUE AND r.error IS NULL ORDER BY r.created_at""",
    "pending_by_model": """SELECT r.execution_id, r.model, t.display_name
      FROM fx_runs r LEFT JOIN registry t ON r.task_id = t.task_id
      WHERE r.validation_pending = TRUE AND r.error IS NULL AND contains(lower(r.model), 'org1/model_')""",
    "grade_tokens": "SELECT execution_id, token, reason, score, outcome FROM fx_grades",
    "apply_grades": """SELECT r.execution_id,
        CASE WHEN g.score IS NULL THEN r.validation_passed ELSE g.score = 1.0 END AS validation_passed,
        coalesce(g.score, r.validation_score) AS validation_score,
        CASE WHEN g.score IS NULL THEN r.validation_reason ELSE g.reason END AS validation_reason,
        r.validation_pending AND g.score IS NULL AS validation_pending
      FROM fx_runs r JOIN fx_grades g USING (execution_id)""",
    "grading_tally": """SELECT count(*) AS total, count(*) FILTER (outcome = 'graded') AS graded,
        count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'invalid') AS remaining
      FROM fx_runs r JOIN fx_grades g USING (execution_id) WHERE validation_pending AND error IS NULL""",
    "orphan_task_ids": "SELECT task_id FROM orphans",
    "orphan_report": """SELECT t.display_name, t.task_id, t.display_name AS name, count(r.execution_id) AS run_count
      FROM old_registry t LEFT JOIN fx_runs r USING (task_id)
      WHERE t.task_id IN (SELECT task_id FROM orphans) GROUP BY t.display_name, t.task_id""",
    "orphan_totals": """SELECT (SELECT count(*) FROM orphans) AS tasks,
        (SELECT count(*) FROM fx_runs WHERE task_id IN (SELECT task_id FROM orphans)) AS runs""",
    "prune_runs": """SELECT execution_id, task_id, model FROM fx_runs WHERE task_id NOT IN (SELECT task_id FROM orphans)""",
    "prune_tasks": """SELECT task_id, display_name FROM old_registry WHERE task_id NOT IN (SELECT task_id FROM orphans)""",
    "clean_errors": "SELECT execution_id, task_id, model FROM fx_runs WHERE error IS NULL",
    "clean_counts": "SELECT count(*) AS all_runs, count(error) AS error_runs FROM fx_runs",
    "validate_contains": _validated(
        "contains(output, 'the')",
        "CASE WHEN contains(output, 'the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "CASE WHEN NOT contains(output, 'the') THEN 'Missing ''the''' END",
    ),
    "validate_manual": _validated(
        "CASE WHEN len(id_chain) = 3 THEN contains(output, 'the') END",
        "CASE WHEN len(id_chain) = 3 AND contains(output, 'the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "CASE WHEN len(id_chain) = 3 AND NOT contains(output, 'the') THEN 'not found' END",
        pending="len(id_chain) = 2",
        rubric=f"CASE WHEN len(id_chain) = 2 THEN '{RUBRIC}' END",
    ),
    "validate_judge": """SELECT execution_id, error,
        CASE WHEN error IS NULL THEN (event_id % 11) / 10.0::DOUBLE > 0.5 END AS validation_passed,
        CASE WHEN error IS NULL THEN (event_id % 11) / 10.0::DOUBLE END AS validation_score,
        CAST(NULL AS VARCHAR) AS validation_reason, FALSE AS validation_pending,
        CAST(NULL AS VARCHAR) AS validation_rubric
      FROM fx_runs""",
    "validate_python": """SELECT execution_id, error AS error,
        validation_passed, validation_score, validation_reason, validation_pending, validation_rubric FROM (
      SELECT execution_id, len(id_chain) = 3 AS native, CASE WHEN r.error IS NULL AND length(r.output) % 5 <> 0 THEN r.output ELSE '' END AS text,
        r.error IS NULL AND t.has_validator AND len(id_chain) = 2 AND length(text) > 0 AND length(text) % 7 = 0 AS raised,
        CASE WHEN raised THEN 'bad length ' || length(text) ELSE r.error END AS error,
        CASE WHEN r.error IS NOT NULL OR NOT t.has_validator THEN NULL WHEN native THEN contains(text, 'the')
             WHEN raised THEN FALSE WHEN length(text) > 0 THEN length(text) % 2 = 0 END AS validation_passed,
        CASE WHEN r.error IS NOT NULL OR NOT t.has_validator THEN NULL WHEN native THEN CASE WHEN contains(text, 'the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
             WHEN raised OR length(text) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS validation_score,
        CASE WHEN r.error IS NOT NULL OR NOT t.has_validator THEN NULL WHEN native THEN CASE WHEN NOT contains(text, 'the') THEN 'not found' END
             WHEN raised THEN 'Validation error: bad length ' || length(text) END AS validation_reason,
        r.error IS NULL AND t.has_validator AND NOT native AND length(text) = 0 AS validation_pending,
        CASE WHEN r.error IS NULL AND t.has_validator AND NOT native AND length(text) = 0 THEN '"""
    + RUBRIC
    + """' END AS validation_rubric
      FROM fx_runs r JOIN fx_tasks t ON t.task_id = r.task_id)""",
    "clean_runs": "SELECT execution_id, task_id, model FROM fx_runs WHERE FALSE",
    "schema_versions": f"""SELECT 'before' AS state, arg_max('0.' || (event_id % 12) || '.' || (event_id % 5), event_id) AS version FROM events
      UNION ALL SELECT 'after', '{CURRENT_VERSION}'""",
    "export_chains": f"""SELECT conv_id, CAST(list_append(id_chain, [{_ODD}][conv_id % {len(ODD_IDS)} + 1]) AS VARCHAR) AS id_chain FROM fx_tasks""",
}

# Results with a three-valued flag show it as text.
_THREE_STATES = "SELECT * REPLACE (CAST(validation_passed AS VARCHAR) AS validation_passed) FROM"
_FLAGGED = (
    "upsert_runs",
    "migrate_old_runs",
    "task_runs_by_model_eq",
    "task_runs_by_task_eq",
    "runs_display",
    "runs_display_filtered",
    "export_rows",
    "apply_grades",
    "validate_contains",
    "validate_manual",
    "validate_judge",
    "validate_python",
    "validate_rule_table",
)

ORACLE = {
    name: f"{_VIEWS}{_THREE_STATES} ({text})" if name in _FLAGGED else f"{_VIEWS}{text}"
    for name, text in _QUERIES.items()
}
