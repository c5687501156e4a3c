"""evalspark: evaluation results of language models as Spark DataFrames."""

from evalspark.functions.globs import matches, matches_any
from evalspark.functions.identity import (
    chain_text,
    display_name,
    execution_id,
    message_count,
    messages_hash,
    messages_json,
    name_or_id,
    short_model,
    task_id,
    with_identity,
)
from evalspark.operators.cleanup import (
    clean_counts,
    clean_errors,
    clean_runs,
    orphan_report,
    orphan_run_counts,
    orphan_task_ids,
    orphan_totals,
    prune_runs,
    prune_tasks,
)
from evalspark.operators.grading import (
    apply_grades,
    grading_tally,
    read_grades,
    rejected_grades,
    token_outcome,
    token_score,
)
from evalspark.operators.migrations import (
    CURRENT_VERSION,
    Step,
    current_version,
    latest_version,
    migrate_runs,
    pending_steps,
    pending_upgrades,
    record_version,
    upgrade_history,
    upgrade_table,
)
from evalspark.operators.models import model_aliases, resolve_models, unresolved_models
from evalspark.operators.rules import filter_by_patterns, first_rules, match_patterns, validate_by_rules
from evalspark.operators.runs import (
    cache_counts,
    existing_executions,
    filter_tasks,
    matching_task_ids,
    missing_executions,
    missing_pairs,
    pending_count,
    pending_grades,
    planned_executions,
    runs_for_display,
    successful_runs,
    task_runs,
)
from evalspark.operators.upsert import (
    flatten_validation,
    latest_tasks,
    merge_runs,
    reduce_attempts,
    upsert_runs,
    upsert_tasks,
)
from evalspark.operators.validators import (
    Rule,
    contains,
    judge_outputs,
    manual,
    python,
    validate_outputs,
)
from evalspark.plans.summaries import (
    export_rows,
    outcome_tally,
    runs_per_model,
    store_counts,
    summary_by_model,
    summary_by_task,
    task_list,
    task_tree,
)
from evalspark.plans.totals import (
    changed_totals,
    merge_totals,
    run_totals,
    totals_by_model,
    totals_by_task,
    totals_counts,
    totals_per_model,
)
from evalspark.plans.workflows import plan_prune, plan_runs, results
from evalspark.sources.catalogue import DEFAULT_MODELS, model_catalogue
from evalspark.sources.prompts import parse_errors, parse_prompts
from evalspark.sources.tables import (
    empty_tables,
    initial_version,
    read_table,
    storage_size,
    write_csv,
    write_one_csv,
    write_run_buckets,
    write_table,
)
from evalspark.sources.tree import TreeError, build_tasks, scan_problems, scan_tree, tree_problems
from evalspark.streaming.changes import (
    begin_store,
    clean_store,
    delete_runs,
    drop_folded,
    fold_store,
    ingest_changes,
    keep_totals,
    prune_store,
    put_grades,
    put_runs,
    store_position,
    store_runs,
    store_totals,
)
from evalspark.streaming.ingest import current_runs, ingest_runs, log_position, read_attempts, read_log

__all__ = [name for name in dir() if not name.startswith("_")]
