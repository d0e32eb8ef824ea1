"""Queries of the comparison reports: records per rollout, totals per arm, two-arm tables, predictions against experts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepmill.functions import calls, text
from stepmill.functions.dims import ACTION_ENVIRONMENT, TOOLS
from stepmill.operators import classify, heldout, records
from stepmill.queries.core import ACTIONS, CHANGES, RO, SPLIT_CASE, ST, _rollouts, _split_name
from stepmill.queries.more import PLANNED, _planned
from stepmill.session import latest_steps, table

QUERIES, SQL = {}, {}
TOOL_LIST = ", ".join(f"'{t}'" for t in TOOLS)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COUNTS = {
    "model_actions": "model", "tool_invocations": "known", "tool_successes": "known AND ok", "json_valid": "model AND NOT inv", "registered": f"model AND coalesce(n IN ({TOOL_LIST}), false)", "schema_valid": "model AND tool IS NOT NULL AND status IS NULL",
    "interventions": "coalesce(controller_intervened, false)", "proposed": "model AND given", "agreements": "model AND given AND coalesce(n = executed_tool, false)", "generations": "model AND generated_tokens IS NOT NULL", "truncations": "model AND coalesce(generation_truncated, false)",
    "patch_attempts": "patch_step", "patch_successes": "patch_step AND ok",
}
RECORDS = f"""{ST}, {RO}, {ACTIONS}, m AS (SELECT *, coalesce(n <> '', false) AS given, coalesce(starts_with(action, 'invalid('), false) AS inv, coalesce(executed_tool IN ({TOOL_LIST}), false) AS known, coalesce(tool_success, false) AS ok, coalesce(executed_tool = 'apply_patch', false) AS patch_step,
  coalesce(intervention_reason <> 'final_verification', true) AS own FROM f), w AS (SELECT *, own AND (given OR inv) AS model FROM m),
 ps AS (SELECT rollout_id, count(*) AS steps, {', '.join(f'count_if({v}) AS {k}' for k, v in COUNTS.items())}, sum(CASE WHEN model THEN coalesce(generated_tokens, 0) ELSE 0 END)::BIGINT AS tokens,
  {', '.join(f"bool_or(own AND (coalesce(phase = '{p}', false) OR coalesce(previous_phase = '{p}', false))) AS reached_{p.lower()}" for p in ('UNDERSTAND', 'MODIFY', 'VERIFY'))},
  count_if(failure IN ('invalid_json', 'unknown_tool', 'schema_error', 'missing_argument')) AS protocol, count_if(failure = 'generation_truncated') AS truncated, count_if(failure = 'patch_parse_error') AS patch_parse, count_if(failure = 'git_apply_check_failed') AS patch_apply FROM w GROUP BY 1),
 rp AS (SELECT rollout_id, count(*) AS repeats FROM (SELECT rollout_id, executed_tool AS et, lag(executed_tool) OVER (PARTITION BY rollout_id ORDER BY step_index) AS prev FROM st WHERE executed_tool IN ({TOOL_LIST})) WHERE et = prev AND et IN ('list_files', 'search_code') GROUP BY 1),
 rc AS (SELECT ro.rollout_id, arm, patch, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('steps', 'repeats', 'tokens', *COUNTS, 'protocol', 'truncated', 'patch_parse', 'patch_apply'))}, {', '.join(f'coalesce({c}, false) AS {c}' for c in heldout.REACHED)}, {CHANGES} AS final_patch,
  CASE WHEN coalesce(host_test_result, test_result) IS NULL THEN 'not_executed' WHEN coalesce(host_test_result, test_result).passed THEN 'passed' WHEN regexp_matches(coalesce(coalesce(host_test_result, test_result).output, ''), '{ACTION_ENVIRONMENT.replace(chr(39), chr(39) * 2)}') THEN 'environment_error' ELSE 'failed_non_environment' END AS host_test
  FROM ro LEFT JOIN ps USING (rollout_id) LEFT JOIN rp USING (rollout_id)),
 lb AS (SELECT *, list_filter([CASE WHEN protocol > 0 THEN 'protocol_error' END, CASE WHEN truncated > 0 THEN 'generation_truncation' END, CASE WHEN patch_parse > 0 THEN 'patch_generation_error' END, CASE WHEN patch_apply > 0 OR (patch_attempts > 0 AND patch_successes = 0) THEN 'patch_application_error' END,
  CASE WHEN host_test = 'environment_error' THEN 'environment_error' END, CASE WHEN interventions > 0 OR repeats > 0 OR NOT reached_modify THEN 'planning_error' END, CASE WHEN NOT final_patch THEN 'no_patch' END], lambda x: x IS NOT NULL) AS fs FROM rc)"""


def _records(spark, d):
    facts = heldout.step_facts(table(spark, d, "steps"))
    s = latest_steps(facts, "executed_tool", "failure", *heldout.SUMS, *heldout.REACHED)
    return heldout.task_records(s, _rollouts(spark, d, "arm", "patch", "test_result", "host_test_result"))


SHOWN = ("steps", "repeats", "tokens", *COUNTS)


@query(f"""WITH {RECORDS} SELECT rollout_id, {', '.join(SHOWN)}, {', '.join(heldout.REACHED)}, final_patch, host_test, coalesce(fs[1], 'unknown') AS primary_failure, array_to_string(list_sort(fs), ',') AS failures FROM lb""")
def q_g8_heldout_tasks(spark, d):
    return _records(spark, d).select("rollout_id", *SHOWN, *heldout.REACHED, "final_patch", "host_test", "primary_failure", F.array_join("failures", ",").alias("failures"))


_RATE = lambda a, b: f"coalesce(sum({a}) / nullif(sum({b}), 0)::DOUBLE, 0)"
TOTALS = f"""{RECORDS}, tt AS (SELECT arm, count(*) AS trajectories, sum(model_actions)::BIGINT AS model_actions, {_RATE('json_valid', 'model_actions')} AS json_valid_rate, {_RATE('registered', 'model_actions')} AS registered_rate, {_RATE('schema_valid', 'model_actions')} AS schema_valid_rate, {_RATE('tool_successes', 'tool_invocations')} AS tool_success_rate,
  {_RATE('interventions', 'steps')} AS intervention_rate, {_RATE('agreements', 'proposed')} AS agreement_rate, {_RATE('repeats', 'model_actions')} AS repeat_rate, sum(steps) / count(*)::DOUBLE AS average_steps, {_RATE('tokens', 'generations')} AS average_generated_tokens, {_RATE('truncations', 'generations')} AS truncation_rate,
  {', '.join(f'count_if({c}) / count(*)::DOUBLE AS {c}_rate' for c in heldout.REACHED)}, count_if(patch_attempts > 0) / count(*)::DOUBLE AS patch_attempt_rate, count_if(patch_successes > 0) / count(*)::DOUBLE AS valid_patch_rate, {_RATE('patch_successes', 'patch_attempts')} AS patch_success_rate, count_if(final_patch) / count(*)::DOUBLE AS final_patch_rate FROM lb GROUP BY 1)"""


@query(f"WITH {TOTALS} SELECT * FROM tt")
def q_g7_heldout_totals(spark, d):
    return heldout.totals(_records(spark, d), ["arm"])


R1 = ("trajectories", "model_actions", "json_valid_rate", "registered_rate", "schema_valid_rate", "tool_success_rate", "intervention_rate", "agreement_rate", "repeat_rate", "average_steps", "average_generated_tokens", "truncation_rate", "reached_understand_rate", "reached_modify_rate", "reached_verify_rate", "patch_attempt_rate", "valid_patch_rate", "patch_success_rate", "final_patch_rate")


def _table_sql(ctes, source, columns, base="base", other="sft"):
    rows = ", ".join(f"{{'metric': '{c}', 'position': {i}, 'value': {c}::DOUBLE}}" for i, c in enumerate(columns))
    return f"WITH {ctes}, mr AS (SELECT arm, unnest([{rows}]) AS r FROM {source}) SELECT r.position AS position, r.metric AS metric, max(r.value) FILTER (arm = '{base}') AS base, max(r.value) FILTER (arm = '{other}') AS other, max(r.value) FILTER (arm = '{other}') - max(r.value) FILTER (arm = '{base}') AS delta FROM mr GROUP BY 1, 2"


@query(_table_sql(TOTALS, "tt", R1))
def q_r1_heldout_table(spark, d):
    """Metrics of the held-out report for two arms, in order."""
    return heldout.two_arms(heldout.metric_rows(heldout.totals(_records(spark, d), ["arm"]), "arm", R1), "base", "sft")


@query(f"""WITH {PLANNED} SELECT rollout_id, coalesce(attempted, false) AS attempted, coalesce(valid_patch, false) AS valid_patch, {CHANGES} AS final_patch, coalesce(repeats, 0)::BIGINT AS repeats, CASE WHEN coalesce(any_phase, false) THEN in_modify ELSE coalesce(attempted, false) END AS reached_modify,
 CASE WHEN coalesce(any_phase, false) THEN 'recorded_fsm_phase' ELSE 'tool_milestone_proxy' END AS reach_source, reason FROM pr""")
def q_g6_planning_tasks(spark, d):
    p, f = _planned(spark, d), lambda c: F.coalesce(c, F.lit(False))
    return p.select("rollout_id", f("attempted").alias("attempted"), f("valid_patch").alias("valid_patch"), text.has_changes(F.col("patch")).alias("final_patch"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.when(f("any_phase"), F.col("in_modify")).otherwise(f("attempted")).alias("reached_modify"), F.when(f("any_phase"), "recorded_fsm_phase").otherwise("tool_milestone_proxy").alias("reach_source"), "reason")


R2 = ("tasks", "success_rate", "patch_attempt_rate", "valid_patch_rate", "final_patch_rate", "repeated_task_rate", "environment_error", "planning_error", "patch_failed", "test_failed", "no_patch", "timeout")


@query(_table_sql(f"{PLANNED}, pt AS (SELECT arm, count(*) AS tasks, count_if(success) / count(*)::DOUBLE AS success_rate, count_if(attempted) / count(*)::DOUBLE AS patch_attempt_rate, count_if(valid_patch) / count(*)::DOUBLE AS valid_patch_rate, count_if({CHANGES}) / count(*)::DOUBLE AS final_patch_rate, count_if(repeats > 0) / count(*)::DOUBLE AS repeated_task_rate, {', '.join(f'count_if(reason = {chr(39)}{r}{chr(39)}) AS {r}' for r in R2[6:])} FROM pr GROUP BY 1)", "pt", R2))
def q_r2_planning_table(spark, d):
    n = F.count(F.lit(1))
    rate = lambda c: text.guarded_ratio(F.count_if(c), n)
    t = _planned(spark, d).groupBy("arm").agg(n.alias("tasks"), rate(F.col("success")).alias("success_rate"), rate(F.col("attempted")).alias("patch_attempt_rate"), rate(F.col("valid_patch")).alias("valid_patch_rate"), rate(text.has_changes(F.col("patch"))).alias("final_patch_rate"), rate(F.col("repeats") > 0).alias("repeated_task_rate"), *(F.count_if(F.col("reason") == r).alias(r) for r in R2[6:]))
    return heldout.two_arms(heldout.metric_rows(t, "arm", R2), "base", "sft")


@query(f"""WITH {RO}, {ST}, n AS (SELECT rollout_id, count(*) AS steps FROM st GROUP BY 1) SELECT arm, count_if(success AND {CHANGES}) / count(*)::DOUBLE AS repair_rate, count_if(coalesce(host_test_result, test_result).passed) / count(*)::DOUBLE AS test_pass_rate, sum(coalesce(steps, 0)) / count(*)::DOUBLE AS average_steps,
 coalesce(sum(token_usage.total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(token_usage.total_tokens), 0) / count(*)::DOUBLE AS average_tokens FROM ro LEFT JOIN n USING (rollout_id) GROUP BY 1""")
def q_r3_evaluation(spark, d):
    """The aggregate table of the evaluation report."""
    # a step may arrive more than once, so steps are counted by their index
    steps = table(spark, d, "steps").groupBy("rollout_id", "step_index").agg(F.lit(1).alias("one")).groupBy("rollout_id").agg(F.count(F.lit(1)).alias("steps"))
    r = _rollouts(spark, d, "arm", "success", "patch", "test_result", "host_test_result", "token_usage").join(steps, "rollout_id", "left")
    n, tokens = F.count(F.lit(1)), F.coalesce(F.sum("token_usage.total_tokens"), F.lit(0))
    return r.groupBy("arm").agg(text.guarded_ratio(F.count_if(F.col("success") & text.has_changes(F.col("patch"))), n).alias("repair_rate"), text.guarded_ratio(F.count_if(F.coalesce("host_test_result", "test_result")["passed"]), n).alias("test_pass_rate"), text.guarded_ratio(F.sum(F.coalesce("steps", F.lit(0))), n).alias("average_steps"), tokens.alias("total_tokens"), text.guarded_ratio(tokens, n).alias("average_tokens"))


# ---- predictions against experts -----------------------------------------------------------------------------------

EXPERT = """ex AS (SELECT lower(trim(instance_id)) AS instance, min(traj_id) AS traj_id FROM trajectories WHERE len(steps) > 0 AND trim(coalesce(instance_id, '')) <> '' GROUP BY 1),
 es AS (SELECT instance, unnest(range(len(steps))) AS step_index, unnest(steps) AS e FROM ex JOIN trajectories USING (traj_id))"""
PREDICTED = f"""{ST}, {RO}, {ACTIONS}, {EXPERT}, pp AS (SELECT arm, f.n AS proposed, status, tool, e.tool AS teacher, e.phase AS phase FROM f JOIN ro USING (rollout_id) JOIN es ON lower(trim(ro.instance_id)) = es.instance AND f.step_index = es.step_index WHERE f.n <> '')"""


def _predictions(spark, d):
    """Proposed calls beside the expert's call at the same place of the same instance; the expert is its trajectory of the least id."""
    t = table(spark, d, "trajectories").filter("size(steps) > 0 AND trim(instance_id) <> ''").select(F.lower(F.trim("instance_id")).alias("instance"), "traj_id", F.transform("steps", lambda s: F.struct(s["tool"].alias("tool"), s["phase"].alias("phase"))).alias("steps"))
    e = t.groupBy("instance").agg(F.min_by("steps", "traj_id").alias("steps")).select("instance", F.posexplode("steps").alias("step_index", "e")).select("instance", "step_index", F.col("e.tool").alias("teacher"), F.col("e.phase").alias("expert_phase"))
    s = classify.arguments_status(table(spark, d, "steps"), "action", "model_proposed_tool").withColumn("proposed", text.normal_name(F.col("model_proposed_tool"))).withColumn("tool", text.tool_of(F.col("model_proposed_tool")))
    s = latest_steps(s, "proposed", "tool", "arguments_status").filter("proposed <> ''")
    r = _rollouts(spark, d, "arm", "instance_id").select("rollout_id", "arm", F.lower(F.trim("instance_id")).alias("instance"))
    return s.join(r, "rollout_id").join(e, ["instance", "step_index"])


@query(f"WITH {PREDICTED} SELECT arm, phase AS expert_phase, teacher, proposed, count(*) AS n FROM pp GROUP BY 1, 2, 3, 4")
def q_j5_predictions(spark, d):
    return _predictions(spark, d).groupBy("arm", "expert_phase", "teacher", "proposed").agg(F.count(F.lit(1)).alias("n"))


R4 = ("predictions", "registered_rate", "schema_valid_rate", "phase_compatible_rate", "teacher_agreement_rate")
_PHASES = "CASE phase WHEN 'LOCATE' THEN tool IN ('list_files','search_code') WHEN 'UNDERSTAND' THEN tool IN ('read_file','search_code') WHEN 'MODIFY' THEN tool = 'apply_patch' WHEN 'VERIFY' THEN tool = 'run_test' ELSE false END"


@query(_table_sql(f"{PREDICTED}, pa AS (SELECT arm, count(*) AS predictions, count_if(proposed IN ({TOOL_LIST})) / count(*)::DOUBLE AS registered_rate, count_if(tool IS NOT NULL AND status IS NULL) / count(*)::DOUBLE AS schema_valid_rate, count_if({_PHASES}) / count(*)::DOUBLE AS phase_compatible_rate, count_if(tool = teacher) / count(*)::DOUBLE AS teacher_agreement_rate FROM pp GROUP BY 1)", "pa", R4))
def q_r4_static_table(spark, d):
    """Metrics of the static report: proposed calls against the registry, their schema, the expert's phase and its tool."""
    n = F.count(F.lit(1))
    rate = lambda c: text.guarded_ratio(F.count_if(c), n)
    t = _predictions(spark, d).groupBy("arm").agg(n.alias("predictions"), rate(F.col("proposed").isin(*TOOLS)).alias("registered_rate"), rate(F.col("tool").isNotNull() & F.col("arguments_status").isNull()).alias("schema_valid_rate"), rate(calls.phase_allows(F.col("expert_phase"), F.col("tool"))).alias("phase_compatible_rate"), rate(F.col("tool") == F.col("teacher")).alias("teacher_agreement_rate"))
    return heldout.two_arms(heldout.metric_rows(t, "arm", R4), "base", "sft")


@query(f"""SELECT position, concat_ws(' | ', '| ' || metric, coalesce(printf('%.4f', base), '-'), coalesce(printf('%.4f', other), '-'), coalesce(printf('%.4f', delta), '-') || ' |') AS line FROM ({_table_sql(TOTALS, "tt", R1)})""")
def q_r5_comparison_lines(spark, d):
    return heldout.comparison_lines(q_r1_heldout_table(spark, d), {})


@query(f"""WITH t AS (SELECT traj_id, {SPLIT_CASE} AS sp, steps FROM trajectories), c AS (SELECT *, coalesce(len(steps), 0) AS n, len(list_filter(steps, lambda s: NOT coalesce(s.tool_success, false))) AS failed, len(list_filter(steps, lambda s: trim(coalesce(s.observation, ''), E' \\n\\t') = '')) AS blank FROM t),
 a AS (SELECT coalesce(CASE WHEN n = 0 THEN 'schema_invalid' WHEN coalesce(sp NOT IN ('train', 'validation'), true) THEN 'split_mismatch' WHEN failed > 0 THEN 'tool_error' WHEN blank > 0 THEN 'observation_not_real' END, 'aligned') AS status,
  coalesce(len(list_filter(steps, lambda s: s.tool = 'apply_patch')), 0) AS actions, coalesce(list_max([(length(s.arguments) + 3) // 4 for s in steps if s.tool = 'apply_patch']), 0) AS tokens FROM c)
SELECT status, count(*) AS trajectories, sum(actions)::BIGINT AS patch_actions, max(tokens)::BIGINT AS max_target_tokens FROM a GROUP BY 1""")
def q_g19_alignment_report(spark, d):
    """Trajectories by what became of them, their patch actions and the longest target in tokens (estimated)."""
    patches = F.filter(F.coalesce("steps", F.array()), lambda s: s["tool"] == "apply_patch")
    t = table(spark, d, "trajectories").select(F.coalesce(records.expert_status(F.col("steps"), _split_name(F.col("split"))), F.lit("aligned")).alias("status"), F.size(patches).alias("actions"), F.coalesce(F.array_max(F.transform(patches, lambda s: text.token_estimate(s["arguments"]))), F.lit(0)).alias("tokens"))
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("trajectories"), F.sum("actions").alias("patch_actions"), F.max("tokens").alias("max_target_tokens"))
