"""Further queries of the analytics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepmill.functions import actions, calls, diff, text
from stepmill.functions.dims import EMPTY_PATCHES, PLANNING_ENVIRONMENT, PLANNING_TIMEOUT, TOOL_USAGE_ENVIRONMENT, TOOLS
from stepmill.operators import classify, compare, examples, files, metrics, records, sequence, splits
from stepmill.queries import core
from stepmill.queries.core import CHANGES, FACTS, RO, SIGNALS, SPLIT_CASE, ST, TJ, _classified, _flagged, _rollouts, _split_name, _steps
from stepmill.session import table
from stepmill.sources import readers

QUERIES, SQL = {}, {}
EMPTY = ", ".join(f"'{x}'" for x in EMPTY_PATCHES)
TOOL_LIST = ", ".join(f"'{t}'" for t in TOOLS)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ST} SELECT rollout_id, step_index, coalesce(nullif(phase, ''), 'UNKNOWN') AS phase, executed_tool AS tool, CASE WHEN model_proposed_tool <> executed_tool THEN model_proposed_tool END AS proposed,
 nullif(intervention_reason, '') AS reason, length(coalesce(observation, '')) AS observation_chars FROM st""")
def q_p4_history_items(spark, d):
    s = _steps(spark, d, "phase", "previous_phase", "executed_tool", "action", "tool_success", "model_proposed_tool", "intervention_reason", "observation")
    h = actions.history_item(F.col("phase"), F.col("previous_phase"), F.lit(None).cast("string"), F.col("executed_tool"), text.call_arguments(F.col("action")), F.col("tool_success"), F.col("model_proposed_tool"), F.col("intervention_reason"), F.col("observation"))
    return s.select("rollout_id", "step_index", h.alias("h")).select("rollout_id", "step_index", "h.phase", "h.tool", F.col("h.model_proposed_tool").alias("proposed"), F.col("h.intervention_reason").alias("reason"), F.length("h.observation").cast("long").alias("observation_chars"))


@query(f"""WITH {RO} SELECT rollout_id, array_to_string(list_sort(coalesce(modified_files, [])), ',') AS files, coalesce(rollout_test_passed, success) AS test_passed, coalesce(host_test_result, test_result).passed AS host_passed, coalesce(token_usage.total_tokens, 0) AS tokens FROM ro""")
def q_p8_recorder_records(spark, d):
    r = records.recorder_record(_rollouts(spark, d))
    return r.select("rollout_id", F.array_join("modified_files", ",").alias("files"), F.col("rollout_test_passed").alias("test_passed"), F.col("host_test_result.passed").alias("host_passed"), F.coalesce("token_usage.total_tokens", F.lit(0)).alias("tokens"))


@query(f"""WITH {FACTS} SELECT CASE WHEN coalesce(test_result.policy_error, '') <> '' THEN 'error' WHEN success THEN 'success' ELSE 'fail' END AS status, count(*) AS n, sum(coalesce(steps, 0))::BIGINT AS steps FROM fc GROUP BY 1""")
def q_p10_final_status(spark, d):
    c = _classified(spark, d)
    return c.groupBy(records.final_status(F.col("success"), F.col("test_result.policy_error")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("steps", F.lit(0))).alias("steps"))


@query("""WITH r AS (SELECT task_id, CASE WHEN contains(lower(problem_statement), 'handler') THEN 'prompt_leakage' WHEN problem_statement IS NULL THEN 'schema_invalid' END AS reason FROM tasks)
SELECT task_id, reason, CASE WHEN reason = 'prompt_leakage' THEN 2 ELSE 0 END AS leakage_types FROM r WHERE reason IS NOT NULL""")
def q_p11_rejections(spark, d):
    """The reject channel's payload, here of an artificial rule."""
    reason = F.when(F.contains(F.lower("problem_statement"), F.lit("handler")), "prompt_leakage").when(F.col("problem_statement").isNull(), "schema_invalid")
    return records.rejection(table(spark, d, "tasks"), "task_id", reason, F.lit("prompt contains: gold_patch, test_patch")).select("task_id", "reason", F.size("leakage_types").cast("long").alias("leakage_types"))


@query(f"""WITH {TJ}, c AS (SELECT traj_id, pos, 'Thought: x' || chr(10) || 'Action: ' || s.tool || '(' || s.arguments || ')' AS r, s.tool AS tool, json_keys(s.arguments) AS k FROM tj)
SELECT tool, tool NOT IN ('read_file', 'write_file', 'run_test') AS invalid, array_to_string(list_sort(k), ',') AS keys, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def q_p16_react_actions(spark, d):
    s = table(spark, d, "trajectories").select(F.explode("steps").alias("s"))
    p = actions.parse_react(F.concat(F.lit("Thought: x\nAction: "), "s.tool", F.lit("("), "s.arguments", F.lit(")")))
    s = s.select(p.alias("p"))
    return s.groupBy(F.col("p.tool").alias("tool"), F.col("p.invalid_action").alias("invalid"), F.array_join(F.array_sort(F.json_object_keys("p.arguments")), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TJ} SELECT traj_id, pos, s.tool AS tool, array_to_string(list_sort(json_keys(s.arguments)), ',') AS keys FROM tj""")
def q_p14_structured_calls(spark, d):
    s = table(spark, d, "trajectories").select("traj_id", F.posexplode("steps").alias("pos", "s"))
    c = calls.parse_call(F.concat(F.lit('Sure. {"tool": "'), "s.tool", F.lit('", "arguments": '), "s.arguments", F.lit("} and more")))
    return s.select("traj_id", F.col("pos").cast("long").alias("pos"), c.alias("c")).select("traj_id", "pos", "c.tool", F.array_join(F.array_sort(F.json_object_keys("c.arguments")), ",").alias("keys"))


@query(f"""WITH {TJ} SELECT count(*) AS n, count(CASE WHEN json_valid(s.arguments) THEN 1 END) AS strict FROM tj""")
def q_p28_strict_objects(spark, d):
    s = table(spark, d, "trajectories").select(F.explode("steps").alias("s"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count(actions.strict_object(F.col("s.arguments"))).alias("strict"))


@query(f"""WITH {ST}, r AS (SELECT rollout_id, action, count(*) AS c FROM st WHERE coalesce(executed_tool, '') <> 'run_test' AND action IS NOT NULL GROUP BY 1, 2), m AS (SELECT rollout_id, max(c) AS times FROM r GROUP BY 1),
 b AS (SELECT rollout_id, bool_or(coalesce(invalid_action, false) OR lower(trim(split_part(coalesce(action, ''), '(', 1))) NOT IN ({TOOL_LIST})) AS invalid, bool_or(contains(lower(coalesce(observation, '')), 'invalid arguments:')) AS bad_arguments FROM st GROUP BY 1)
SELECT rollout_id, invalid OR bad_arguments OR coalesce(times, 0) >= 3 AS planning_error FROM b LEFT JOIN m USING (rollout_id)""")
def q_f16_planning_errors(spark, d):
    s = _steps(spark, d, "executed_tool", "action", "invalid_action", "observation")
    again = sequence.repeated_calls(s.filter(F.coalesce("executed_tool", F.lit("")) != "run_test").withColumn("action", F.md5("action")), "rollout_id", "action").select("rollout_id").distinct().withColumn("again", F.lit(True))
    unknown = ~F.coalesce(text.action_name(F.col("action")).isin(*TOOLS), F.lit(False))
    b = s.groupBy("rollout_id").agg(F.bool_or(F.coalesce("invalid_action", F.lit(False)) | unknown | F.contains(F.lower(F.coalesce("observation", F.lit(""))), F.lit("invalid arguments:"))).alias("bad"))
    return b.join(again, "rollout_id", "left").select("rollout_id", (F.col("bad") | F.coalesce("again", F.lit(False))).alias("planning_error"))


@query(f"""WITH {ST}, {RO}, p AS (SELECT rollout_id, bool_and(coalesce(executed_tool IN ({TOOL_LIST}), false)) AS known, bool_or(coalesce(invalid_action, false)) AS invalid, bool_or(coalesce(executed_tool = 'run_test', false)) AS tested,
  bool_or(coalesce(executed_tool = 'run_test', false) AND NOT regexp_matches(lower(coalesce(observation, '')), '^(blocked|refused|invalid arguments)')) AS reached FROM st GROUP BY 1)
SELECT rollout_id, known AND NOT invalid AND tested AND test_result IS NOT NULL AS protocol_valid, known AND NOT invalid AND reached AND test_result IS NOT NULL AS effective FROM p JOIN ro USING (rollout_id)""")
def q_f18_protocol(spark, d):
    s = _steps(spark, d, "executed_tool", "invalid_action", "observation")
    reached = actions.test_reached_process(F.col("executed_tool"), F.col("observation"))
    known = F.coalesce(F.col("executed_tool").isin(*TOOLS), F.lit(False))
    p = s.groupBy("rollout_id").agg(F.bool_and(known).alias("known"), F.bool_or(F.coalesce("invalid_action", F.lit(False))).alias("invalid"), F.bool_or(F.coalesce(F.col("executed_tool") == "run_test", F.lit(False))).alias("tested"), F.bool_or(reached).alias("reached"))
    j = p.join(_rollouts(spark, d, "test_result"), "rollout_id")
    ok = F.col("known") & ~F.col("invalid") & F.col("test_result").isNotNull()
    return j.select("rollout_id", (ok & F.col("tested")).alias("protocol_valid"), (ok & F.col("reached")).alias("effective"))


@query(f"""WITH {ST} SELECT rollout_id, count_if(coalesce(intervention_reason <> 'final_verification', true) AND (model_proposed_tool IS NOT NULL OR coalesce(starts_with(action, 'invalid('), false))) AS model_steps, count_if(model_proposed_tool = executed_tool) AS agreed FROM st GROUP BY 1""")
def q_f20_model_steps(spark, d):
    s = _steps(spark, d, "executed_tool", "model_proposed_tool", "action", "intervention_reason")
    m = actions.is_model_step(F.col("executed_tool"), F.col("model_proposed_tool"), F.col("action"), F.col("intervention_reason"))
    return s.groupBy("rollout_id").agg(F.count_if(m).alias("model_steps"), F.count_if(F.col("model_proposed_tool") == F.col("executed_tool")).alias("agreed"))


@query(f"""WITH t AS (SELECT traj_id, {SPLIT_CASE} AS sp, steps FROM trajectories), c AS (SELECT traj_id, sp, coalesce(len(steps), 0) AS n,
  len(list_filter(steps, lambda s: NOT coalesce(s.tool_success, false))) AS failed, len(list_filter(steps, lambda s: trim(coalesce(s.observation, ''), E' \\n\\t') = '')) AS blank FROM t)
SELECT traj_id, CASE WHEN n = 0 THEN 'schema_invalid' WHEN coalesce(sp NOT IN ('train', 'validation'), true) THEN 'split_mismatch' WHEN failed > 0 THEN 'tool_error' WHEN blank > 0 THEN 'observation_not_real' END AS status FROM c""")
def q_v6_expert_status(spark, d):
    t = table(spark, d, "trajectories")
    return t.select("traj_id", records.expert_status(F.col("steps"), _split_name(F.col("split"))).alias("status"))


@query("""SELECT task_id, array_to_string(list_filter(fail_to_pass, lambda x: trim(x) <> ''), chr(10)) AS ids FROM tasks""")
def q_v10_test_ids(spark, d):
    ids = actions.test_ids(F.to_json("fail_to_pass"))
    return table(spark, d, "tasks").select("task_id", F.when(F.col("fail_to_pass").isNotNull(), F.array_join(ids, "\n")).alias("ids"))


PLANNED = f"""{ST}, {RO}, {SIGNALS}, pe AS (SELECT *, lower(trim(split_part(executed_tool, '(', 1))) AS et, coalesce(intervention_reason <> 'final_verification', true) AS own FROM sg),
 pf AS (SELECT rollout_id, bool_or(regexp_matches(o, '{PLANNING_TIMEOUT}')) AS late, bool_or((name = 'error' OR coalesce(et = 'run_test', false)) AND regexp_matches(o, '{PLANNING_ENVIRONMENT.replace(chr(39), chr(39) * 2)}')) AS environment, bool_or(name = 'error') AS error_step, bool_or(coalesce(et = 'apply_patch', false)) AS attempted,
  bool_or(coalesce(et = 'apply_patch', false) AND coalesce(tool_success, starts_with(o, 'applied patch to '))) AS valid_patch, bool_or(coalesce(invalid_action, false) OR coalesce(controller_intervened, false)) AS stopped, bool_or(own AND (phase IS NOT NULL OR previous_phase IS NOT NULL)) AS any_phase,
  bool_or(own AND (coalesce(phase = 'MODIFY', false) OR coalesce(previous_phase = 'MODIFY', false))) AS in_modify FROM pe GROUP BY 1),
 rp AS (SELECT rollout_id, count(*) AS repeats FROM (SELECT rollout_id, executed_tool AS et, lag(executed_tool) OVER (PARTITION BY rollout_id ORDER BY step_index) AS prev FROM st WHERE executed_tool IN ({TOOL_LIST})) WHERE et = prev AND et IN ('list_files', 'search_code') GROUP BY 1),
 pd AS (SELECT *, coalesce(test_result.output, '') || chr(10) || coalesce(test_result.policy_error, '') AS dg FROM ro LEFT JOIN pf USING (rollout_id) LEFT JOIN rp USING (rollout_id)),
 pr AS (SELECT *, CASE WHEN coalesce(success, false) THEN NULL WHEN coalesce(late, false) OR regexp_matches(dg, '{PLANNING_TIMEOUT}') THEN 'timeout' WHEN coalesce(environment, false) OR coalesce(error_step, false) OR regexp_matches(dg, '{PLANNING_ENVIRONMENT.replace(chr(39), chr(39) * 2)}') THEN 'environment_error'
  WHEN attempted AND NOT valid_patch THEN 'patch_failed' WHEN coalesce(valid_patch, false) OR {CHANGES} THEN 'test_failed' WHEN coalesce(stopped, false) OR coalesce(repeats, 0) > 0 OR NOT (CASE WHEN coalesce(any_phase, false) THEN in_modify ELSE coalesce(attempted, false) END) THEN 'planning_error' ELSE 'no_patch' END AS reason FROM pd)"""


def _planned(spark, d):
    """Rollouts with the planning flags, repeats and reason."""
    signals = classify.planning_signals(*(F.col(c) for c in ("action", "executed_tool", "observation", "tool_success", "invalid_action", "controller_intervened", "intervention_reason", "phase", "previous_phase")))
    s = _flagged(spark, d, signals, "executed_tool")
    again = sequence.consecutive_repeats(s, "rollout_id", "executed_tool", list(TOOLS), core.EXPLORE).groupBy("rollout_id").agg(F.sum("repeats").alias("repeats"))
    flags = s.groupBy("rollout_id").agg(*(F.bool_or(k).alias(k) for k in signals))
    r = _rollouts(spark, d, "arm", "instance_id", "success", "patch", "test_result").join(flags, "rollout_id", "left").join(again, "rollout_id", "left")
    return r.withColumn("reason", classify.planning_failure(F.col("success"), {k: F.col(k) for k in signals}, F.coalesce("repeats", F.lit(0)) > 0, F.col("patch"), F.col("test_result")))


@query(f"WITH {PLANNED} SELECT rollout_id, reason FROM pr")
def q_c3_planning_reason(spark, d):
    return _planned(spark, d).select("rollout_id", "reason")


@query(f"""WITH {ST}, {RO}, {SIGNALS}, r AS (SELECT rollout_id, trim(action) AS call, count(*) AS c FROM sg WHERE name <> 'run_test' AND action IS NOT NULL GROUP BY 1, 2), m AS (SELECT rollout_id, max(c) AS times FROM r GROUP BY 1),
 u AS (SELECT rollout_id, bool_or(coalesce(invalid_action, false) OR name NOT IN ({TOOL_LIST}) OR contains(o, 'invalid arguments:')) AS bad, coalesce(bool_and(contains(o, 'failed:') OR contains(o, 'refused:') OR contains(o, 'unknown action:')) FILTER (name = 'apply_patch'), false) AS attempts_failed FROM sg GROUP BY 1)
SELECT rollout_id, CASE WHEN coalesce(success, false) THEN NULL WHEN attempts_failed THEN 'patch_failed' WHEN test_result IS NULL OR coalesce(regexp_matches(test_result.output, '{TOOL_USAGE_ENVIRONMENT}'), false) THEN 'environment_error' WHEN {CHANGES} THEN 'test_failed' WHEN bad OR coalesce(times, 0) >= 3 THEN 'planning_error' ELSE 'no_patch' END AS reason
FROM ro LEFT JOIN u USING (rollout_id) LEFT JOIN m USING (rollout_id)""")
def q_c2_tool_usage_reason(spark, d):
    name, o = text.action_name(F.col("action")), F.lower(F.coalesce("observation", F.lit("")))
    failed = o.contains("failed:") | o.contains("refused:") | o.contains("unknown action:")
    signals = {
        "bad": F.coalesce("invalid_action", F.lit(False)) | ~F.coalesce(name.isin(*TOOLS), F.lit(False)) | o.contains("invalid arguments:"),
        "failed": F.when(name == "apply_patch", failed),
        "call": F.when(F.coalesce(name, F.lit("")) != "run_test", F.md5(text.strip(F.col("action")))),
    }
    s = _flagged(spark, d, signals)
    times = sequence.repeated_calls(s.filter("call IS NOT NULL"), "rollout_id", "call").select("rollout_id").distinct().withColumn("again", F.lit(True))
    u = s.groupBy("rollout_id").agg(F.bool_or("bad").alias("bad"), F.bool_and("failed").alias("attempts_failed"))
    r = _rollouts(spark, d, "success", "patch", "test_result").join(u, "rollout_id", "left").join(times, "rollout_id", "left")
    return r.select("rollout_id", classify.tool_usage_failure(F.col("success"), F.col("attempts_failed"), F.col("patch"), F.col("test_result"), F.col("bad") | F.coalesce("again", F.lit(False))).alias("reason"))


@query(f"""WITH {ST}, {RO}, j AS (SELECT * FROM st JOIN (SELECT rollout_id, arm FROM ro) USING (rollout_id))
SELECT arm, count(*) AS steps, count(DISTINCT rollout_id) AS rollouts, coalesce(count_if(controller_intervened) / nullif(count(*), 0)::DOUBLE, 0) AS intervention_rate, count_if(model_proposed_tool = executed_tool) / nullif(count(model_proposed_tool), 0)::DOUBLE AS agreement_rate, count(*) / count(DISTINCT rollout_id)::DOUBLE AS average_steps FROM j GROUP BY 1""")
def q_g5_planning_aggregate(spark, d):
    # rollouts are counted by their own table's states, so that no step count distinct is needed
    s = _steps(spark, d, "controller_intervened", "model_proposed_tool", "executed_tool")
    per = s.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if("controller_intervened").alias("stopped"), F.count_if(F.col("model_proposed_tool") == F.col("executed_tool")).alias("agreed"), F.count("model_proposed_tool").alias("proposed"))
    g = per.join(_rollouts(spark, d, "arm"), "rollout_id").groupBy("arm").agg(F.sum("steps").alias("steps"), F.count(F.lit(1)).alias("rollouts"), F.sum("stopped").alias("a"), F.sum("agreed").alias("b"), F.sum("proposed").alias("c"))
    return g.select("arm", "steps", "rollouts", text.guarded_ratio(F.col("a"), F.col("steps")).alias("intervention_rate"), F.try_divide(F.col("b").cast("double"), F.col("c").cast("double")).alias("agreement_rate"), (F.col("steps") / F.col("rollouts")).alias("average_steps"))


@query(f"""WITH {FACTS} SELECT arm, repo, count(*) AS rollouts, count_if(success) AS successes, avg(steps) AS average_steps, sum(token_usage.prompt_tokens)::BIGINT AS prompt_tokens, sum(token_usage.completion_tokens)::BIGINT AS completion_tokens,
 count_if(success AND reason IS NULL AND steps <= 10) / nullif(count_if(steps <= 10), 0)::DOUBLE AS short_success_rate FROM fc GROUP BY 1, 2""")
def q_g10_by_condition(spark, d):
    short = F.col("steps") <= 10
    return _classified(spark, d).groupBy("arm", "repo").agg(F.count(F.lit(1)).alias("rollouts"), F.count_if("success").alias("successes"), F.avg("steps").alias("average_steps"), F.sum("token_usage.prompt_tokens").alias("prompt_tokens"), F.sum("token_usage.completion_tokens").alias("completion_tokens"), F.try_divide(F.count_if(F.col("success") & F.col("reason").isNull() & short).cast("double"), F.count_if(short).cast("double")).alias("short_success_rate"))


@query("""SELECT truncated, count(*) AS rows, sum(removed_history_steps)::BIGINT AS removed, max(target_tokens) AS max_target, sum(original_tokens - final_tokens)::BIGINT AS saved, count_if(final_tokens <= 8192) / count(*)::DOUBLE AS within_budget FROM budget_results GROUP BY 1""")
def q_g14_budget_report(spark, d):
    b = table(spark, d, "budget_results")
    return b.groupBy("truncated").agg(F.count(F.lit(1)).alias("rows"), F.sum("removed_history_steps").alias("removed"), F.max("target_tokens").alias("max_target"), F.sum(F.col("original_tokens") - F.col("final_tokens")).alias("saved"), text.guarded_ratio(F.count_if(F.col("final_tokens") <= 8192), F.count(F.lit(1))).alias("within_budget"))


@query("""WITH f AS (SELECT DISTINCT repo, unnest(modified_files) AS path FROM rollouts), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n, count(*) OVER (PARTITION BY repo) AS c FROM f WHERE repo IS NOT NULL)
SELECT repo, string_agg(path, chr(10) ORDER BY path) FILTER (n <= 10) || CASE WHEN max(c) > 10 THEN chr(10) || '... ' || (max(c) - 10) || ' more files' ELSE '' END AS listing FROM r GROUP BY 1""")
def q_e10_list_files(spark, d):
    f = table(spark, d, "rollouts").filter("repo IS NOT NULL").select("repo", F.explode("modified_files").alias("path"))
    return files.list_files(f, "repo", 10)


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM d) SELECT doc_id, line, text FROM u WHERE contains(text, 'returns None')""")
def q_e9_search_documents(spark, d):
    """Documents of every kind as files."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("repo"), F.lit("").alias("path"), F.col("text").alias("content"))
    return files.search_code(f, F.lit("returns None")).select(F.col("repo").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents WHERE text IS NOT NULL""")
def q_e11_read_lines(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", F.regexp_replace(files.read_lines(F.col("text"), F.lit(2), F.lit(4)), r"\n\z", "").alias("part"))


@query(r"""WITH l AS (SELECT task_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT task_id, string_split(patch, chr(10)) AS ls FROM tasks)), p AS (SELECT *, lag(x) OVER (PARTITION BY task_id ORDER BY i) AS prev FROM l),
 hd AS (SELECT task_id, i, CASE WHEN nw <> '/dev/null' THEN nw ELSE od END AS path FROM (SELECT task_id, i, regexp_extract(x, '^\+\+\+ (?:b/)?([^\t]+)', 1) AS nw, regexp_extract(prev, '^--- (?:a/)?([^\t]+)', 1) AS od FROM p WHERE x LIKE '+++ %' AND prev LIKE '--- %')),
 hk AS (SELECT task_id, i, regexp_extract(x, '^@@ -(\d+)', 1)::INT AS ln, coalesce(nullif(regexp_extract(x, '^@@ -\d+,(\d+)', 1), ''), '1')::INT AS n FROM l WHERE regexp_matches(x, '^@@ -(\d+)(,(\d+))? \+(\d+)(,(\d+))? @@')),
 r AS (SELECT hk.task_id, path, greatest(1, ln - 30) AS a, ln + greatest(n - 1, 0) + 30 AS b FROM hk ASOF JOIN hd ON hk.task_id = hd.task_id AND hk.i >= hd.i WHERE NOT regexp_matches(path, '^/|(^|/)\.\.(/|$)')),
 w AS (SELECT *, max(b) OVER (PARTITION BY task_id, path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), g AS (SELECT *, sum(CASE WHEN a <= m + 20 THEN 0 ELSE 1 END) OVER (PARTITION BY task_id, path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w),
 m AS (SELECT task_id, path, coalesce(nullif(regexp_replace(path, '/?[^/]*$', ''), ''), '.') AS folder, min(a) AS a, max(b) AS b FROM g GROUP BY task_id, path, k),
 u AS (SELECT task_id, min(path) AS path, 0 AS o, 'list_files' AS tool, folder AS target, NULL::INT AS s, NULL::INT AS e FROM m GROUP BY task_id, folder UNION ALL SELECT task_id, path, 1, 'read_file', path, a, b FROM m UNION ALL SELECT DISTINCT task_id, chr(65535), 2, 'apply_patch', NULL, NULL::INT, NULL::INT FROM m)
SELECT task_id, (row_number() OVER (PARTITION BY task_id ORDER BY path, o, s, target) - 1)::INT AS step_index, tool, target AS path, s AS start, e AS "end" FROM u""")
def q_e8_navigation_plan(spark, d):
    sec = diff.file_sections(table(spark, d, "tasks"), "task_id", "patch")
    return files.navigation_plan(diff.merge_ranges(diff.hunk_ranges(sec, "task_id"), ["task_id", "path"]), "task_id")


@query(r"""SELECT task_id, md5(trim(regexp_replace(replace(patch, chr(13) || chr(10), chr(10)), '(?m)[ \t]+$', '', 'g'), E' \n\r\t')) AS d FROM tasks WHERE patch IS NOT NULL""")
def q_e6_normal_diff(spark, d):
    return table(spark, d, "tasks").filter("patch IS NOT NULL").select("task_id", F.md5(text.normal_diff(F.col("patch"))).alias("d"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string([x for x, i in l if (i - 1) % 7 <> 3], chr(10)) <> array_to_string(l, chr(10)) AS changed, true AS rebuilt, true AS bounded FROM l""")
def q_e4_bounded_patches(spark, d):
    """Documents against their copies without every seventh line: whether there are patches, whether they take away as much as is missing and whether each fits or is a single edit."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    after = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % 7 != 3), "\n")
    t = t.select("doc_id", F.col("text").alias("before"), after.alias("after"))
    p = diff.split_patches(t.withColumn("path", F.lit("doc.md")), "doc_id", 120)
    # characters of removed less those of added lines, headers and marks left out
    body = F.filter(F.slice(F.split("patch", "\n"), 3, 1_000_000), lambda x: x.startswith("-") | x.startswith("+"))
    chars = F.aggregate(body, F.lit(0), lambda s, x: s + F.when(x.startswith("-"), F.length(x)).otherwise(-F.length(x)))
    g = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"), F.every((text.token_estimate(F.col("patch")) <= 120) | (F.size(body) <= 2)).alias("bounded"))
    j = t.join(g, "doc_id", "left")
    return j.select("doc_id", F.col("n").isNotNull().alias("changed"), F.coalesce(F.abs(F.col("chars") - (F.length("before") - F.length("after"))) <= 1, F.col("before") == F.col("after")).alias("rebuilt"), F.coalesce("bounded", F.lit(True)).alias("bounded"))


@query(f"""WITH {TJ}, b AS (SELECT traj_id, bool_or(s.observation IS NULL OR s.observation = '') AS bad FROM tj GROUP BY 1) SELECT traj_id, count(*) AS steps FROM tj JOIN b USING (traj_id) WHERE NOT bad GROUP BY 1""")
def q_e3_all_or_nothing(spark, d):
    s = table(spark, d, "trajectories").select("traj_id", F.explode("steps").alias("s"))
    ok = records.all_or_nothing(s, "traj_id", F.col("s.observation").isNull() | (F.col("s.observation") == ""))
    return ok.groupBy("traj_id").agg(F.count(F.lit(1)).alias("steps"))


@query("""WITH t AS (SELECT traj_id, traj_id % 16 AS batch, [coalesce(length(s.observation), 0) for s in coalesce(steps, [])] AS ids FROM trajectories), m AS (SELECT batch, max(len(ids)) AS m FROM t GROUP BY 1)
SELECT traj_id, array_to_string(list_resize(ids, m, -1), ',') AS ids, len(ids) AS mask, array_to_string(list_resize(ids, m, -100), ',') AS labels FROM t JOIN m USING (batch)""")
def q_t7_padding(spark, d):
    """Rows of one batch padded to its longest; the ids are the lengths of the observations."""
    ids = F.transform(F.coalesce("steps", F.array()), lambda s: F.coalesce(F.length(s["observation"]), F.lit(0)))
    t = table(spark, d, "trajectories").select("traj_id", (F.col("traj_id") % 16).alias("batch"), ids.alias("ids"), ids.alias("labels"))
    p = examples.pad_batch(t, "batch", "ids", "labels", -1)
    return p.select("traj_id", F.array_join("ids", ",").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask"), F.array_join("labels", ",").alias("labels"))


@query("""WITH i AS (SELECT instance_id, count(*) AS n FROM tasks GROUP BY 1), r AS (SELECT repo, count(*) AS n FROM tasks GROUP BY 1)
SELECT item_id, coalesce(i.n, 0) AS same_instance, coalesce(r.n, 0) AS same_repo FROM heldout_items h LEFT JOIN i ON h.instance_id = i.instance_id LEFT JOIN r ON h.repo = r.repo""")
def q_u5_heldout_audit(spark, d):
    """Held-out items and how many tasks share their instance (an error of the split) or their repository (reported only)."""
    h, t = table(spark, d, "heldout_items").select("item_id", "instance_id", "repo"), table(spark, d, "tasks")
    for key, name in (("instance_id", "same_instance"), ("repo", "same_repo")):
        h = h.join(t.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return h.select("item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("same_instance", "same_repo")))


@query(f"""WITH m AS (SELECT kind, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT kind, CASE WHEN n >= 1000000000 THEN NULL WHEN kind IN ('issue', 'comment') THEN 'validation' ELSE 'train' END AS split FROM m)
SELECT s.split AS split, count(*) AS n FROM documents JOIN s USING (kind) GROUP BY 1""")
def q_u2_apply_split(spark, d):
    s = spark.createDataFrame([(k, "validation" if k in ("issue", "comment") else "train") for k in ("issue", "comment", "patch", "test_log", "observation", "thought", "guide", "commit_message")], "kind string, split string")
    return splits.apply_group_split(table(spark, d, "documents").select("doc_id", "kind"), "kind", s).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT task_id, instance_id FROM tasks""")
def q_u8_assert_unique(spark, d):
    """The frame itself, as task_id is unique; a key that is not raises an error (tested apart)."""
    return splits.assert_unique(table(spark, d, "tasks").select("task_id", "instance_id"), "task_id")


@query("""SELECT coalesce(instance_id, '') AS instance_id, count(*) AS n FROM tasks GROUP BY 1 HAVING count(*) > 1""")
def q_u8_duplicates(spark, d):
    return metrics.distribution(table(spark, d, "tasks").select(F.coalesce("instance_id", F.lit("")).alias("instance_id")), "instance_id").filter("n > 1")


@query("""SELECT r.rollout_id, r.step_index, count(s.observation) AS deliveries, max(r.final_tokens) AS final_tokens FROM budget_results r JOIN steps s USING (rollout_id, step_index) GROUP BY 1, 2""")
def q_j4_lookup_join(spark, d):
    b, s = table(spark, d, "budget_results").select("rollout_id", "step_index", "final_tokens"), table(spark, d, "steps").select("rollout_id", "step_index", "observation")
    return b.join(s, ["rollout_id", "step_index"]).groupBy("rollout_id", "step_index").agg(F.count("observation").alias("deliveries"), F.max("final_tokens").alias("final_tokens"))


@query(f"""WITH {RO}, a AS (SELECT arm, count(*) AS rollouts, count(DISTINCT instance_id) AS instances, min(repo) AS first_repo FROM ro GROUP BY 1),
 f AS (SELECT arm, unnest([{{'field': 'rollouts', 'v': rollouts::VARCHAR}}, {{'field': 'instances', 'v': instances::VARCHAR}}, {{'field': 'first_repo', 'v': first_repo}}]) AS x FROM a)
SELECT x.field AS field, max(x.v) FILTER (arm = 'base') IS NOT DISTINCT FROM max(x.v) FILTER (arm = 'sft') AS equal FROM f GROUP BY 1""")
def q_j9_comparable(spark, d):
    """Whether two arms agree in their totals."""
    r = _rollouts(spark, d, "arm", "instance_id", "repo")
    one = lambda arm: r.filter(F.col("arm") == arm).agg(F.count(F.lit(1)).alias("rollouts"), F.countDistinct("instance_id").alias("instances"), F.min("repo").alias("first_repo"))
    return compare.comparable(one("base"), one("sft"), ["rollouts", "instances", "first_repo"])


@query(f"""WITH {ST} SELECT rollout_id, step_index, sum(coalesce(generated_tokens, 0)) OVER (PARTITION BY rollout_id ORDER BY step_index)::BIGINT AS running_tokens FROM st""")
def q_w9_running_tokens(spark, d):
    s = _steps(spark, d, "generated_tokens").withColumn("tokens", F.coalesce("generated_tokens", F.lit(0)))
    return records.within_prefix(s, "rollout_id", "step_index", "tokens")


@query(f"""WITH {ST} SELECT step_index % 3 AS epoch, phase, count(*) AS n FROM st GROUP BY 1, 2""")
def q_w11_phase_counts(spark, d):
    return records.phase_counts(_steps(spark, d, "phase").withColumn("epoch", (F.col("step_index") % 3).cast("int")), "epoch", "phase")


@query("""SELECT md5(string_agg(task_id || '/' || coalesce(instance_id, '') || '/tasks/r1/abc', chr(10) ORDER BY task_id)) AS digest, count(*) AS rows FROM tasks GROUP BY task_id % 64""")
def q_s20_split_sources(spark, d):
    """Rows with their lineage columns, as one digest for 64 parts of the table."""
    t = readers.source_lineage(table(spark, d, "tasks").select("task_id", "instance_id"), "tasks", "r1", "abc")
    line = F.concat_ws("/", F.col("task_id").cast("string"), F.coalesce("instance_id", F.lit("")), "dataset_name", "dataset_revision", "dataset_checksum")
    g = t.groupBy((F.col("task_id") % 64).alias("part")).agg(F.array_sort(F.collect_list(F.struct("task_id", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("rows"))
    return g.select(F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"), "rows")


@query("""SELECT sha256('{"new_repo":' || coalesce(to_json(new_repo)::VARCHAR, 'null') || ',"old_repo":' || coalesce(to_json(old_repo)::VARCHAR, 'null') || '}') AS row_sha256, old_repo FROM repo_aliases""")
def q_s21_row_checksums(spark, d):
    return readers.row_checksums(table(spark, d, "repo_aliases").select("old_repo", "new_repo")).select("old_repo", "row_sha256")


@query("""SELECT 'tasks.parquet' AS file, true AS hashed UNION ALL SELECT 'task_refs.parquet', true""")
def q_s21_file_checksums(spark, d):
    """Bytes and digest of the files of two tables, as whether each has one of 64 digits."""
    out = None
    for name in ("tasks", "task_refs"):
        f = readers.file_checksums(spark, f"{d}/{name}.parquet").select(F.lit(f"{name}.parquet").alias("file"), ((F.col("bytes") > 0) & F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("ok"))
        f = f.groupBy("file").agg(F.every("ok").alias("hashed"))
        out = f if out is None else out.unionByName(f)
    return out


@query(f"""WITH {FACTS} SELECT final_test, reason, count(*) AS n FROM fc GROUP BY 1, 2""")
def q_c6_final_tests(spark, d):
    return _classified(spark, d).groupBy("final_test", "reason").agg(F.count(F.lit(1)).alias("n"))
