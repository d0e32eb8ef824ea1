"""Queries of the analytics operators over tasks, trajectories, rollouts and steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepmill.functions import calls, diff, text, tokens
from stepmill.functions.dims import ACTION_ENVIRONMENT, CALLS, EMPTY_PATCHES, PARAMETERS, PHASE_TOOLS, ROLLOUT_ENVIRONMENT, ROLLOUT_TIMEOUT, TOOLS, WRITES
from stepmill.operators import classify, compare, examples, metrics, quality, sequence, splits
from stepmill.plans import prompts
from stepmill.session import latest_steps, table
from stepmill.sources import readers

STEP_COLUMNS = ("phase", "previous_phase", "executed_tool", "model_proposed_tool", "action", "observation", "tool_success", "invalid_action", "repair_applied", "controller_intervened", "intervention_reason", "generation_truncated", "generated_tokens", "prompt_tokens", "recorded_at", "repo")
EXPLORE = ["list_files", "search_code"]


def _steps(spark, d, *columns):
    return latest_steps(table(spark, d, "steps"), *(columns or STEP_COLUMNS))


def _rollouts(spark, d, *columns):
    r = table(spark, d, "rollouts")
    cols = list(columns) or [c for c in r.columns if c not in ("rollout_id", "ingested_at")]
    return r.groupBy("rollout_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("r")).select("rollout_id", "r.*")


_split_name = text.split_class


# The same views for the SQL side.
ST = "st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id, step_index ORDER BY ingested_at DESC) AS rn FROM steps) WHERE rn = 1)"
RO = "ro AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY ingested_at DESC) AS rn FROM rollouts) WHERE rn = 1)"
TJ = "tj AS (SELECT traj_id, unnest(range(len(steps))) AS pos, unnest(steps) AS s FROM trajectories)"
ALIAS_CASE = """CASE WHEN n IN ('list_files','search_code','read_file','apply_patch','run_test') THEN n
 WHEN n IN ('edit_file','update_file','modify_file','update_code','modify','write_file') THEN 'apply_patch'
 WHEN n IN ('ls','list_directory','find_files') THEN 'list_files' WHEN n IN ('grep','search','find_code') THEN 'search_code'
 WHEN n IN ('test','pytest') THEN 'run_test' END"""
NAMED = f"nm AS (SELECT *, {ALIAS_CASE} AS tool FROM (SELECT *, trim(regexp_replace(lower(trim(split_part(action, '(', 1))), '[^a-z0-9]+', '_', 'g'), '_') AS n FROM st))"
SPLIT_CASE = "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(split)) LIKE 'v%' THEN 'validation' WHEN lower(trim(split)) LIKE 'te%' THEN 'test' END"
EMPTY = ", ".join(f"'{x}'" for x in EMPTY_PATCHES)

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- names, calls, texts -------------------------------------------------------------------------------------------


@query(f"""WITH {ST} SELECT lower(trim(split_part(action, '(', 1))) AS action_name, trim(regexp_replace(lower(trim(split_part(action, '(', 1))), '[^a-z0-9]+', '_', 'g'), '_') AS normal_name, count(*) AS n FROM st GROUP BY 1, 2""")
def q_p13_action_names(spark, d):
    s = _steps(spark, d, "action").select(text.action_name(F.col("action")).alias("action_name"), text.normal_name(F.substring_index("action", "(", 1)).alias("normal_name"))
    return s.groupBy("action_name", "normal_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ST}, {NAMED} SELECT tool, coalesce(tool <> n, false) AS repaired, count(*) AS n, count_if(invalid_action) AS flagged FROM nm GROUP BY 1, 2""")
def q_p14_alias_repair(spark, d):
    s = _steps(spark, d, "action", "invalid_action")
    name = F.substring_index("action", "(", 1)
    s = s.select(text.tool_of(name).alias("tool"), F.coalesce(text.tool_of(name) != text.normal_name(name), F.lit(False)).alias("repaired"), "invalid_action")
    return s.groupBy("tool", "repaired").agg(F.count(F.lit(1)).alias("n"), F.count_if("invalid_action").alias("flagged"))


@query(f"""WITH {ST} SELECT CASE WHEN executed_tool IN ('list_files','search_code','read_file','apply_patch','run_test') THEN executed_tool END AS registered_tool,
 coalesce(executed_tool, lower(trim(split_part(action, '(', 1)))) AS tool_or_action, trim(regexp_replace(lower(trim(model_proposed_tool)), '[^a-z0-9]+', '_', 'g'), '_') AS proposed, count(*) AS n FROM st GROUP BY 1, 2, 3""")
def q_p21_executed_tool(spark, d):
    s = _steps(spark, d, "executed_tool", "action", "model_proposed_tool")
    return s.groupBy(F.when(F.col("executed_tool").isin(*TOOLS), F.col("executed_tool")).alias("registered_tool"), F.coalesce("executed_tool", text.action_name(F.col("action"))).alias("tool_or_action"), text.normal_name(F.col("model_proposed_tool")).alias("proposed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ST}, a AS (SELECT executed_tool, regexp_extract(action, '(?s)^[^(]*\\((.*)\\)\\s*$', 1) AS j FROM st),
 k AS (SELECT executed_tool, CASE WHEN json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT' THEN array_to_string(list_sort(json_keys(j)), ',') END AS keys FROM a)
SELECT executed_tool, keys, count(*) AS n FROM k GROUP BY 1, 2""")
def q_p24_arguments(spark, d):
    s = _steps(spark, d, "executed_tool", "action")
    j = text.call_arguments(F.col("action"))
    keys = F.array_join(F.array_sort(F.json_object_keys(j)), ",")
    # keys only of what the strict parser takes too
    return s.select("executed_tool", F.when(F.try_parse_json(j).isNotNull(), keys).alias("keys")).groupBy("executed_tool", "keys").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN text[:1000] || chr(10) || '...[truncated ' || (length(text) - 1000) || ' chars]' ELSE text END AS hard,
 CASE WHEN length(text) > 256 THEN (CASE WHEN contains(text[:244], chr(10)) THEN regexp_replace(text[:244], '\\n[^\\n]*$', '') ELSE text[:244] END) || chr(10) || '[TRUNCATED]' ELSE text END AS at_line FROM documents""")
def q_p25_truncate(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.truncate_output(t, 1000).alias("hard"), text.truncate_at_line(t, 256).alias("at_line"))


@query("""SELECT task_id, CASE WHEN regexp_replace(instance_id, '[^A-Za-z0-9_.-]', '_', 'g') NOT IN ('', '.', '..') THEN regexp_replace(instance_id, '[^A-Za-z0-9_.-]', '_', 'g') END AS safe, replace(repo, '/', '__') AS slug FROM tasks""")
def q_p12_safe_names(spark, d):
    return table(spark, d, "tasks").select("task_id", text.safe_name(F.col("instance_id")).alias("safe"), text.repo_slug(F.col("repo")).alias("slug"))


@query(f"""WITH {TJ} SELECT traj_id, pos, json_keys(s.arguments)[1] AS first_key, length(s.arguments) > 0 AS given FROM tj""")
def q_p3_canonical_arguments(spark, d):
    s = table(spark, d, "trajectories").select("traj_id", F.posexplode("steps").alias("pos", "s"))
    return s.select("traj_id", F.col("pos").cast("long").alias("pos"), F.get(F.json_object_keys(calls.canonical_json(F.col("s.arguments"))), F.lit(0)).alias("first_key"), (F.length("s.arguments") > 0).alias("given"))


@query(f"""WITH {TJ}, r AS (SELECT traj_id, pos, json_extract_string(s.arguments, '$.path') AS path, coalesce(s.observation, '') AS text FROM tj WHERE s.tool = 'read_file' AND s.tool_success),
 f AS (SELECT traj_id, path, min(pos) AS pos, arg_min(text, pos) AS text FROM r WHERE path IS NOT NULL GROUP BY 1, 2)
SELECT traj_id, string_agg('### File: ' || path || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context FROM f GROUP BY 1""")
def q_p2_repository_context(spark, d):
    return examples.repository_context(table(spark, d, "trajectories"), "traj_id")


def _sft(spark, d):
    t = table(spark, d, "trajectories")
    patch = F.get(F.reverse(F.filter("steps", lambda s: s["tool"] == "apply_patch")), F.lit(0))["arguments"]
    return examples.sft_v1(t, "traj_id", F.coalesce("problem_statement", F.lit("")), F.coalesce(F.get_json_object(patch, "$.patch"), F.lit("")))


SFT = f"""{TJ}, r AS (SELECT traj_id, pos, json_extract_string(s.arguments, '$.path') AS path, coalesce(s.observation, '') AS text FROM tj WHERE s.tool = 'read_file' AND s.tool_success),
 f AS (SELECT traj_id, path, min(pos) AS pos, arg_min(text, pos) AS text FROM r WHERE path IS NOT NULL GROUP BY 1, 2),
 cx AS (SELECT traj_id, string_agg('### File: ' || path || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context FROM f GROUP BY 1),
 an AS (SELECT traj_id, coalesce(json_extract_string(arg_max(s.arguments, pos) FILTER (s.tool = 'apply_patch'), '$.patch'), '') AS answer, count(*) AS n FROM tj GROUP BY 1),
 ac AS (SELECT traj_id, pos, 'Thought: ' || coalesce(s.phase, '') || chr(10) || 'Action: ' || coalesce(s.tool, '') || '(' || coalesce(s.arguments, '{{}}') || ')' AS act, coalesce(s.observation, '') AS obs FROM tj),
 bs AS (SELECT t.traj_id, 'Instruction: ' || coalesce(problem_statement, '') || CASE WHEN coalesce(context, '') <> '' THEN chr(10) || chr(10) || 'Repository:' || chr(10) || context ELSE '' END AS base, coalesce(context, '') AS input, coalesce(answer, '') AS answer, coalesce(n, 0) AS n
   FROM trajectories t LEFT JOIN cx USING (traj_id) LEFT JOIN an USING (traj_id))"""


@query(f"""WITH {SFT} SELECT traj_id, input, n, length(answer) AS answer_chars FROM bs""")
def q_p1_sft_records(spark, d):
    return _sft(spark, d).select("traj_id", "input", F.size("trajectory").cast("long").alias("n"), F.length("answer").cast("long").alias("answer_chars"))


@query(f"""WITH {SFT}, ex AS (SELECT traj_id, base, answer, n, unnest(range(n + CASE WHEN trim(answer, E' \\n\\t\\r') <> '' THEN 1 ELSE 0 END)) AS i FROM bs),
 hs AS (SELECT traj_id, i, string_agg(act || chr(10) || 'Observation: ' || obs, chr(10) || chr(10) ORDER BY pos) AS h FROM ex JOIN ac USING (traj_id) WHERE pos < i GROUP BY 1, 2)
SELECT ex.traj_id, ex.i AS example_index, md5(base || CASE WHEN h IS NOT NULL THEN chr(10) || chr(10) || 'Completed steps:' || chr(10) || h ELSE '' END) AS prompt_md5, md5(coalesce(act, 'Final Answer: ' || answer)) AS target_md5
FROM ex LEFT JOIN hs ON ex.traj_id = hs.traj_id AND ex.i = hs.i LEFT JOIN ac ON ex.traj_id = ac.traj_id AND ex.i = ac.pos""")
def q_e1_expand_examples(spark, d):
    e = examples.expand_v1(_sft(spark, d), "traj_id")
    return e.select("traj_id", F.col("example_index").cast("long").alias("example_index"), F.md5("prompt").alias("prompt_md5"), F.md5("target").alias("target_md5"))


@query(f"""WITH u AS (SELECT traj_id, concat_ws(chr(10) || chr(10), CASE WHEN problem_statement <> '' THEN '## Issue' || chr(10) || problem_statement END, CASE WHEN steps[1].phase <> '' THEN '## Phase' || chr(10) || steps[1].phase END,
  CASE WHEN len(steps) > 0 THEN '## Tools' || chr(10) || array_to_string(list_sort(list_distinct([s.tool for s in steps])), ', ') END) AS user FROM trajectories),
 c AS (SELECT traj_id, '<|im_start|>system' || chr(10) || '{prompts.SYSTEM}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || user || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p FROM u)
SELECT traj_id, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM c""")
def q_p5_chat_prompts(spark, d):
    t = table(spark, d, "trajectories").withColumn("steps", F.coalesce("steps", F.array()))
    m = prompts.messages(F.coalesce("problem_statement", F.lit("")), F.get(F.col("steps"), F.lit(0))["phase"], F.transform("steps", lambda s: s["tool"]))
    return t.select("traj_id", F.length(prompts.chat_prompt(m)).alias("prompt_chars"), F.md5(prompts.chat_prompt(m)).alias("prompt_md5"))


# ---- patches -------------------------------------------------------------------------------------------------------

PATHS = r"list_distinct(list_filter(list_concat(regexp_extract_all(patch, '(?m)^\+\+\+ (?:b/)?(.+)$', 1), regexp_extract_all(patch, '(?m)^--- (?:a/)?(.+)$', 1)), lambda p: p <> '/dev/null'))"


ISSUES = rf"""WITH {TJ}, p AS (SELECT traj_id, count(*) FILTER (s.tool = 'run_test') AS tests, arg_max({{'v': s.tool_success}}, pos) FILTER (s.tool = 'run_test') AS last_test, arg_max(s.arguments, pos) FILTER (s.tool = 'apply_patch') AS a FROM tj GROUP BY 1),
 q AS (SELECT t.traj_id, coalesce(tests, 0) AS tests, last_test.v AS ok, coalesce(json_extract_string(a, '$.patch'), '') AS patch FROM trajectories t LEFT JOIN p USING (traj_id)), f AS (SELECT *, len({PATHS}) AS files FROM q)
SELECT traj_id, concat_ws(',', CASE WHEN tests = 0 THEN 'missing_test' END, CASE WHEN tests > 0 AND ok IS NOT TRUE THEN 'final_test_failed' END,
 CASE WHEN lower(trim(patch)) IN ({EMPTY}) OR NOT regexp_matches(patch, '(?m)^(\+([^+-]|$)|-([^+-]|$))') THEN 'empty_patch' END, CASE WHEN files > 1 THEN 'too_many_modified_files:' || files || '>1' END) AS issues FROM f"""


@query(ISSUES)
def q_f1_quality_issues(spark, d):
    """Quality gate of raw trajectories: no test, last test not passed, no patch, too many files (here more than one)."""
    t = table(spark, d, "trajectories").withColumn("steps", F.coalesce("steps", F.array()))
    return t.select("traj_id", F.array_join(quality.quality_issues(F.col("steps"), quality.last_patch(F.col("steps")), 1), ",").alias("issues"))


@query(rf"""WITH {ST}, {RO}, p AS (SELECT rollout_id, count(*) FILTER (executed_tool = 'run_test') AS tests, arg_max({{'v': tool_success}}, step_index) FILTER (executed_tool = 'run_test') AS last_test FROM st GROUP BY 1), f AS (SELECT rollout_id, tests, last_test.v AS ok, coalesce(patch, '') AS patch FROM ro JOIN p USING (rollout_id))
SELECT rollout_id FROM f WHERE tests > 0 AND ok AND lower(trim(patch)) NOT IN ({EMPTY}) AND regexp_matches(patch, '(?m)^(\+([^+-]|$)|-([^+-]|$))') AND len({PATHS}) <= 3""")
def q_f2_quality_filter(spark, d):
    """Rollouts that pass the gate with their own patch."""
    s = _steps(spark, d, "executed_tool", "tool_success").groupBy("rollout_id").agg(F.array_sort(F.collect_list(F.struct("step_index", F.col("executed_tool").alias("tool"), "tool_success"))).alias("steps"))
    return quality.quality_filter(_rollouts(spark, d, "patch").join(s, "rollout_id"), "steps", "patch").select("rollout_id")


@query(rf"""SELECT task_id, CASE WHEN patch IS NOT NULL THEN array_to_string(list_sort({PATHS}), ',') END AS headers,
 array_to_string(list_sort(list_distinct(list_filter([regexp_replace(split_part(x, chr(9), 1), '^b/', '') for x in regexp_extract_all(patch, '(?m)^\+\+\+ (.+)$', 1)], lambda p: p <> '/dev/null'))), ',') AS targets,
 len(list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++ '))) AS added, len(list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '-') AND NOT starts_with(l, '--- '))) AS removed,
 lower(trim(coalesce(patch, ''))) NOT IN ({EMPTY}) AS has_patch FROM tasks""")
def q_f5_patch_statistics(spark, d):
    p = F.col("patch")
    return table(spark, d, "tasks").select("task_id", F.array_join(F.array_sort(text.patch_headers(p)), ",").alias("headers"), F.array_join(text.patch_targets(p), ",").alias("targets"), text.patch_lines(p, "+").cast("long").alias("added"), text.patch_lines(p, "-").cast("long").alias("removed"), text.has_patch(p).alias("has_patch"))


@query(r"""WITH h AS (SELECT task_id, unnest(regexp_extract_all(patch, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')) AS h FROM tasks)
SELECT task_id, count(*) AS hunks, sum(regexp_extract(h, '-(\d+)', 1)::BIGINT) AS starts FROM h GROUP BY 1""")
def q_f7_hunks(spark, d):
    sec = diff.file_sections(table(spark, d, "tasks"), "task_id", "patch")
    r = diff.hunk_ranges(sec, "task_id", pad=0)
    return r.groupBy("task_id").agg(F.count(F.lit(1)).alias("hunks"), F.sum("start").alias("starts"))


@query(r"""WITH h AS (SELECT traj_id, json_extract_string(s.arguments, '$.path') AS path, json_extract(s.arguments, '$.start_line')::INT AS a FROM (SELECT traj_id, unnest(steps) AS s FROM trajectories) WHERE s.tool = 'read_file'),
 r AS (SELECT path, greatest(1, a - 30) AS a, a + 30 AS b FROM h WHERE a IS NOT NULL),
 w AS (SELECT *, max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
 i AS (SELECT *, sum(CASE WHEN a <= m + 20 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM w)
SELECT path, min(a) AS start_line, max(b) AS end_line FROM i GROUP BY path, g""")
def q_f9_merged_ranges(spark, d):
    s = table(spark, d, "trajectories").select(F.explode("steps").alias("s")).filter("s.tool = 'read_file'")
    a = F.get_json_object("s.arguments", "$.start_line").cast("int")
    r = s.select(F.get_json_object("s.arguments", "$.path").alias("path"), F.greatest(F.lit(1), a - 30).alias("start"), (a + 30).alias("end")).filter(a.isNotNull())
    return diff.merge_ranges(r, ["path"]).select("path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query(r"""WITH l AS (SELECT task_id, unnest(range(len(ls))) AS i, trim(unnest(ls), E' \t\r') AS x FROM (SELECT task_id, string_split(test_patch, chr(10)) AS ls FROM tasks WHERE test_patch IS NOT NULL)),
 k AS (SELECT task_id, x, min(i) AS i FROM l WHERE length(x) BETWEEN 4 AND 180 AND NOT regexp_matches(x, '^(#|//|\*|/\*)') GROUP BY 1, 2),
 o AS (SELECT task_id, x, i, 0 AS part FROM k WHERE regexp_matches(x, '^(async\s+def|def|class|function|func|public|private|protected)\b') UNION ALL SELECT task_id, x, i, 1 FROM k),
 n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY part, i) AS r FROM o)
SELECT task_id, coalesce(string_agg(x, chr(10) ORDER BY r) FILTER (r <= 3), '') AS lines FROM tasks LEFT JOIN n USING (task_id) WHERE test_patch IS NOT NULL GROUP BY 1""")
def q_f10_search_lines(spark, d):
    return table(spark, d, "tasks").filter("test_patch IS NOT NULL").select("task_id", F.array_join(text.search_lines(F.col("test_patch")), "\n").alias("lines"))


@query("""SELECT task_id, concat_ws(',', CASE WHEN contains(lower(p), 'fail_to_pass') THEN 'fail_to_pass_literal' END, CASE WHEN length(trim(hints, E' \\n\\t\\r')) >= 16 AND contains(p, trim(hints, E' \\n\\t\\r')) THEN 'hints' END,
 CASE WHEN length(trim(patch, E' \\n\\t\\r')) >= 1 AND contains(p, trim(patch, E' \\n\\t\\r')) THEN 'patch' END) AS leaks FROM (SELECT *, problem_statement || coalesce(hints, '') AS p FROM tasks)""")
def q_f11_prompt_leakage(spark, d):
    t = table(spark, d, "tasks").withColumn("p", F.concat("problem_statement", F.coalesce("hints", F.lit(""))))
    long_hints = F.when(F.length(text.strip(F.col("hints"))) >= 16, F.col("hints"))
    return t.select("task_id", F.coalesce(F.array_join(splits.prompt_leakage(F.col("p"), {"patch": F.col("patch"), "hints": long_hints}, {"fail_to_pass_literal": "fail_to_pass"}), ","), F.lit("")).alias("leaks"))


@query(f"""WITH {TJ} SELECT a.traj_id, a.pos AS pos, count(*) AS leaks FROM tj a JOIN tj b ON a.traj_id = b.traj_id AND b.pos > a.pos WHERE a.s.observation IS NOT NULL AND length(json_extract_string(b.s.arguments, '$.path')) > 0 AND contains(a.s.observation, json_extract_string(b.s.arguments, '$.path')) GROUP BY 1, 2""")
def q_f12_future_actions(spark, d):
    """Steps whose observation already holds a path that a later step of the same trajectory uses."""
    t = table(spark, d, "trajectories").select("traj_id", "steps", F.transform("steps", lambda s: F.get_json_object(s["arguments"], "$.path")).alias("paths"))
    s = t.select("traj_id", "paths", F.posexplode("steps").alias("pos", "s"))
    later = F.slice("paths", F.col("pos") + 2, F.size("paths"))
    n = F.size(F.filter(later, lambda p: (F.length(p) > 0) & F.contains(F.col("s.observation"), p)))
    return s.select("traj_id", F.col("pos").cast("long").alias("pos"), n.cast("long").alias("leaks")).filter("leaks > 0")


# ---- validation ----------------------------------------------------------------------------------------------------


@query("""SELECT task_id, concat_ws(',', CASE WHEN trim(coalesce(instance_id, '')) = '' THEN 'instance_id' END, CASE WHEN trim(coalesce(problem_statement, ''), E' \\n\\r\\t') = '' THEN 'problem_statement' END) AS blank,
 coalesce(regexp_full_match(repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+'), false) AS repo_ok, coalesce(regexp_full_match(base_commit, '[0-9a-fA-F]{7,40}'), false) AS commit_ok FROM tasks""")
def q_v7_task_fields(spark, d):
    blank = lambda c: text.strip(F.coalesce(c, F.lit(""))) == ""
    return table(spark, d, "tasks").select("task_id", F.concat_ws(",", *(F.when(blank(F.col(c)), c) for c in ("instance_id", "problem_statement"))).alias("blank"), F.coalesce(F.regexp_like("repo", F.lit(r"\A[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z")), F.lit(False)).alias("repo_ok"), F.coalesce(F.regexp_like("base_commit", F.lit(r"\A[0-9a-fA-F]{7,40}\z")), F.lit(False)).alias("commit_ok"))


@query(f"""WITH {TJ}, a AS (SELECT traj_id, pos, s.tool AS tool, s.phase AS phase, json_keys(s.arguments) AS k, s.arguments AS j FROM tj),
 r AS (SELECT *, CASE tool WHEN 'search_code' THEN ['query'] WHEN 'read_file' THEN ['path'] WHEN 'apply_patch' THEN ['patch'] WHEN 'run_test' THEN ['command'] ELSE [] END AS req,
   CASE tool WHEN 'list_files' THEN ['path','max_entries'] WHEN 'search_code' THEN ['query','path','max_results'] WHEN 'read_file' THEN ['path','start_line','end_line'] WHEN 'apply_patch' THEN ['patch'] ELSE ['command'] END AS allowed FROM a)
SELECT tool, phase, CASE WHEN len(list_filter(req, lambda x: NOT list_contains(k, x))) > 0 THEN 'missing_argument' WHEN len(list_filter(k, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'unexpected_argument'
  WHEN NOT CASE phase WHEN 'LOCATE' THEN tool IN ('list_files','search_code') WHEN 'UNDERSTAND' THEN tool IN ('read_file','search_code') WHEN 'MODIFY' THEN tool = 'apply_patch' WHEN 'VERIFY' THEN tool = 'run_test' ELSE false END THEN 'phase_tool_mismatch' END AS status, count(*) AS n
FROM r GROUP BY 1, 2, 3""")
def q_v1_target_status(spark, d):
    s = table(spark, d, "trajectories").select(F.explode("steps").alias("s")).select("s.*")
    return s.groupBy("tool", "phase", calls.target_status(F.col("phase"), F.col("tool"), F.col("arguments")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH i AS (SELECT task_id, repo, list_filter(coalesce(fail_to_pass, []), lambda x: trim(x) <> '') AS ids FROM tasks),
 u AS (SELECT task_id, unnest(range(len(ids))) AS n, unnest(ids) AS x FROM i), l AS (SELECT task_id, regexp_extract(x, '^[A-Za-z_][A-Za-z0-9_]* \(([^)]+)\)$', 1) || '.' || regexp_extract(x, '^([A-Za-z_][A-Za-z0-9_]*) \([^)]+\)$', 1) AS w, min(n) AS n FROM u WHERE regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]* \([^)]+\)$') GROUP BY 1, 2),
 f AS (SELECT task_id, split_part(x, '::', 1) AS w, min(n) AS n FROM u WHERE split_part(x, '::', 1) <> '' GROUP BY 1, 2),
 q AS (SELECT task_id, kind, string_agg(CASE WHEN regexp_full_match(w, '[A-Za-z0-9_@%+=:,./-]+') THEN w ELSE chr(39) || replace(w, chr(39), chr(39) || '"' || chr(39) || '"' || chr(39)) || chr(39) END, ' ' ORDER BY n) AS words FROM (SELECT *, 'label' AS kind FROM l UNION ALL SELECT *, 'file' FROM f) GROUP BY 1, 2)
SELECT task_id, CASE WHEN repo = 'django/django' AND a.words IS NOT NULL THEN 'python tests/runtests.py --verbosity 1 ' || a.words WHEN b.words IS NOT NULL THEN 'python -m pytest -q ' || b.words ELSE 'python -m pytest -q' END AS command
FROM i LEFT JOIN (SELECT task_id, words FROM q WHERE kind = 'label') a USING (task_id) LEFT JOIN (SELECT task_id, words FROM q WHERE kind = 'file') b USING (task_id)""")
def q_v11_derived_commands(spark, d):
    """The command of every task. The tables hold no files of the repositories, so each path counts as existing."""
    return table(spark, d, "tasks").select("task_id", text.test_command(F.col("repo"), F.col("fail_to_pass")).alias("command"))


# ---- classification ------------------------------------------------------------------------------------------------

NAME = "lower(trim(split_part(coalesce(action, ''), '(', 1)))"
CALL_LIST, WRITE_LIST = (", ".join(f"'{t}'" for t in ts) for ts in (CALLS, WRITES))
SAID = """CASE WHEN name = 'read_file' THEN contains(o, 'read_file failed:') OR contains(o, 'not a file:') WHEN name IN ('write_file', 'apply_patch') THEN contains(o, name || ' failed:') OR contains(o, name || ' refused:')
  WHEN name = 'run_test' THEN contains(o, 'run_test failed:') OR contains(o, 'run_test refused') ELSE contains(o, name || ' failed:') END"""
SIGNALS = f"sg AS (SELECT *, name IN ({CALL_LIST}) AS is_call, name IN ({CALL_LIST}) AND ({SAID}) AS failed FROM (SELECT *, {NAME} AS name, lower(coalesce(observation, '')) AS o FROM st))"
FLAGS = f"""{SIGNALS}, fl AS (SELECT rollout_id, bool_or(coalesce(invalid_action, false)) AS invalid, bool_or(regexp_matches(o, '{ROLLOUT_TIMEOUT}')) AS late, bool_or(regexp_matches(o, '{ROLLOUT_ENVIRONMENT}')) AS environment, bool_or(name = 'error') AS error_step,
  bool_or(name IN ({WRITE_LIST}) OR coalesce(executed_tool = 'apply_patch', false)) AS wrote, bool_or(failed AND name IN ({WRITE_LIST})) AS write_failed, bool_or(failed) AS tool_failed, count(*) AS steps, count_if(is_call) AS tool_calls, count_if(invalid_action) AS invalid_actions, count_if(failed) AS tool_failures FROM sg GROUP BY 1)"""
CHANGES = r"trim(coalesce(patch, ''), E' \n\r\t') NOT IN ('', '(no changes)')"
REASON = f"""CASE WHEN coalesce(success, false) THEN NULL WHEN invalid THEN 'invalid_action' WHEN coalesce(late, false) OR regexp_matches(dg, '{ROLLOUT_TIMEOUT}') THEN 'timeout' WHEN coalesce(environment, false) OR coalesce(error_step, false) OR regexp_matches(dg, '{ROLLOUT_ENVIRONMENT}') THEN 'environment_error'
 WHEN write_failed THEN 'patch_failed' WHEN tool_failed THEN 'tool_error' WHEN NOT ({CHANGES}) THEN 'no_patch' WHEN wrote AND coalesce(len(modified_files), 0) = 0 THEN 'patch_failed' WHEN test_result IS NULL THEN 'environment_error' WHEN NOT coalesce(test_result.passed, false) THEN 'test_failed' ELSE 'patch_failed' END"""
FACTS = f"{ST}, {RO}, {FLAGS}, fc AS (SELECT *, {REASON} AS reason, CASE WHEN test_result.passed THEN 'passed' WHEN NOT test_result.passed THEN 'failed' ELSE 'missing' END AS final_test FROM (SELECT *, coalesce(test_result.output, '') || chr(10) || coalesce(test_result.policy_error, '') AS dg FROM ro LEFT JOIN fl USING (rollout_id)))"


def _flagged(spark, d, signals, *columns):
    """Valid steps with flags; they are taken before deliveries are merged, so that no observation is shuffled."""
    return latest_steps(table(spark, d, "steps").withColumns(signals), *columns, *signals)


def _classified(spark, d):
    signals = classify.rollout_signals(*(F.col(c) for c in ("action", "executed_tool", "observation", "invalid_action")))
    s = _flagged(spark, d, signals)
    facts = s.groupBy("rollout_id").agg(*(F.bool_or(k).alias(k) for k in signals if k != "is_call"), F.count(F.lit(1)).alias("steps"), F.count_if("is_call").alias("tool_calls"), F.count_if("invalid").alias("invalid_actions"), F.count_if("tool_failed").alias("tool_failures"))
    r = _rollouts(spark, d, "instance_id", "arm", "repo", "success", "patch", "modified_files", "test_result", "host_test_result", "token_usage").join(facts, "rollout_id", "left")
    reason = classify.rollout_failure(F.col("success"), {k: F.col(k) for k in signals if k != "is_call"}, F.col("patch"), F.col("modified_files"), F.col("test_result"))
    return r.withColumn("reason", reason).withColumn("final_test", classify.test_state(F.col("test_result")))


@query(f"WITH {FACTS} SELECT rollout_id, steps, tool_calls, invalid_actions, tool_failures, final_test, reason FROM fc")
def q_g2_rollout_facts(spark, d):
    return _classified(spark, d).select("rollout_id", "steps", "tool_calls", "invalid_actions", "tool_failures", "final_test", "reason")


REASONS = ["invalid_action", "timeout", "environment_error", "patch_failed", "tool_error", "no_patch", "test_failed"]


@query(f"""WITH {FACTS}, c AS (SELECT arm, reason, count(*) AS n FROM fc WHERE reason IS NOT NULL GROUP BY 1, 2), d AS (SELECT arm, unnest({REASONS}) AS reason FROM (SELECT DISTINCT arm FROM fc WHERE reason IS NOT NULL))
SELECT d.arm, d.reason, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.arm = c.arm AND d.reason = c.reason""")
def q_g1_failure_taxonomy(spark, d):
    counts = _classified(spark, d).filter("reason IS NOT NULL").groupBy("arm", "reason").agg(F.count(F.lit(1)).alias("n"))
    return classify.zero_filled(counts, "reason", REASONS, ["arm"])


@query(f"""WITH {FACTS} SELECT arm, count(*) AS rollouts, count_if(success) AS successes, count_if(success) / count(*)::DOUBLE AS success_rate, sum(steps)::BIGINT AS steps, sum(tool_calls)::BIGINT AS tool_calls, sum(invalid_actions)::BIGINT AS invalid_actions,
 coalesce(sum(invalid_actions) / nullif(sum(steps), 0)::DOUBLE, 0) AS invalid_rate, count_if(final_test = 'passed') AS passed, count_if(final_test = 'missing') AS missing, sum(token_usage.total_tokens)::BIGINT AS total_tokens FROM fc GROUP BY 1""")
def q_g3_arm_summary(spark, d):
    s = lambda c: F.sum(c)
    return _classified(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("rollouts"), F.count_if("success").alias("successes"), text.guarded_ratio(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"), s("steps").alias("steps"), s("tool_calls").alias("tool_calls"), s("invalid_actions").alias("invalid_actions"), text.guarded_ratio(s("invalid_actions"), s("steps")).alias("invalid_rate"), F.count_if(F.col("final_test") == "passed").alias("passed"), F.count_if(F.col("final_test") == "missing").alias("missing"), s("token_usage.total_tokens").alias("total_tokens"))


def _schema_sql():
    """The status of a call's arguments j (JSON or NULL) for the tool `tool`, by the parameter list."""
    missing, bad = [], []
    for t in TOOLS:
        params = [p for p in PARAMETERS if p[0] == t]
        here = f"tool = '{t}' AND "
        allowed = ", ".join(f"'{p[1]}'" for p in params)
        missing.extend(here + f"NOT list_contains(k, '{p[1]}')" for p in params if p[5])
        bad.append(here + f"len(list_filter(k, lambda x: x NOT IN ({allowed}))) > 0")
        for _, name, kind, low, high, _ in params:
            of = f"json_type(j, '$.{name}')"
            if kind == "string":
                bad.append(here + f"{of} <> 'VARCHAR'")
                continue
            bad.append(here + f"{of} NOT IN ('UBIGINT', 'BIGINT')")
            outside = f"TRY_CAST(json_extract(j, '$.{name}') AS BIGINT) < {low}" + (f" OR TRY_CAST(json_extract(j, '$.{name}') AS BIGINT) > {high}" if high else "")
            bad.append(here + f"({outside})")
    either = lambda xs: " OR ".join(f"coalesce({x}, false)" for x in xs)
    return f"CASE WHEN j IS NULL THEN 'schema_error' WHEN {either(missing)} THEN 'missing_argument' WHEN {either(bad)} THEN 'schema_error' END"


ACTIONS = f"""p AS (SELECT *, trim(regexp_replace(lower(trim(model_proposed_tool)), '[^a-z0-9]+', '_', 'g'), '_') AS n, CASE WHEN contains(action, '(') AND ends_with(action, ')') THEN substr(action, instr(action, '(') + 1, length(action) - instr(action, '(') - 1) END AS raw, lower(coalesce(observation, '')) AS o FROM st),
 a AS (SELECT *, {ALIAS_CASE} AS tool, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN raw END AS j FROM p), b AS (SELECT *, json_keys(j) AS k, coalesce(tool_success = false, false) AS bad FROM a),
 c AS (SELECT *, CASE WHEN n <> '' AND tool IS NULL THEN 'unknown_tool' WHEN coalesce(starts_with(action, 'invalid('), false) THEN 'invalid_json' WHEN tool IS NULL THEN NULL ELSE {_schema_sql()} END AS status FROM b),
 f AS (SELECT *, CASE WHEN generation_truncated THEN 'generation_truncated' WHEN status IS NOT NULL THEN status WHEN contains(o, 'planning controller blocked') THEN 'controller_blocked' WHEN executed_tool = 'search_code' AND trim(o, E' \n\r\t') = 'no matches' THEN 'search_no_result'
  WHEN bad AND executed_tool = 'run_test' AND regexp_matches(o, '{ACTION_ENVIRONMENT.replace(chr(39), chr(39) * 2)}') THEN 'test_environment_error' WHEN bad AND contains(o, 'path escapes workspace') THEN 'wrong_path' WHEN bad AND (contains(o, 'path does not exist') OR contains(o, 'not a file') OR contains(o, 'target is not an existing file')) THEN 'file_not_found'
  WHEN bad AND executed_tool = 'apply_patch' AND (contains(o, 'no valid file headers') OR contains(o, 'creating or deleting files is not allowed')) THEN 'patch_parse_error' WHEN bad AND executed_tool = 'apply_patch' AND contains(o, 'apply_patch failed:') THEN 'git_apply_check_failed' WHEN bad THEN 'other_tool_error' END AS failure FROM c)"""


@query(f"WITH {ST}, {ACTIONS} SELECT executed_tool, failure, count(*) AS n FROM f GROUP BY 1, 2")
def q_c4_action_ladder(spark, d):
    """All 13 classes, those of the call itself included."""
    s = _steps(spark, d, "executed_tool", "model_proposed_tool", "action", "observation", "tool_success", "generation_truncated")
    s = classify.arguments_status(s, "action", "model_proposed_tool")
    f = classify.action_failure(F.col("executed_tool"), F.col("observation"), F.col("tool_success"), F.col("generation_truncated"), F.col("arguments_status"))
    return s.groupBy("executed_tool", f.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS}, l AS (SELECT rollout_id, concat_ws(',', CASE WHEN invalid THEN 'invalid_action' END, CASE WHEN final_test = 'failed' THEN 'test_failed' END, CASE WHEN tool_failed THEN 'tool_error' END) AS labels FROM fc)
SELECT rollout_id, labels, CASE WHEN contains(labels, 'test_failed') THEN 'test_failed' WHEN contains(labels, 'tool_error') THEN 'tool_error' WHEN contains(labels, 'invalid_action') THEN 'invalid_action' ELSE 'unknown' END AS first_label FROM l""")
def q_c5_primary_secondary(spark, d):
    labels = classify.all_matches([(F.col("invalid"), "invalid_action"), (F.col("final_test") == "failed", "test_failed"), (F.col("tool_failed"), "tool_error")])
    return _classified(spark, d).select("rollout_id", F.array_join(labels, ",").alias("labels"), classify.primary_of(labels, ["test_failed", "tool_error", "invalid_action"]).alias("first_label"))


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query(f"WITH {ST}, {RO} SELECT arm, executed_tool AS tool, count(*) AS n FROM st JOIN ro USING (rollout_id) GROUP BY 1, 2")
def q_g4_tool_frequency(spark, d):
    return metrics.distribution(_steps(spark, d, "executed_tool").withColumnRenamed("executed_tool", "tool").join(_rollouts(spark, d, "arm"), "rollout_id"), "tool", ["arm"])


@query("""SELECT kind, count(text) AS count, avg(length(text)) AS mean, median(length(text))::DOUBLE AS median, quantile_cont(length(text), 0.9) AS p90, quantile_cont(length(text), 0.95) AS p95, quantile_cont(length(text), 0.99) AS p99, max(length(text))::DOUBLE AS max FROM documents GROUP BY 1""")
def q_g12_length_stats(spark, d):
    return metrics.length_stats(table(spark, d, "documents").withColumn("n", F.length("text")), "n", ["kind"])


@query(f"""WITH {ST}, {RO}, b AS (SELECT arm, phase, executed_tool FROM st JOIN ro USING (rollout_id)) SELECT arm, phase, grouping(arm) AS all_arms, count(*) AS n FROM b GROUP BY GROUPING SETS ((arm, phase), (phase))""")
def q_g15_grouping_sets(spark, d):
    s = _steps(spark, d, "phase").join(_rollouts(spark, d, "arm"), "rollout_id")
    return s.groupingSets([["arm", "phase"], ["phase"]], "arm", "phase").agg(F.grouping("arm").cast("long").alias("all_arms"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS} SELECT arm, count(*) AS rows, count_if(success) AS success_count, count_if(success) / count(*)::DOUBLE AS success_rate, count_if(tool_failed) AS tool_failed_count, count_if(tool_failed) / count(*)::DOUBLE AS tool_failed_rate FROM fc GROUP BY 1""")
def q_g9_rates(spark, d):
    return metrics.rates(_classified(spark, d), {"success": F.col("success"), "tool_failed": F.col("tool_failed")}, ["arm"])


@query(f"""WITH {ST}, m AS (SELECT rollout_id, executed_tool AS key, count(*) AS n FROM st WHERE executed_tool IS NOT NULL GROUP BY 1, 2), r AS ({'SELECT * FROM m'}) SELECT arm, key, sum(n)::BIGINT AS n FROM r JOIN (SELECT rollout_id, any_value(arm) AS arm FROM rollouts GROUP BY 1) USING (rollout_id) GROUP BY 1, 2""")
def q_g21_merge_counters(spark, d):
    c = _steps(spark, d, "executed_tool").filter("executed_tool IS NOT NULL").groupBy("rollout_id", "executed_tool").agg(F.count(F.lit(1)).alias("n"))
    maps = c.groupBy("rollout_id").agg(F.map_from_entries(F.collect_list(F.struct("executed_tool", "n"))).alias("tools"))
    return metrics.merge_counters(maps.join(_rollouts(spark, d, "arm"), "rollout_id"), "tools", ["arm"])


@query(f"""WITH {FACTS}, c AS (SELECT reason, count_if(arm = 'sft') - count_if(arm = 'base') AS delta FROM fc WHERE reason IS NOT NULL GROUP BY 1) SELECT reason, delta FROM c ORDER BY abs(delta) DESC, reason DESC LIMIT 1""")
def q_g20_top_delta(spark, d):
    c = _classified(spark, d).filter("reason IS NOT NULL").groupBy("arm", "reason").agg(F.count(F.lit(1)).alias("n"))
    return metrics.top_delta(c.filter("arm = 'base'"), c.filter("arm = 'sft'"), "reason", "n")


@query("SELECT count(*) > 0 AS has_rows, bool_and(coalesce(isfinite(value), false)) AS finite FROM events")
def q_t12_finite(spark, d):
    return metrics.all_finite(table(spark, d, "events"), ["value"])


# ---- sequences -----------------------------------------------------------------------------------------------------


@query(f"""WITH {ST} SELECT rollout_id, max(step_index) AS last_step, arg_max({{'v': tool_success}}, step_index).v AS tool_success FROM st WHERE executed_tool = 'run_test' GROUP BY 1""")
def q_w1_last_test(spark, d):
    return sequence.last_matching(_steps(spark, d, "executed_tool", "tool_success"), "rollout_id", F.col("executed_tool") == "run_test", "tool_success")


@query(f"""WITH {ST}, f AS (SELECT rollout_id, step_index, executed_tool AS tool, lag(executed_tool) OVER (PARTITION BY rollout_id ORDER BY step_index) AS prev FROM st WHERE executed_tool IN ('list_files','search_code','read_file','apply_patch','run_test'))
SELECT rollout_id, tool, count(*) AS repeats FROM f WHERE tool = prev AND tool IN ('list_files', 'search_code') GROUP BY 1, 2""")
def q_w2_repeated_exploration(spark, d):
    return sequence.consecutive_repeats(_steps(spark, d, "executed_tool"), "rollout_id", "executed_tool", list(TOOLS), EXPLORE)


@query(f"""WITH {ST} SELECT phase, previous_phase || ' -> ' || phase AS transition, count(*) AS n FROM st WHERE previous_phase <> phase GROUP BY 1, 2""")
def q_w4_phase_transitions(spark, d):
    return sequence.phase_transitions(_steps(spark, d, "phase", "previous_phase"), ["phase"])


@query(f"""WITH {ST} SELECT rollout_id, """ + ", ".join(f"coalesce(CASE WHEN count(phase) > 0 THEN bool_or(phase = '{p}' OR previous_phase = '{p}') ELSE bool_or(executed_tool IN ({', '.join(repr(x) for x in t)})) END, false) AS reached_{p.lower()}" for p, t in PHASE_TOOLS.items()) + ", CASE WHEN count(phase) > 0 THEN 'recorded' ELSE 'tools' END AS source FROM st GROUP BY 1")
def q_w5_phase_reach(spark, d):
    return sequence.phase_reach(_steps(spark, d, "phase", "previous_phase", "executed_tool"), "rollout_id")


@query(f"""WITH RECURSIVE {ST}, q AS (SELECT rollout_id, row_number() OVER (PARTITION BY rollout_id ORDER BY step_index) AS k, executed_tool AS tool, coalesce(tool_success, false) AS ok FROM st),
 r AS (SELECT DISTINCT rollout_id, 0::BIGINT AS k, 'LOCATE' AS phase, false AS rd, 0 AS searches, 0 AS lists, 0 AS blocked, 'LOCATE' AS path FROM q
  UNION ALL SELECT rollout_id, k, nxt, rd OR (NOT stop AND ok AND tool = 'read_file'), CASE WHEN stop THEN searches WHEN tool = 'search_code' THEN searches + 1 ELSE 0 END, CASE WHEN stop THEN lists WHEN tool = 'list_files' THEN lists + 1 ELSE 0 END, blocked + stop::INT, CASE WHEN nxt <> phase THEN path || '>' || nxt ELSE path END
  FROM (SELECT *, CASE WHEN stop THEN phase WHEN ok AND phase = 'LOCATE' AND tool = 'search_code' THEN 'UNDERSTAND' WHEN ok AND phase = 'UNDERSTAND' AND tool = 'read_file' THEN 'MODIFY' WHEN ok AND phase = 'MODIFY' AND tool = 'apply_patch' THEN 'VERIFY' WHEN NOT ok AND phase = 'VERIFY' AND tool = 'run_test' THEN 'UNDERSTAND' ELSE phase END AS nxt
   FROM (SELECT r.* EXCLUDE (k), q.k, tool, ok, coalesce((tool = 'list_files' AND lists >= 2) OR (tool <> 'read_file' AND searches >= 3) OR (tool = 'apply_patch' AND NOT rd)
     OR NOT CASE phase WHEN 'LOCATE' THEN tool IN ('list_files','search_code') WHEN 'UNDERSTAND' THEN tool IN ('read_file','search_code') WHEN 'MODIFY' THEN tool = 'apply_patch' ELSE tool = 'run_test' END, true) AS stop FROM r JOIN q ON r.rollout_id = q.rollout_id AND q.k = r.k + 1)))
SELECT rollout_id, arg_max(phase, k) AS final_phase, arg_max(blocked, k) AS blocked, arg_max(path, k) AS path FROM r GROUP BY 1""")
def q_w6_phase_replay(spark, d):
    return sequence.replay_phases(_steps(spark, d, "executed_tool", "tool_success").select("rollout_id", "step_index", F.col("executed_tool").alias("tool"), F.col("tool_success").alias("success")), "rollout_id")


@query(f"""WITH {ST} SELECT rollout_id, md5(action) AS action_md5, count(*) AS times FROM st WHERE action IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def q_w7_repeated_calls(spark, d):
    s = _steps(spark, d, "action").withColumn("action", F.md5("action"))
    return sequence.repeated_calls(s, "rollout_id", "action").withColumnRenamed("action", "action_md5")


@query(f"""WITH {ST} SELECT rollout_id, step_index, coalesce(string_agg(executed_tool, '>') OVER (PARTITION BY rollout_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM st""")
def q_w9_prefix_history(spark, d):
    h = sequence.prefix_history(_steps(spark, d, "executed_tool"), "rollout_id", F.col("executed_tool"))
    return h.select("rollout_id", "step_index", F.array_join("history", ">").alias("history"))


@query("""SELECT repo, arg_min(instance_id, instance_id) AS instance_id, arg_min(task_id, (instance_id, task_id)) AS task_id FROM tasks WHERE repo IS NOT NULL AND instance_id IS NOT NULL GROUP BY 1""")
def q_w10_first_per_key(spark, d):
    t = table(spark, d, "tasks").filter("repo IS NOT NULL AND instance_id IS NOT NULL")
    # the first row of a key is a minimum, not a sort of a hot key
    return t.groupBy("repo").agg(F.min(F.struct("instance_id", "task_id")).alias("m")).select("repo", "m.instance_id", "m.task_id")


# ---- examples, budget ----------------------------------------------------------------------------------------------


@query(f"""WITH {ST}, s AS (SELECT rollout_id, step_index, coalesce(prompt_tokens, 0) + coalesce(generated_tokens, 0) AS tokens FROM st),
 w AS (SELECT *, sum(tokens) OVER (PARTITION BY rollout_id ORDER BY step_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix_tokens, row_number() OVER (PARTITION BY rollout_id ORDER BY step_index DESC) AS r FROM s)
SELECT rollout_id, step_index, suffix_tokens::BIGINT AS suffix_tokens FROM w WHERE suffix_tokens <= 8192 OR r <= 2""")
def q_t3_drop_oldest(spark, d):
    s = _steps(spark, d, "prompt_tokens", "generated_tokens").withColumn("tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("generated_tokens", F.lit(0)))
    return examples.drop_oldest(s, "rollout_id", "step_index", "tokens", 8192, keep=2).select("rollout_id", "step_index", "suffix_tokens")


@query(f"""WITH {TJ} SELECT traj_id, pos AS step_index, true AS fits, true AS counted FROM tj""")
def q_t3_budget_fit(spark, d):
    """What must hold of every step: what is kept fits the budget with the protected prompt, or the target alone does not; nothing is cut where all fits."""
    s = table(spark, d, "trajectories").select("traj_id", F.posexplode("steps").alias("step_index", "s"), text.token_estimate(F.coalesce("problem_statement", F.lit(""))).alias("fixed")).select("traj_id", "step_index", "fixed", "s.tool", "s.arguments", "s.observation")
    f = examples.fit_budget(s, "traj_id", 600, protected="fixed")
    whole = F.col("original_tokens") <= 600
    return f.select("traj_id", F.col("step_index").cast("long").alias("step_index"), F.coalesce(F.col("final_tokens") <= 600, F.lit(True)).alias("fits"), F.when(whole, (F.col("final_tokens") == F.col("original_tokens")) & (F.col("removed_history_steps") == 0)).otherwise(F.coalesce(F.col("final_tokens") < F.col("original_tokens"), F.lit(True))).alias("counted"))


@query(f"""WITH {TJ}, a AS (SELECT traj_id, pos, s.tool AS tool, s.phase AS phase, json_keys(s.arguments) AS k FROM tj)
SELECT traj_id, pos AS step_index, tool, phase FROM a WHERE NOT coalesce(len(list_filter(CASE tool WHEN 'search_code' THEN ['query'] WHEN 'read_file' THEN ['path'] WHEN 'apply_patch' THEN ['patch'] WHEN 'run_test' THEN ['command'] ELSE [] END, lambda x: NOT list_contains(k, x))) > 0
  OR len(list_filter(k, lambda x: NOT list_contains(CASE tool WHEN 'list_files' THEN ['path','max_entries'] WHEN 'search_code' THEN ['query','path','max_results'] WHEN 'read_file' THEN ['path','start_line','end_line'] WHEN 'apply_patch' THEN ['patch'] ELSE ['command'] END, x))) > 0
  OR NOT CASE phase WHEN 'LOCATE' THEN tool IN ('list_files','search_code') WHEN 'UNDERSTAND' THEN tool IN ('read_file','search_code') WHEN 'MODIFY' THEN tool = 'apply_patch' WHEN 'VERIFY' THEN tool = 'run_test' ELSE false END, true)""")
def q_e2_step_examples(spark, d):
    """Examples of all legal calls, with their target's tool."""
    e = examples.build_v2(table(spark, d, "trajectories").select("traj_id", "problem_statement", "steps"), "traj_id", 4096)
    return e.filter("coalesce(error, '') <> 'schema_invalid'").select("traj_id", F.col("step_index").cast("long").alias("step_index"), F.get_json_object("target", "$.tool").alias("tool"), "phase")


@query()
def q_e3_audited_examples(spark, d):
    """Examples of the trajectories without a bad step, with budget and checksum."""
    kept, _ = examples.audited_v2(examples.build_v2(table(spark, d, "trajectories").select("traj_id", "problem_statement", "steps"), "traj_id", 4096), "traj_id")
    return kept.select("traj_id", "step_index", "sha256", "original_tokens", "final_tokens", "removed_history_steps")


@query(f"""WITH t AS (SELECT traj_id, len(steps) AS n FROM trajectories WHERE len(steps) > 0) SELECT traj_id, true AS whole FROM t""")
def q_e3_examples_or_rejection(spark, d):
    """Every trajectory gives either all its examples or one rejection."""
    t = table(spark, d, "trajectories").select("traj_id", "problem_statement", "steps")
    kept, bad = examples.audited_v2(examples.build_v2(t, "traj_id", 4096), "traj_id")
    n = kept.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
    j = t.filter("size(steps) > 0").select("traj_id", F.size("steps").alias("steps")).join(n, "traj_id", "left").join(bad.select("traj_id", F.lit(1).alias("rejected")), "traj_id", "left")
    return j.select("traj_id", F.when(F.col("rejected").isNotNull(), F.col("n").isNull()).otherwise(F.col("n") == F.col("steps")).alias("whole"))


@query("""SELECT kind, count(*) AS rows, 1.0::DOUBLE / count(*) AS weight FROM documents GROUP BY 1""")
def q_t4_balanced_weights(spark, d):
    w = examples.balanced_weights(table(spark, d, "documents").select("doc_id", "kind"), "kind")
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.first("weight").alias("weight"))


@query("""WITH w AS (SELECT kind, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS w FROM documents) SELECT kind, round(sum(w) / (SELECT sum(w) FROM w), 9) AS share FROM w GROUP BY 1""")
def q_t6_expected_shares(spark, d):
    w = examples.balanced_weights(table(spark, d, "documents").select("doc_id", "kind"), "kind")
    return examples.expected_shares(w, "kind", "weight").withColumn("share", F.round("share", 9))


@query("SELECT 1000 AS draws, true AS balanced")
def q_t5_weighted_sample(spark, d):
    """What must hold of 1,000 draws balanced over the kinds: their number, and no kind further off than five standard deviations."""
    w = examples.balanced_weights(table(spark, d, "documents").select("doc_id", "kind"), "kind")
    s = examples.weighted_sample(w, "weight", 1000, "doc_id").groupBy("kind").agg(F.sum("times").alias("n"))
    n = F.count(F.lit(1))
    return s.agg(F.sum("n").alias("draws"), (F.max("n") - 1000 / n <= 5 * F.sqrt(1000 / n)).alias("balanced"))


@query("""SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents""")
def q_e5_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}')] AS ws FROM documents)), k AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS terms FROM documents LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""")
def q_e13_issue_terms(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.array_join(text.issue_terms(F.col("text")), " ")).alias("terms"))


@query("""WITH i AS (SELECT task_id, repo, list_distinct([lower(x) for x in regexp_extract_all(problem_statement, '[A-Za-z_][A-Za-z0-9_]{3,}')]) AS terms FROM tasks WHERE repo IS NOT NULL AND problem_statement IS NOT NULL),
 f AS (SELECT DISTINCT repo, path FROM (SELECT repo, unnest(modified_files) AS path FROM rollouts)),
 s AS (SELECT task_id, path, 10 * len(list_filter(terms, lambda t: contains(lower(path), t))) + 2 * regexp_matches(lower(path), '\\.(py|js|ts|java|c|cc|cpp|h|go|rs|rb)$')::INT + contains(lower(path), 'test')::INT AS score FROM i JOIN f USING (repo)),
 r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS rank FROM s) SELECT task_id, path, score, rank FROM r WHERE rank <= 5""")
def q_e12_rank_files(spark, d):
    """The report keeps the five best files of each task."""
    tasks = table(spark, d, "tasks").filter("repo IS NOT NULL AND problem_statement IS NOT NULL")
    files = table(spark, d, "rollouts").select("repo", F.explode("modified_files").alias("path")).distinct()
    return compare.rank_files(tasks, files, "task_id", text.issue_terms(F.col("problem_statement")), top=5).select("task_id", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SFT} SELECT sum(n + CASE WHEN trim(answer, E' \\n\\t\\r') <> '' THEN 1 ELSE 0 END)::BIGINT AS examples, true AS masks_prompt, true AS keeps_target, true AS cut FROM bs""")
def q_t2_label_mask(spark, d):
    """What must hold of all examples in tokens: the mask covers the prompt's tokens, the rest are the target's, and at most the last 2,048 are kept."""
    e = examples.expand_v1(_sft(spark, d), "traj_id")
    t = e.select(tokens.token_ids(F.col("prompt")).alias("p"), tokens.token_ids(F.col("target")).alias("t")).withColumn("f", F.concat("p", "t"))
    m = examples.mask_labels(t, "p", "f")
    masked = F.size(F.filter("labels", lambda x: x == -100))
    return m.agg(F.count(F.lit(1)).alias("examples"), F.every((masked == F.size("p")) & F.col("prefix_ok")).alias("masks_prompt"), F.every(F.slice("labels", F.size("p") + 1, F.size("f")) == F.col("t")).alias("keeps_target"), F.every(F.size(examples.keep_last(F.col("labels"), 2048)) <= 2048).alias("cut"))


# ---- splits, duplicates --------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT *, {SPLIT_CASE} AS sp FROM tasks), l AS (SELECT 'base_commit' AS key, base_commit AS value, sp FROM t UNION ALL SELECT 'instance_id', instance_id, sp FROM t UNION ALL SELECT 'repo', repo, sp FROM t)
SELECT key, value, string_agg(DISTINCT sp, ',' ORDER BY sp) AS splits FROM l WHERE value IS NOT NULL AND sp IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT sp) > 1""")
def q_u3_overlap_audit(spark, d):
    return splits.overlap_audit(table(spark, d, "tasks").withColumn("sp", _split_name(F.col("split"))), "sp", ["base_commit", "instance_id", "repo"])


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def q_u4_duplicate_groups(spark, d):
    return splits.duplicate_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""")
def q_u4_exact_dedup(spark, d):
    return splits.exact_dedup(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text")).select("doc_id")


@query("""WITH e AS (SELECT DISTINCT instance_id FROM tasks WHERE instance_id IS NOT NULL), f AS (SELECT instance_id FROM task_refs WHERE instance_id IS NOT NULL)
SELECT instance_id, 'missing' AS problem FROM e WHERE instance_id NOT IN (SELECT instance_id FROM f) UNION ALL SELECT DISTINCT instance_id, 'unexpected' FROM f WHERE instance_id NOT IN (SELECT instance_id FROM e)
UNION ALL SELECT instance_id, 'duplicate' FROM f GROUP BY 1 HAVING count(*) > 1""")
def q_u6_set_differences(spark, d):
    return splits.set_differences(table(spark, d, "tasks"), table(spark, d, "task_refs"), "instance_id")


@query("""WITH RECURSIVE c AS (SELECT repo, count(*) AS n, row_number() OVER (ORDER BY repo) AS i FROM heldout_items WHERE split = 'validation' GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS k FROM c),
 m AS (SELECT 0 AS i, 0::BIGINT AS mask, 0::BIGINT AS rows, 0 AS size, '' AS names UNION ALL SELECT c.i, m.mask + (CASE WHEN b THEN 1 << (c.i - 1)::INT ELSE 0 END), m.rows + (CASE WHEN b THEN c.n ELSE 0 END), m.size + (CASE WHEN b THEN 1 ELSE 0 END), m.names || (CASE WHEN b THEN CASE WHEN m.names = '' THEN '' ELSE ',' END || c.repo ELSE '' END)
   FROM m JOIN c ON c.i = m.i + 1, (SELECT unnest([true, false]) AS b))
SELECT names AS validation_groups, rows AS validation_rows, total - rows AS train_rows FROM m, t WHERE i = k AND mask > 0 AND mask < (1 << k::INT) - 1 AND rows >= 8 AND total - rows >= 40 ORDER BY abs(rows - total * 0.2), size, mask LIMIT 1""")
def q_u1_split_search(spark, d):
    """Repositories of the held-out validation items."""
    c = metrics.distribution(table(spark, d, "heldout_items").filter("split = 'validation'"), "repo")
    return splits.search_group_split_df(c, "repo", "n", 40, 8)


@query("""WITH o AS (SELECT task_id, row_number() OVER (ORDER BY sha256('42/' || task_id), task_id) - 1 AS position FROM tasks) SELECT task_id, position, CASE WHEN position < 50 THEN 'train' ELSE 'validation' END AS split FROM o WHERE position < 60""")
def q_t10_seeded_split(spark, d):
    return splits.seeded_train_split(table(spark, d, "tasks").select("task_id"), "task_id", 60, 50, 42)


@query("""WITH t AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 4), r AS (SELECT doc_id, kind, sha256('42/' || doc_id) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)), p AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, doc_id) AS n FROM r) WHERE n <= 2),
 c AS (SELECT count(*) AS n FROM t), k AS (SELECT count(*) AS n FROM p), f AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, 'longest' AS reason FROM t UNION ALL SELECT doc_id, 'phase' FROM p UNION ALL SELECT doc_id, 'fill' FROM f WHERE n <= 40 - (SELECT n FROM c) - (SELECT n FROM k)""")
def q_t11_smoke_subset(spark, d):
    return splits.smoke_subset(table(spark, d, "documents").select("doc_id", "kind", "n_chars"), "doc_id", "n_chars", "kind", count=40)


@query(f"""WITH t AS (SELECT {SPLIT_CASE} AS sp, task_id FROM tasks) SELECT sp AS split, count(*) AS n FROM t WHERE sp IN ('train') GROUP BY 1 UNION ALL SELECT sp, count(*) FROM t WHERE sp IN ('validation', 'test') GROUP BY 1""")
def q_u7_union(spark, d):
    t = table(spark, d, "tasks").select(_split_name(F.col("split")).alias("split"))
    return t.filter("split = 'train'").unionByName(t.filter("split IN ('validation', 'test')")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- comparison ----------------------------------------------------------------------------------------------------

ARMS = """am AS (SELECT instance_id, arm, bool_or(success) AS success, bool_or(rollout_test_passed) AS tested, min(token_usage.total_tokens) AS tokens FROM ro WHERE instance_id IS NOT NULL GROUP BY 1, 2)"""


def _arms(spark, d):
    r = _rollouts(spark, d, "instance_id", "arm", "success", "rollout_test_passed", "token_usage").filter("instance_id IS NOT NULL")
    return r.groupBy("instance_id", "arm").agg(F.bool_or("success").alias("success"), F.bool_or("rollout_test_passed").alias("tested"), F.min("token_usage.total_tokens").alias("tokens"))


OUT = "CASE WHEN coalesce(o.{c}, false) AND NOT coalesce(b.{c}, false) THEN 'improved' WHEN coalesce(b.{c}, false) AND NOT coalesce(o.{c}, false) THEN 'regressed' ELSE 'same' END AS {c}_outcome"


@query(f"""WITH {RO}, {ARMS} SELECT instance_id, {OUT.format(c='success')}, {OUT.format(c='tested')}, o.tokens - b.tokens AS tokens_delta, CASE WHEN o.tokens < b.tokens THEN 'improved' WHEN o.tokens > b.tokens THEN 'regressed' ELSE 'same' END AS tokens_outcome
FROM (SELECT * FROM am WHERE arm = 'base') b JOIN (SELECT * FROM am WHERE arm = 'sft') o USING (instance_id)""")
def q_j1_pairwise(spark, d):
    a = _arms(spark, d)
    return compare.pairwise(a.filter("arm = 'base'").drop("arm"), a.filter("arm = 'sft'").drop("arm"), "instance_id", ["success", "tested"], ["tokens"])


@query("""SELECT t.task_id, t.instance_id, r.records, r.records IS NOT NULL AS present FROM (SELECT task_id, instance_id FROM tasks) t LEFT JOIN (SELECT instance_id, count(*) AS records FROM rollouts GROUP BY 1) r USING (instance_id)""")
def q_j3_left_expected(spark, d):
    return compare.left_expected(table(spark, d, "tasks").select("task_id", "instance_id"), table(spark, d, "rollouts"), "instance_id")


@query("""SELECT task_id FROM tasks WHERE instance_id IN (SELECT instance_id FROM task_refs)""")
def q_j7_semi_join(spark, d):
    return table(spark, d, "tasks").join(table(spark, d, "task_refs").select("instance_id"), "instance_id", "left_semi").select("task_id")


@query(f"""WITH {RO}, a AS (SELECT arm, count(*)::DOUBLE AS rollouts, avg(success::INT) AS success_rate, avg(token_usage.total_tokens) AS avg_tokens FROM ro GROUP BY 1),
 u AS (UNPIVOT a ON rollouts, success_rate, avg_tokens INTO NAME metric VALUE value) SELECT o.metric, o.value AS old, n.value AS new, n.value - o.value AS delta FROM (SELECT * FROM u WHERE arm = 'base') o FULL OUTER JOIN (SELECT * FROM u WHERE arm = 'sft') n ON o.metric = n.metric""")
def q_j8_metric_table(spark, d):
    a = _rollouts(spark, d, "arm", "success", "token_usage").groupBy("arm").agg(F.count(F.lit(1)).alias("rollouts"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("token_usage.total_tokens").alias("avg_tokens"))
    u = metrics.unpivot_metrics(a, ["arm"], ["rollouts", "success_rate", "avg_tokens"])
    return compare.metric_table(u.filter("arm = 'base'"), u.filter("arm = 'sft'"))


# ---- sources -------------------------------------------------------------------------------------------------------


@query("""SELECT instance_id, max(source_file) AS source_file FROM task_refs WHERE instance_id IS NOT NULL GROUP BY 1""")
def q_s11_last_file(spark, d):
    r = table(spark, d, "task_refs").filter("instance_id IS NOT NULL")
    return compare.index_by_last(r.select("instance_id", "source_file"), "instance_id", "source_file")


@query("""SELECT task_id, coalesce(instance_id, '') AS instance_id, coalesce(repo, '') AS repo, coalesce(base_commit, '') AS base_commit, coalesce(problem_statement, '') AS problem_statement, coalesce(test_patch, '') AS test_patch, coalesce(hints, '') AS hints FROM tasks""")
def q_s13_task_projection(spark, d):
    # the reader's projection keeps the six text columns; the id is carried beside them
    t = table(spark, d, "tasks")
    return readers.task_projection(t, keep=["task_id"])


@query("""SELECT instance_id, arm FROM rollouts GROUP BY 1, 2 HAVING NOT bool_or(coalesce(success, false))""")
def q_s24_pending(spark, d):
    r = table(spark, d, "rollouts")
    todo = r.select("instance_id", "arm").distinct()
    done = r.filter("success").select("instance_id", "arm")
    return compare.todo(todo, done, ["instance_id", "arm"])


@query("""WITH j AS (SELECT '{"base_commit":' || coalesce(to_json(base_commit)::VARCHAR, 'null') || ',"instance_id":' || coalesce(to_json(instance_id)::VARCHAR, 'null') || ',"repo":' || coalesce(to_json(repo)::VARCHAR, 'null') || ',"source_file":' || coalesce(to_json(source_file)::VARCHAR, 'null') || '}' AS j FROM task_refs)
SELECT count(*) AS rows, sha256(count(*) || '/' || sum(('0x' || substr(sha256(j), 1, 15))::BIGINT)::HUGEINT) AS checksum FROM j""")
def q_s22_table_checksum(spark, d):
    return readers.table_checksum(table(spark, d, "task_refs"))