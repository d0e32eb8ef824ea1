"""Per-rollout records of a held-out comparison, their totals per arm and two-arm tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.actions import is_model_step
from stepmill.functions.dims import ACTION_ENVIRONMENT, TOOLS
from stepmill.functions.text import guarded_ratio, has_changes, normal_name, tool_of
from stepmill.operators import classify, sequence

#: Action failures behind each label of a rollout, in order of precedence (fixed values).
PROTOCOL = ("invalid_json", "unknown_tool", "schema_error", "missing_argument")
PRECEDENCE = ("protocol_error", "generation_truncation", "patch_generation_error", "patch_application_error", "environment_error", "planning_error", "no_patch")


def host_test(host: Column, own: Column) -> Column:
    """passed, environment_error, failed_non_environment or not_executed, of the host's test result or else the rollout's own."""
    r = F.coalesce(host, own)
    environment = F.coalesce(r["output"], F.lit("")).rlike(ACTION_ENVIRONMENT)
    return F.when(r.isNull(), "not_executed").when(r["passed"], "passed").when(environment, "environment_error").otherwise("failed_non_environment")


def step_facts(steps: DataFrame) -> DataFrame:
    """Adds to every step its failure class and 0/1 facts, short enough that texts need not be moved afterwards."""
    s = classify.arguments_status(steps, "action", "model_proposed_tool")
    failure = classify.action_failure(F.col("executed_tool"), F.col("observation"), F.col("tool_success"), F.col("generation_truncated"), F.col("arguments_status"))
    name = normal_name(F.col("model_proposed_tool"))
    proposed = F.coalesce(name != "", F.lit(False))
    invalid = F.coalesce(F.col("action").startswith("invalid("), F.lit(False))
    model = is_model_step(F.col("executed_tool"), F.when(proposed, name), F.col("action"), F.col("intervention_reason"))
    known, own = F.coalesce(F.col("executed_tool").isin(*TOOLS), F.lit(False)), F.coalesce(F.col("intervention_reason") != "final_verification", F.lit(True))
    ok, patch = F.coalesce("tool_success", F.lit(False)), F.coalesce(F.col("executed_tool") == "apply_patch", F.lit(False))
    phase = lambda p: own & (F.coalesce(F.col("phase") == p, F.lit(False)) | F.coalesce(F.col("previous_phase") == p, F.lit(False)))
    facts = {
        "model_actions": model, "tool_invocations": known, "tool_successes": known & ok, "json_valid": model & ~invalid, "registered": model & F.coalesce(name.isin(*TOOLS), F.lit(False)),
        "schema_valid": model & tool_of(F.col("model_proposed_tool")).isNotNull() & F.col("arguments_status").isNull(), "interventions": F.coalesce("controller_intervened", F.lit(False)),
        "proposed": model & proposed, "agreements": model & proposed & F.coalesce(name == F.col("executed_tool"), F.lit(False)), "generations": model & F.col("generated_tokens").isNotNull(),
        "truncations": model & F.coalesce("generation_truncated", F.lit(False)), "patch_attempts": patch, "patch_successes": patch & ok,
        "reached_understand": phase("UNDERSTAND"), "reached_modify": phase("MODIFY"), "reached_verify": phase("VERIFY"),
    }
    return s.withColumns({"failure": failure, **{k: v.cast("long") for k, v in facts.items()}, "tokens": F.when(model, F.coalesce("generated_tokens", F.lit(0))).otherwise(0)})


SUMS = ("model_actions", "tool_invocations", "tool_successes", "json_valid", "registered", "schema_valid", "interventions", "proposed", "agreements", "generations", "truncations", "patch_attempts", "patch_successes", "tokens")
REACHED = ("reached_understand", "reached_modify", "reached_verify")
FAILURES = {"protocol": PROTOCOL, "truncated": ("generation_truncated",), "patch_parse": ("patch_parse_error",), "patch_apply": ("git_apply_check_failed",)}


def task_records(steps: DataFrame, rollouts: DataFrame) -> DataFrame:
    """One record per rollout: counts over its steps, phases reached, host test, primary failure and all failures.

    steps: facts of valid steps (step_facts); rollouts: rollout_id, arm, patch, test_result, host_test_result. A rollout
    without steps has zeros. Counts are combinable, only the repeats need the order of a rollout's steps.
    """
    failed = {k: F.count_if(F.coalesce(F.col("failure").isin(*v), F.lit(False))).alias(k) for k, v in FAILURES.items()}
    per = steps.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("steps"), *(F.sum(c).alias(c) for c in SUMS), *((F.max(c) > 0).alias(c) for c in REACHED), *failed.values())
    again = sequence.consecutive_repeats(steps, "rollout_id", "executed_tool", list(TOOLS), ["list_files", "search_code"]).groupBy("rollout_id").agg(F.sum("repeats").alias("repeats"))
    r = rollouts.join(per, "rollout_id", "left").join(again, "rollout_id", "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("steps", "repeats", *SUMS, *FAILURES)} | {c: F.coalesce(c, F.lit(False)) for c in REACHED})
    r = r.withColumn("final_patch", has_changes(F.col("patch"))).withColumn("host_test", host_test(F.col("host_test_result"), F.col("test_result")))
    labels = classify.all_matches([
        (F.col("protocol") > 0, "protocol_error"),
        (F.col("truncated") > 0, "generation_truncation"),
        (F.col("patch_parse") > 0, "patch_generation_error"),
        ((F.col("patch_apply") > 0) | ((F.col("patch_attempts") > 0) & (F.col("patch_successes") == 0)), "patch_application_error"),
        (F.col("host_test") == "environment_error", "environment_error"),
        ((F.col("interventions") > 0) | (F.col("repeats") > 0) | ~F.col("reached_modify"), "planning_error"),
        (~F.col("final_patch"), "no_patch"),
    ])
    r = r.withColumn("failures", labels)
    return r.withColumn("primary_failure", classify.primary_of(F.col("failures"), PRECEDENCE))


def totals(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals and guarded rates of task_records per group."""
    s, n = lambda c: F.sum(F.col(c).cast("long")), F.count(F.lit(1))
    rate = lambda a, b: guarded_ratio(s(a), s(b) if isinstance(b, str) else b)
    return records.groupBy(*by).agg(
        n.alias("trajectories"), s("model_actions").alias("model_actions"), rate("json_valid", "model_actions").alias("json_valid_rate"), rate("registered", "model_actions").alias("registered_rate"), rate("schema_valid", "model_actions").alias("schema_valid_rate"),
        rate("tool_successes", "tool_invocations").alias("tool_success_rate"), rate("interventions", "steps").alias("intervention_rate"), rate("agreements", "proposed").alias("agreement_rate"), rate("repeats", "model_actions").alias("repeat_rate"),
        guarded_ratio(s("steps"), n).alias("average_steps"), rate("tokens", "generations").alias("average_generated_tokens"), rate("truncations", "generations").alias("truncation_rate"), *(guarded_ratio(s(c), n).alias(f"{c}_rate") for c in REACHED),
        guarded_ratio(F.count_if(F.col("patch_attempts") > 0), n).alias("patch_attempt_rate"), guarded_ratio(F.count_if(F.col("patch_successes") > 0), n).alias("valid_patch_rate"), rate("patch_successes", "patch_attempts").alias("patch_success_rate"), guarded_ratio(s("final_patch"), n).alias("final_patch_rate"),
    )


def metric_rows(totals: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(metric, position, group, value): the totals as rows, in the order in which a report shows them."""
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.lit(i).alias("position"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)))
    return totals.select(F.col(by).alias("group"), F.explode(rows).alias("r")).select("r.metric", "r.position", "group", "r.value")


def two_arms(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(position, metric, base, other, delta) of metric_rows for two groups; a group that is absent has NULL."""
    v = lambda g: F.max(F.when(F.col("group") == g, F.col("value")))
    return rows.groupBy("position", "metric").agg(v(base).alias("base"), v(other).alias("other"), (v(other) - v(base)).alias("delta"))


def comparison_lines(table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(position, line): the rows of two_arms as lines of a Markdown table, values with four digits, `-` where there is none."""
    cell = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("-"))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("metric")], F.col("metric")) if names else F.col("metric")
    return table.select("position", F.concat_ws(" | ", F.concat(F.lit("| "), label), cell("base"), cell("other"), F.concat(cell("delta"), F.lit(" |"))).alias("line"))
