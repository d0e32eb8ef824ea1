"""First-match-wins ladders and set-valued labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.calls import call_status
from stepmill.functions.dims import ACTION_ENVIRONMENT, CALLS, PLANNING_ENVIRONMENT, PLANNING_TIMEOUT, ROLLOUT_ENVIRONMENT, ROLLOUT_TIMEOUT, TOOL_USAGE_ENVIRONMENT, WRITES
from stepmill.functions.text import action_name, call_arguments, has_changes, normal_name, strip, tool_of


def first_match(ladder: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first condition that is true; NULL conditions do not match."""
    c, label = ladder[0]
    out = F.when(F.coalesce(c, F.lit(False)), label)
    for c, label in ladder[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), label)
    return out.otherwise(F.lit(otherwise))


def all_matches(labels: Sequence[tuple[Column, str]]) -> Column:
    """Sorted array of all labels whose condition is true."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), l) for c, l in labels))))


def primary_of(labels: Column, precedence: Sequence[str], default: str = "unknown") -> Column:
    """The label that comes first in the precedence."""
    return F.coalesce(F.get(F.filter(F.array(*(F.lit(p) for p in precedence)), lambda p: F.array_contains(labels, p)), F.lit(0)), F.lit(default))


def test_state(result: Column) -> Column:
    """passed, failed or missing (also where `passed` is NULL)."""
    return F.when(result["passed"], "passed").when(~result["passed"], "failed").otherwise("missing")


def boolean_outcome(base: Column, other: Column) -> Column:
    b, o = F.coalesce(base, F.lit(False)), F.coalesce(other, F.lit(False))
    return F.when(o & ~b, "improved").when(b & ~o, "regressed").otherwise("same")


def action_failure(tool: Column, observation: Column, success: Column, truncated: Column, arguments_status: Column) -> Column:
    """Failure class of one step, NULL if there is none; the order of the ladder is part of the definition.

    Only what an observation says makes a step blocked or without result; other classes need a tool that failed.
    """
    text = F.coalesce(observation, F.lit(""))
    o, failed = F.lower(text), F.coalesce(~success, F.lit(False))
    patch = failed & (tool == "apply_patch")
    return first_match([
        (truncated, "generation_truncated"),
        (arguments_status == "unknown_tool", "unknown_tool"),
        (arguments_status == "invalid_json", "invalid_json"),
        (arguments_status == "missing_argument", "missing_argument"),
        (arguments_status.isNotNull(), "schema_error"),
        (o.contains("planning controller blocked"), "controller_blocked"),
        ((tool == "search_code") & (strip(o) == "no matches"), "search_no_result"),
        (failed & (tool == "run_test") & text.rlike(ACTION_ENVIRONMENT), "test_environment_error"),
        (failed & o.contains("path escapes workspace"), "wrong_path"),
        (failed & (o.contains("path does not exist") | o.contains("not a file") | o.contains("target is not an existing file")), "file_not_found"),
        (patch & (o.contains("no valid file headers") | o.contains("creating or deleting files is not allowed")), "patch_parse_error"),
        (patch & o.contains("apply_patch failed:"), "git_apply_check_failed"),
        (failed, "other_tool_error"),
    ])


def arguments_status(df: DataFrame, action: str, proposed: str, status: str = "arguments_status") -> DataFrame:
    """Adds what is wrong with the call itself, for action_failure: unknown_tool, invalid_json (an `invalid(` action), missing_argument or schema_error.

    The proposed tool counts, aliases repaired; without one only an `invalid(` action has a status. Arguments that are no strict JSON object are a schema_error.
    """
    # columns of their own, so that they are made once a row; the action has to end with the parenthesis
    d = df.withColumn("__tool", tool_of(F.col(proposed))).withColumn("__args", F.when(F.col(action).endswith(")"), call_arguments(F.col(action))))
    # the parser of call_status takes text after the object; such text can close or go on in an array or in an object, never in both
    whole = F.regexp_like("__args", F.lit(r"(?s)\A\s*\{.*\}\s*\z"))
    for left, right in (("[", "]"), ('{"x":', "}")):
        whole &= F.try_parse_json(F.concat(F.lit(left), "__args", F.lit(right))).isNotNull()
    d = d.withColumn("__args", F.when(whole, F.col("__args"))).withColumn("__s", call_status(F.col("__tool"), F.col("__args")))
    unknown = F.coalesce(normal_name(F.col(proposed)) != "", F.lit(False)) & F.col("__tool").isNull()
    s = F.when(unknown, "unknown_tool").when(F.coalesce(F.col(action).startswith("invalid("), F.lit(False)), "invalid_json").when(F.col("__tool").isNull(), F.lit(None).cast("string"))
    s = s.when(F.col("__s") == "missing_argument", "missing_argument").when(F.col("__s").isNotNull(), "schema_error")
    return d.withColumn(status, s).drop("__tool", "__args", "__s")


def call_failed(name: Column, observation: Column) -> Column:
    """Whether the observation of a call tells its failure; false for anything that is no call. name: action_name of the step."""
    o = F.lower(F.coalesce(observation, F.lit("")))
    said = lambda *ends: F.array_contains(F.transform(F.array(*(F.lit(e) for e in ends)), lambda e: F.contains(o, F.concat(name, e))), True)
    failed = F.when(name == "read_file", said(" failed:") | o.contains("not a file:")).when(name.isin(*WRITES), said(" failed:", " refused:")).when(name == "run_test", said(" failed:", " refused")).otherwise(said(" failed:"))
    return F.coalesce(name.isin(*CALLS) & failed, F.lit(False))


def rollout_signals(action: Column, executed: Column, observation: Column, invalid: Column) -> dict[str, Column]:
    """Flags of a step that rollout_failure and the rollout summaries aggregate. They are short, so observations need not be moved.

    A step wrote if its action or the tool that was executed for it writes.
    """
    name, o = action_name(action), F.coalesce(observation, F.lit(""))
    failed, wrote = call_failed(name, observation), F.coalesce(name.isin(*WRITES), F.lit(False)) | F.coalesce(executed == "apply_patch", F.lit(False))
    return {
        "invalid": F.coalesce(invalid, F.lit(False)), "late": o.rlike(ROLLOUT_TIMEOUT), "environment": o.rlike(ROLLOUT_ENVIRONMENT), "error_step": F.coalesce(name == "error", F.lit(False)),
        "wrote": wrote, "write_failed": name.isin(*WRITES) & failed, "tool_failed": failed, "is_call": F.coalesce(name.isin(*CALLS), F.lit(False)),
    }


def rollout_failure(success: Column, flags: dict[str, Column], patch: Column, modified: Column, result: Column) -> Column:
    """Reason of a failed rollout, NULL for a successful one. flags: rollout_signals, true where any step has them.

    Timeouts and environment errors count wherever they are told: in an observation, in the result's output or in its
    policy error. A result that does not say `passed` is a failed test.
    """
    flag = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    told = F.concat(F.coalesce(result["output"], F.lit("")), F.lit("\n"), F.coalesce(result["policy_error"], F.lit("")))
    reason = first_match([
        (flag["invalid"], "invalid_action"),
        (flag["late"] | told.rlike(ROLLOUT_TIMEOUT), "timeout"),
        (flag["environment"] | flag["error_step"] | told.rlike(ROLLOUT_ENVIRONMENT), "environment_error"),
        (flag["write_failed"], "patch_failed"),
        (flag["tool_failed"], "tool_error"),
        (~has_changes(patch), "no_patch"),
        (flag["wrote"] & (F.coalesce(F.size(modified), F.lit(0)) <= 0), "patch_failed"),
        (result.isNull(), "environment_error"),
        (~F.coalesce(result["passed"], F.lit(False)), "test_failed"),
    ], "patch_failed")
    return F.when(~F.coalesce(success, F.lit(False)), reason)


def tool_usage_failure(success: Column, attempts_failed: Column, patch: Column, result: Column, planning_error: Column) -> Column:
    """Reason of a failed rollout in the tool-usage analysis: patch, environment, tests, planning, no patch."""
    environment = result.isNull() | F.coalesce(result["output"].rlike(TOOL_USAGE_ENVIRONMENT), F.lit(False))
    reason = first_match([(attempts_failed, "patch_failed"), (environment, "environment_error"), (has_changes(patch), "test_failed"), (planning_error, "planning_error")], "no_patch")
    return F.when(~F.coalesce(success, F.lit(False)), reason)


def planning_signals(action: Column, executed: Column, observation: Column, success: Column, invalid: Column, intervened: Column, reason: Column, phase: Column, previous: Column) -> dict[str, Column]:
    """Flags of a step that planning_failure aggregates."""
    error, tool, o = F.coalesce(action_name(action) == "error", F.lit(False)), action_name(executed), F.coalesce(observation, F.lit(""))
    patch, own = F.coalesce(tool == "apply_patch", F.lit(False)), F.coalesce(reason != "final_verification", F.lit(True))
    diagnostic = error | F.coalesce(tool == "run_test", F.lit(False))
    return {
        "late": o.rlike(PLANNING_TIMEOUT), "environment": diagnostic & o.rlike(PLANNING_ENVIRONMENT), "error_step": error, "attempted": patch,
        "valid_patch": patch & F.coalesce(success, F.startswith(F.lower(o), F.lit("applied patch to "))), "stopped": F.coalesce(invalid, F.lit(False)) | F.coalesce(intervened, F.lit(False)),
        "any_phase": own & (phase.isNotNull() | previous.isNotNull()), "in_modify": own & (F.coalesce(phase == "MODIFY", F.lit(False)) | F.coalesce(previous == "MODIFY", F.lit(False))),
    }


def planning_failure(success: Column, flags: dict[str, Column], repeated: Column, patch: Column, result: Column) -> Column:
    """Reason of a failed rollout in the planning analysis. flags: planning_signals, true where any step has them; repeated: repeated exploration.

    Planning errors are invalid or intervened steps, repeated exploration and a rollout that never reached MODIFY, told
    by the recorded phases or, where there are none, by an attempted patch.
    """
    flag = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    told = F.concat(F.coalesce(result["output"], F.lit("")), F.lit("\n"), F.coalesce(result["policy_error"], F.lit("")))
    reached = F.when(flag["any_phase"], flag["in_modify"]).otherwise(flag["attempted"])
    ladder = first_match([
        (flag["late"] | told.rlike(PLANNING_TIMEOUT), "timeout"),
        (flag["environment"] | flag["error_step"] | told.rlike(PLANNING_ENVIRONMENT), "environment_error"),
        (flag["attempted"] & ~flag["valid_patch"], "patch_failed"),
        (flag["valid_patch"] | has_changes(patch), "test_failed"),
        (flag["stopped"] | F.coalesce(repeated, F.lit(False)) | ~reached, "planning_error"),
    ], "no_patch")
    return F.when(~F.coalesce(success, F.lit(False)), ladder)


def zero_filled(counts: DataFrame, column: str, labels: Sequence[str], by: list[str]) -> DataFrame:
    """Counts for every label of a fixed list in every group, zeros kept; labels beyond the list stay."""
    groups = counts.select(*by).distinct()
    dim = groups.select(*by, F.explode(F.array(*(F.lit(x) for x in labels))).alias(column))
    return dim.join(counts, [*by, column], "full_outer").select(*by, column, F.coalesce("n", F.lit(0)).alias("n"))
