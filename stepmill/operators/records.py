"""Record projections with their reject channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.calls import call_status, phase_allows
from stepmill.functions.text import strip


def recorder_record(rollouts: DataFrame) -> DataFrame:
    """The recorded form: modified files sorted, defaults for absent results and usage, the host's result from the rollout's."""
    usage = F.coalesce("token_usage", F.struct(*(F.lit(0).cast("long").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens"))))
    return rollouts.withColumn("modified_files", F.array_sort(F.coalesce("modified_files", F.array().cast("array<string>")))).withColumn("rollout_test_passed", F.coalesce("rollout_test_passed", "success")).withColumn("host_test_result", F.coalesce("host_test_result", "test_result")).withColumn("token_usage", usage)


def final_status(success: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(success, "success").otherwise("fail")


def rejection(df: DataFrame, key: str, reason: Column, detail: Column) -> DataFrame:
    """(key, reason, detail, leakage_types) of the rows with a reason; leakage types are what a detail lists after `contains:`."""
    types = F.when(reason == "prompt_leakage", F.filter(F.transform(F.split(F.split_part(detail, F.lit("contains:"), F.lit(2)), ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return df.filter(reason.isNotNull()).select(key, reason.alias("reason"), detail.alias("detail"), types.alias("leakage_types"))


def expert_status(steps: Column, split: Column) -> Column:
    """Why an expert trajectory is refused, NULL if it is not: schema_invalid, split_mismatch, tool_error, observation_not_real."""
    legal = F.forall(steps, lambda s: call_status(s["tool"], s["arguments"], bounds=False).isNull() & phase_allows(s["phase"], s["tool"]))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "schema_invalid").when(~F.coalesce(split.isin("train", "validation"), F.lit(False)), "split_mismatch").when(~legal, "schema_invalid").when(~F.forall(steps, lambda s: F.coalesce(s["tool_success"], F.lit(False))), "tool_error").when(F.exists(steps, lambda s: strip(F.coalesce(s["observation"], F.lit(""))) == ""), "observation_not_real")


def all_or_nothing(df: DataFrame, group: str, bad: Column) -> DataFrame:
    """Rows of groups without a bad row. Bad groups are found by aggregation and anti-joined, so a large group needs no window."""
    return df.join(df.filter(F.coalesce(bad, F.lit(False))).select(group).distinct(), group, "left_anti")


def phase_counts(df: DataFrame, epoch: str, phase: str) -> DataFrame:
    return df.groupBy(epoch, phase).agg(F.count(F.lit(1)).alias("n"))


def within_prefix(df: DataFrame, key: str, order: str, value: str, fields: Sequence[str] = ()) -> DataFrame:
    """Running totals of a value per key, up to and including the row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, order, *fields, F.sum(value).over(w).alias(f"running_{value}"))
