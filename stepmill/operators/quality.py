"""Quality gates of recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.text import has_patch, patch_has_body, patch_headers

#: A run that changes more files than this is refused.
MAX_FILES = 3


def last_patch(steps: Column) -> Column:
    """Text of the last apply_patch call of an array of steps; '' if there is none."""
    last = F.get(F.reverse(F.filter(steps, lambda s: s["tool"] == "apply_patch")), F.lit(0))
    return F.coalesce(F.get_json_object(last["arguments"], "$.patch"), F.lit(""))


def quality_issues(steps: Column, patch: Column, max_files: int = MAX_FILES) -> Column:
    """Array of what a run lacks: a test, a passed last test, a patch with a body, a bounded number of changed files."""
    steps = F.coalesce(steps, F.array())
    tests = F.filter(steps, lambda s: s["tool"] == "run_test")
    passed = F.coalesce(F.get(F.reverse(tests), F.lit(0))["tool_success"], F.lit(False))
    files = F.size(patch_headers(patch))
    return F.array_compact(F.array(
        F.when(F.size(tests) == 0, "missing_test"),
        F.when((F.size(tests) > 0) & ~passed, "final_test_failed"),
        F.when(~has_patch(patch) | ~patch_has_body(patch), "empty_patch"),
        F.when(files > max_files, F.concat(F.lit("too_many_modified_files:"), files.cast("string"), F.lit(f">{max_files}"))),
    ))


def quality_filter(df: DataFrame, steps: str, patch: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Runs without an issue; the patch is a column or that of the last apply_patch call."""
    text = F.col(patch) if patch else last_patch(F.coalesce(steps, F.array()))
    return df.filter(F.size(quality_issues(F.col(steps), text, max_files)) == 0)
