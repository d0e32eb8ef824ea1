"""Ladders of the analyses, examples of the second version, reading by file name, draws, prompts."""

import json

import pytest
from pyspark.sql import functions as F

from stepmill.functions import text
from stepmill.operators import classify, compare, examples
from stepmill.plans import prompts

RESULT = "struct<command: string, passed: boolean, output: string, policy_error: string>"


def result(passed=False, output="1 failed", error=None):
    return (None, passed, output, error)


@pytest.mark.parametrize(
    "success,flags,patch,modified,res,want",
    [
        (True, {"invalid"}, None, None, None, None),
        (False, {"invalid", "late"}, "+x", ["a"], result(), "invalid_action"),
        (False, {"late", "environment"}, "+x", ["a"], result(), "timeout"),
        (False, set(), "+x", ["a"], result(output="it timed out"), "timeout"),
        (False, set(), "+x", ["a"], result(error="TimeoutExpired"), "timeout"),
        (False, {"error_step"}, "+x", ["a"], result(), "environment_error"),
        (False, {"write_failed", "tool_failed"}, "+x", ["a"], result(), "patch_failed"),
        (False, {"tool_failed"}, "+x", ["a"], result(), "tool_error"),
        (False, set(), " (no changes)\n", ["a"], result(), "no_patch"),
        (False, {"wrote"}, "+x", [], result(), "patch_failed"),
        (False, set(), "+x", ["a"], None, "environment_error"),
        (None, set(), "+x", ["a"], result(passed=None), "test_failed"),
        (False, set(), "+x", ["a"], result(passed=True), "patch_failed"),
    ],
)
def test_rollout_rungs(spark, success, flags, patch, modified, res, want):
    names = ("invalid", "late", "environment", "error_step", "wrote", "write_failed", "tool_failed")
    df = spark.createDataFrame([(success, patch, modified, res)], f"success boolean, patch string, modified array<string>, result {RESULT}")
    got = df.select(classify.rollout_failure(F.col("success"), {n: F.lit(n in flags) for n in names}, F.col("patch"), F.col("modified"), F.col("result"))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "flags,repeated,patch,res,want",
    [
        ({"late"}, False, "+x", result(), "timeout"),
        ({"environment"}, False, "+x", result(), "environment_error"),
        ({"attempted"}, False, "+x", result(), "patch_failed"),
        ({"attempted", "valid_patch"}, False, None, result(), "test_failed"),
        (set(), False, "+x", result(), "test_failed"),
        ({"any_phase", "in_modify", "stopped"}, False, None, result(), "planning_error"),
        ({"any_phase", "in_modify"}, True, None, result(), "planning_error"),
        ({"any_phase"}, False, None, result(), "planning_error"),
        ({"any_phase", "in_modify"}, False, None, result(), "no_patch"),
        (set(), False, None, None, "planning_error"),
    ],
)
def test_planning_rungs(spark, flags, repeated, patch, res, want):
    names = ("late", "environment", "error_step", "attempted", "valid_patch", "stopped", "any_phase", "in_modify")
    df = spark.createDataFrame([(patch, res)], f"patch string, result {RESULT}")
    assert df.select(classify.planning_failure(F.lit(False), {n: F.lit(n in flags) for n in names}, F.lit(repeated), F.col("patch"), F.col("result"))).first()[0] == want


def test_call_failed(spark):
    cases = [("read_file", "Not a file: x", True), ("read_file", "READ_FILE failed: x", True), ("read_file", "apply_patch failed: x", False), ("write_file", "write_file refused: x", True), ("apply_patch", "apply_patch failed:", True), ("run_test", "run_test refused", True), ("run_test", "1 failed", False), ("ls", "ls failed: x", False), (None, "x failed:", False), ("read_file", None, False)]
    df = spark.createDataFrame([(n, o) for n, o, _ in cases], "n string, o string").select(classify.call_failed(F.col("n"), F.col("o")))
    assert [r[0] for r in df.collect()] == [w for *_, w in cases]


def test_examples_v2(spark):
    ok = [("LOCATE", "search_code", '{"query": "x"}', "a " * 2000, True), ("UNDERSTAND", "read_file", '{"path": "a.py"}', "b " * 3000, True), ("MODIFY", "apply_patch", '{"patch": "+y"}', "applied", True)]
    bad = [ok[0], ("LOCATE", "apply_patch", '{"patch": "+y"}', "", True)]
    leak = [("LOCATE", "search_code", '{"query":"x"}', "o", True)]
    df = spark.createDataFrame([(1, "issue", ok), (2, "issue", bad), (3, 'use {"arguments":{"query":"x"},"tool":"search_code"}', leak), (4, "x", []), (5, None, None)], "k long, problem_statement string, steps array<struct<phase:string,tool:string,arguments:string,observation:string,tool_success:boolean>>")
    kept, rejected = examples.audited_v2(examples.build_v2(df, "k", 900), "k")
    rows = {r["step_index"]: r for r in kept.collect()}
    assert {r["k"] for r in rows.values()} == {1} and len(rows) == 3
    assert {(r["k"], r["step_index"], r["error"]) for r in rejected.collect()} == {(2, 1, "schema_invalid"), (3, 0, "future_action_leakage")}
    last = rows[2]
    assert json.loads(last["target"]) == {"tool": "apply_patch", "arguments": {"patch": "+y"}} and "[TRUNCATED]" in last["prompt"] and last["final_tokens"] <= 900 < last["original_tokens"]
    assert examples.build_v2(df, "k", 5).filter("error = 'target_over_budget'").count() > 0


def test_weighted_sample(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 10 else 50.0, "x") for i in range(200)] + [(900, 0.0, "x"), (901, None, "x")], "id long, w double, times_given string")
    got = examples.weighted_sample(df, "w", 5000, "id", buckets=16).collect()
    assert sum(r["times"] for r in got) == 5000 and {900, 901}.isdisjoint(r["id"] for r in got)
    heavy = sum(r["times"] for r in got if r["id"] % 10 == 0)
    assert abs(heavy / 5000 - 1000 / 1180) < 0.03
    assert sorted(map(tuple, got)) == sorted(map(tuple, examples.weighted_sample(df, "w", 5000, "id", buckets=16).collect()))
    assert examples.weighted_sample(df.filter("id > 800"), "w", 10, "id").count() == 0


def test_join_by_file(spark):
    tasks = spark.createDataFrame([("/a/task_1.json", "i1"), ("/a/task_2.json", "i2")], "source_file string, instance_id string")
    good = spark.createDataFrame([("/b/task_1.json", "i1", 5), ("/b/task_2.json", "i2", 6), ("/b/task_9.json", "i9", 7)], "source_file string, instance_id string, v int")
    assert {(r["instance_id"], r["v"]) for r in compare.join_by_file(tasks, good, "instance_id").collect()} == {("i1", 5), ("i2", 6)}
    for bad, message in ((good.filter("v <> 6"), "missing file"), (good.withColumn("instance_id", F.lit("i1")), "other key")):
        with pytest.raises(Exception, match=message):
            compare.join_by_file(tasks, bad, "instance_id").collect()


def test_oracle_prompt(spark):
    step = ("LOCATE", "read_file", '{"path": "ä.py"}', "text", True)
    df = spark.createDataFrame([(" fix it\n", [step]), (None, None)], "p string, s array<struct<phase:string,tool:string,arguments:string,observation:string,tool_success:boolean>>")
    got = [r[0] for r in df.select(prompts.oracle_prompt("p", "s")).collect()]
    want = json.dumps([{"phase": "LOCATE", "action": {"tool": "read_file", "arguments": {"path": "ä.py"}}, "observation": "text", "tool_success": True}], ensure_ascii=False, indent=2)
    assert f"Issue:\nfix it\n\nRepository navigation transcript:\n{want}\n\nReturn" in got[0] and "Issue:\n\n\nRepository navigation transcript:\n[]\n" in got[1]


def test_search_lines(spark):
    df = spark.createDataFrame([("x = 1111\n# no\n  def f():\nab\nfunction g\n" + "y" * 200,)], "t string")
    assert df.select(text.search_lines(F.col("t"))).first()[0] == ["def f():", "function g", "x = 1111"]
