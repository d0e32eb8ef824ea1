"""Operators that once did less than the whole job."""

from pyspark.sql import functions as F

from stepmill.operators import classify
from stepmill.queries import QUERIES


def test_action_ladder(spark, tmp_path):
    good = '{"path": "a.py", "start_line": 1}'
    cases = [
        ("read_file", f"read_file({good})", None),
        ("edit_file", 'edit_file({"patch": "(x)"})', None),
        ("read_file", f"read_file({good}) ", "schema_error"),
        ("read_file", f"read_file({good} x)", "schema_error"),
        ("read_file", f"read_file({good} {{}})", "schema_error"),
        ("read_file", "read_file({'path': 'a.py'})", "schema_error"),
        ("read_file", 'read_file(["path"])', "schema_error"),
        ("read_file", 'read_file({"path": "a.py", "start_line": 0})', "schema_error"),
        ("read_file", 'read_file({"path": "a.py", "start_line": true})', "schema_error"),
        ("run_test", 'run_test({"command": "x", "y": 1})', "schema_error"),
        ("search_code", 'search_code({"path": "a"})', "missing_argument"),
        ("Fly", "Fly({})", "unknown_tool"),
        ("Fly", "invalid(Fly)", "unknown_tool"),
        ("read_file", "invalid(read_file)", "invalid_json"),
        (None, "invalid(?)", "invalid_json"),
        (None, "read_file", None),
    ]
    rows = [(i, 0, None, p, a, None, True, False, False) for i, (p, a, _) in enumerate(cases)]
    rows.append((99, 0, "read_file", "read_file", "read_file(", None, True, True, False))
    steps = spark.createDataFrame(rows, "rollout_id long, step_index int, executed_tool string, model_proposed_tool string, action string, observation string, tool_success boolean, generation_truncated boolean, controller_intervened boolean")
    got = {r.rollout_id: r.x for r in classify.arguments_status(steps, "action", "model_proposed_tool", "x").collect()}
    assert [got[i] for i in range(len(cases))] == [x for *_, x in cases]
    steps.withColumn("ingested_at", F.timestamp_micros(F.lit(0))).write.parquet(str(tmp_path / "steps.parquet"))
    n = {}
    for r in QUERIES["q_c4_action_ladder"](spark, str(tmp_path)).collect():
        n[r.failure] = n.get(r.failure, 0) + r.n
    assert n == {None: 3, "schema_error": 8, "missing_argument": 1, "unknown_tool": 2, "invalid_json": 2, "generation_truncated": 1}


def test_rollout_failure_whole(spark, tmp_path):
    r = lambda i, files, result=(None, False, "1 failed", None): (i, "i", "base", "r", False, "+x", files, result, None, None)
    result = "struct<command: string, passed: boolean, output: string, policy_error: string>"
    rollouts = spark.createDataFrame([r(1, []), r(2, ["a"]), r(3, None, None), r(4, ["a"]), r(5, ["a"]), r(6, ["a"]), r(7, [])], f"rollout_id long, instance_id string, arm string, repo string, success boolean, patch string, modified_files array<string>, test_result {result}, host_test_result {result}, token_usage struct<prompt_tokens: long, completion_tokens: long, total_tokens: long>")
    say = {1: ("apply_patch", "patch({})", "ok"), 2: ("apply_patch", "apply_patch({})", "ok"), 3: (None, "write_file({})", None), 4: ("read_file", "read_file({})", "it Timed out"), 5: ("read_file", "read_file({})", "ImportError: x"), 6: (None, "error", "x"), 7: ("read_file", "read_file({})", "ok")}
    steps = spark.createDataFrame([(i, 0, t, a, o, False, True) for i, (t, a, o) in say.items()], "rollout_id long, step_index int, executed_tool string, action string, observation string, invalid_action boolean, tool_success boolean")
    for name, df in (("rollouts", rollouts), ("steps", steps)):
        df.withColumn("ingested_at", F.timestamp_micros(F.lit(0))).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {x.rollout_id: x.reason for x in QUERIES["q_g2_rollout_facts"](spark, str(tmp_path)).collect()}
    assert got == {1: "patch_failed", 2: "test_failed", 3: "patch_failed", 4: "timeout", 5: "environment_error", 6: "environment_error", 7: "test_failed"}


def test_test_command(spark, tmp_path):
    from stepmill.functions import text

    cases = [
        ("a/b", ["t/x.py::a", "t/y z.py::b", "t/x.py::c", " ", None, "::d"], "python -m pytest -q t/x.py 't/y z.py'"),
        ("a/b", ["t/it's.py"], "python -m pytest -q 't/it'\"'\"'s.py'"),
        ("a/b", [], "python -m pytest -q"),
        ("a/b", None, "python -m pytest -q"),
        (None, ["t.py::a"], "python -m pytest -q t.py"),
        ("django/django", ["test_a (m.T)", "test_b (m.T)", "test_a (m.T)", "odd"], "python tests/runtests.py --verbosity 1 m.T.test_a m.T.test_b"),
        ("django/django", ["t.py::a"], "python -m pytest -q t.py"),
        ("a/b", ["test_a (m.T)"], "python -m pytest -q 'test_a (m.T)'"),
    ]
    df = spark.createDataFrame([(i, r, f) for i, (r, f, _) in enumerate(cases)], "task_id long, repo string, fail_to_pass array<string>")
    df.write.parquet(str(tmp_path / "tasks.parquet"))
    got = {x.task_id: x.command for x in QUERIES["q_v11_derived_commands"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(cases))] == [c for *_, c in cases]
    known = df.select(text.test_command(F.col("repo"), F.col("fail_to_pass"), F.array(F.lit("t/y z.py"))).alias("c")).filter("task_id = 0").first()
    assert known.c == "python -m pytest -q 't/y z.py'"


def test_documents_of_every_kind(spark, tmp_path):
    lines = "\n".join(["a", "it returns None", "b", "c", "d"])
    docs = spark.createDataFrame([(1, "issue", lines), (2, "guide", lines), (3, None, lines)], "doc_id long, kind string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.line) for r in QUERIES["q_e9_search_documents"](spark, str(tmp_path)).collect()) == [(1, 2), (2, 2), (3, 2)]
    assert {r.doc_id for r in QUERIES["q_e4_bounded_patches"](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_split_search_limit(spark):
    import pytest

    from stepmill.operators import splits

    counts = spark.createDataFrame([(f"g{i:02}", 10) for i in range(21)], "repo string, n long")
    with pytest.raises(Exception, match="at most 20 groups"):
        splits.search_group_split_df(counts, "repo", "n", 10, 10).collect()
    r = splits.search_group_split_df(counts.filter("repo < 'g10'"), "repo", "n", 10, 10).first()
    assert (r.validation_groups, r.validation_rows, r.train_rows) == ("g00,g01", 20, 80)
