import pytest
from pyspark.sql import functions as F

from stepmill.functions import calls, diff, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.safe_name, "a/b c", "a_b_c"), (text.safe_name, "..", None), (text.normal_name, " Read-File!", "read_file"), (text.action_name, " Run_Test (x(y))", "run_test"),
        (text.action_name, "", None), (text.tool_of, "Edit File", "apply_patch"), (text.tool_of, "unknown", None), (text.call_arguments, 'f({"a": "(b)"})', '{"a": "(b)"}'), (text.call_arguments, "none", None),
        (text.guess_action, 'x {"tool": "ls"}', "ls"), (text.guess_action, "Thought\nAction: grep(x)", "grep"), (text.guess_action, "just words", "just words"),
        (lambda c: text.truncate_output(c, 3), "abcdef", "abc\n...[truncated 3 chars]"), (lambda c: text.truncate_output(c, 6), "abcdef", "abcdef"),
        (lambda c: text.truncate_at_line(c, 20), "line one\nline two\nline three", "line one\n[TRUNCATED]"[:8] + "\n[TRUNCATED]"),
        (text.has_patch, "(no changes)", False), (text.has_patch, None, False), (text.has_patch, " x", True), (text.normal_diff, "a \r\nb\t\n\n", "a\nb"), (text.token_estimate, "", 1), (text.token_estimate, "abcde", 2),
        (text.issue_terms, "Foo_bar foo_bar abc Data data1", ["foo_bar", "data", "data1"]), (text.strip, "  x \n", "x"),
        (text.search_lines, "# c\nx\n  value = 1\ndef f():\n  value = 1\n", ["def f():", "value = 1", "def f():"]),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


PATCH = "--- a/x.py\n+++ b/x.py\t2024-01-01\n@@ -1,2 +1,2 @@\n-bad\n+good\n ctx\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+x\n--- a/../evil\n+++ b/../evil\n@@ -5 +5 @@\n-a\n+b\n"


def test_patches(spark):
    assert one(spark, PATCH, text.patch_targets) == ["../evil", "new.py", "x.py"]
    assert one(spark, PATCH, lambda c: text.patch_lines(c, "+")) == 3 and one(spark, PATCH, lambda c: text.patch_lines(c, "-")) == 2
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, "")], "k long, patch string")
    sec = {r["path"]: (r["is_added"], r["is_removed"]) for r in diff.file_sections(df, "k", "patch").collect()}
    assert sec == {"x.py": (False, False), "new.py": (True, False)}
    ranges = diff.hunk_ranges(diff.file_sections(df, "k", "patch"), "k", pad=30)
    assert {(r["path"], r["start"], r["end"]) for r in ranges.collect()} == {("x.py", 1, 32), ("new.py", 1, 30)}


def test_merge_ranges(spark):
    df = spark.createDataFrame([("p", 1, 10), ("p", 30, 40), ("p", 61, 62), ("p", 2, 100), ("q", 5, 6), ("q", 27, 30)], "path string, start int, end int")
    assert {(r["path"], r["start"], r["end"]) for r in diff.merge_ranges(df, ["path"]).collect()} == {("p", 1, 100), ("q", 5, 6), ("q", 27, 30)}


def test_diff_round_trip(spark):
    before = "".join(f"line {i}\n" for i in range(200))
    after = before.replace("line 5\n", "five\n").replace("line 150\n", "").replace("line 199\n", "end\n" * 60)
    for budget in (40, 100, 10_000):
        parts = diff.split_edits(before, after, "a.py", budget)
        now = before.splitlines(True)
        for p in parts:
            now = apply(now, p)
        assert "".join(now) == after
    out = diff.split_patches(spark.createDataFrame([(1, "a.py", before, after), (2, "b", "x\n", "x\n")], "k long, path string, before string, after string"), "k", 100).collect()
    assert {r["k"] for r in out} == {1} and len(out) > 2
    d = spark.createDataFrame([("f", None, "x\n"), ("f", "x\n", "x\n")], "p string, a string, b string").select(diff.unified_diff("p", "a", "b")).collect()
    assert d[0][0].startswith("--- /dev/null") and d[1][0] == ""


def apply(lines, patch):
    import re

    out, at, body = [], 0, patch.splitlines(True)[2:]
    for line in body:
        m = re.match(r"@@ -(\d+)(?:,(\d+))? ", line)
        if m:
            start = int(m[1]) - (0 if m[2] == "0" else 1)
            out += lines[at:start]
            at = start
        elif line[0] == "-":
            at += 1
        elif line[0] == "+":
            out.append(line[1:])
        else:
            out.append(lines[at])
            at += 1
    return out + lines[at:]


@pytest.mark.parametrize(
    "tool,args,want",
    [
        ("read_file", '{"path": "a"}', None), ("read_file", "{}", "missing_argument"), ("read_file", '{"path": "a", "secret": 1}', "unexpected_argument"), ("read_file", '{"path": 1}', "wrong_type"),
        ("read_file", '{"path": "a", "start_line": true}', "wrong_type"), ("read_file", '{"path": "a", "start_line": 0}', "out_of_bounds"), ("search_code", '{"query": "a", "max_results": 201}', "out_of_bounds"),
        ("read_file", "[]", "invalid_json"), ("read_file", "no json", "invalid_json"), ("read_file", None, "invalid_json"), ("rm", "{}", "unknown_tool"), (None, "{}", "unknown_tool"), ("list_files", "{}", None),
    ],
)
def test_call_status(spark, tool, args, want):
    df = spark.createDataFrame([(tool, args)], "t string, a string")
    assert df.select(calls.call_status(F.col("t"), F.col("a"))).first()[0] == want


def test_targets_and_calls(spark):
    df = spark.createDataFrame([("LOCATE", "apply_patch", '{"patch": "x"}'), ("NOPE", "run_test", '{"command": "x"}'), ("VERIFY", "run_test", '{"command": "x"}')], "p string, t string, a string")
    assert [r[0] for r in df.select(calls.target_status(F.col("p"), F.col("t"), F.col("a"))).collect()] == ["phase_tool_mismatch", "unsupported_phase", None]
    texts = ['```json\n{"tool": "update_file", "arguments": {"patch": "x"}}\n```', 'so: {"tool": "read_file", "arguments": {"path": "a"}} done', "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(calls.parse_call(F.col("x"))).collect()]
    assert (got[0]["tool"], got[0]["repair_applied"], got[0]["invalid_action"], got[0]["arguments"]) == ("apply_patch", True, True, '{"patch":"x"}')
    assert (got[1]["tool"], got[1]["invalid_action"]) == ("read_file", False) and got[2]["invalid_action"] and got[2]["tool"] is None
    assert one(spark, '{"b": [1, {"z": null, "a": "ü"}], "a": 2}', calls.canonical_json) == '{"a":2,"b":[1,{"a":"ü","z":null}]}'
    k = calls.key_set_status(spark.createDataFrame([('{"a":1,"c":2}',), ("[]",)], "j string"), "j", ["a", "b"]).collect()
    assert (k[0]["missing_keys"], k[0]["unexpected_keys"], k[1]["missing_keys"]) == (["b"], ["c"], None)
