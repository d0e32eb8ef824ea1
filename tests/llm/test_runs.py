from datetime import datetime, timedelta

import pytest

from stepmill.llm.runs import canonical_call, collapse_runs

SCHEMA = "rollout_id long, step_index int, phase string, executed_tool string, action string, recorded_at timestamp, ingested_at timestamp, run string, block long, observation string"
T0 = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(r, i, p, t, a, at, ing, "x", 1, None) for r, i, p, t, a, at, ing in rows], SCHEMA)


@pytest.mark.parametrize(
    "a,b",
    [
        ('read_file({"path": "./a//b.py", "start_line": 1})', "Read-File({'start_line': 1, 'path': 'a/b.py'})"),
        ('search_code({"query": " Foo "})', 'grep({"max_results":50,"path":".","query":"foo"})'),
        ("ls({})", 'list_files({"path": "./"})'),
        ('run_test({"command": "python -m pytest t.py"})', 'pytest({"command": "python -m pytest t.py -p no:cacheprovider --basetemp /tmp/9 --basetemp=/var/tmp/w1"})'),
        ('edit_file({\n "patch":"x"\n})', 'apply_patch({"patch": "x"})'),
        ('list_files({"path": "src/./a/"})', 'list_directory({"path":"src/a"})'),
    ],
)
def test_same_calls(a, b):
    assert canonical_call(a) == canonical_call(b)


@pytest.mark.parametrize(
    "a,b",
    [
        ('read_file({"path": "a", "start_line": 1})', 'read_file({"path": "a", "start_line": 2})'),
        ('read_file({"path": "a"})', 'read_file({"path": "/a"})'),
        ('search_code({"query": "foo"})', 'search_code({"query": "foo", "max_results": 20})'),
        ('run_test({"command": "pytest a"})', 'run_test({"command": "pytest b"})'),
        ('apply_patch({"patch": "x "})', 'apply_patch({"patch": "x"})'),
        ("read_file(broken", "read_file(broken2"),
    ],
)
def test_other_calls(a, b):
    assert canonical_call(a) != canonical_call(b)


def test_null_and_odd_actions():
    assert canonical_call(None) is None
    assert canonical_call("") == canonical_call(" ")


@pytest.mark.parametrize("block", [4096, 4, 1])
def test_runs_in_any_block_size(spark, block):
    at = lambda s: T0 + timedelta(seconds=s)
    a, b = 'ls({})', 'ls({"path": "x"})'
    rows = [(1, i, "P", "ls", a, at(i), at(0)) for i in range(7)]  # one run over all block edges
    rows += [(1, 7, "P", "ls", b, None, at(0)), (1, 9, "P", "ls", b, at(9), at(0))]  # a gap breaks a run
    rows += [(2, 0, None, None, None, None, at(0)), (2, 1, None, None, None, None, at(0)), (2, 2, "P", None, None, at(3), at(0))]
    rows += [(3, 0, "P", "ls", b, at(0), at(5)), (3, 0, "P", "ls", a, at(0), at(9)), (3, 1, "P", "ls", a, at(4), at(9)), (3, 1, "P", "ls", a, at(4), at(9))]
    rows += [(None, 0, "P", "ls", a, at(0), at(0)), (4, None, "P", "ls", a, at(0), at(0))]
    got = {(r["rollout_id"], r["first_step_index"]): (r["last_step_index"], r["n_steps"], r["duration_s"]) for r in collapse_runs(frame(spark, rows), block).collect()}
    assert got == {(1, 0): (6, 7, 6.0), (1, 7): (7, 1, None), (1, 9): (9, 1, 0.0), (2, 0): (1, 2, None), (2, 2): (2, 1, 0.0), (3, 0): (1, 2, 4.0)}


def test_no_rows(spark):
    assert collapse_runs(frame(spark, [])).count() == 0
