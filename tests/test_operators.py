import pytest
from pyspark.sql import functions as F

from stepmill.operators import classify, compare, examples, metrics, sequence, splits


def steps(spark, rows):
    return spark.createDataFrame(rows, "k long, step_index int, tool string, success boolean")


@pytest.mark.parametrize(
    "seq,phase,blocked,path",
    [
        ([("search_code", True), ("read_file", True), ("apply_patch", True), ("run_test", False)], "UNDERSTAND", 0, "LOCATE>UNDERSTAND>MODIFY>VERIFY>UNDERSTAND"),
        ([("search_code", False)] * 4 + [("list_files", True)], "LOCATE", 2, "LOCATE"),
        ([("list_files", True)] * 3, "LOCATE", 1, "LOCATE"),
        ([("search_code", True), ("apply_patch", True)], "UNDERSTAND", 1, "LOCATE>UNDERSTAND"),
        ([("search_code", True), ("read_file", False), ("apply_patch", True)], "UNDERSTAND", 1, "LOCATE>UNDERSTAND"),
        ([(None, None)], "LOCATE", 1, "LOCATE"),
    ],
)
def test_replay(spark, seq, phase, blocked, path):
    r = sequence.replay_phases(steps(spark, [(1, i, t, ok) for i, (t, ok) in enumerate(seq)]), "k").first()
    assert (r["final_phase"], r["blocked"], r["path"]) == (phase, blocked, path)


def test_sequences(spark):
    s = steps(spark, [(1, 0, "a", True), (1, 1, "a", False), (1, 2, "x", None), (1, 3, "a", None), (2, 0, "b", True)])
    assert [tuple(r) for r in sequence.consecutive_repeats(s, "k", "tool", ["a"], ["a"]).collect()] == [(1, "a", 2)]
    assert [tuple(r) for r in sequence.consecutive_repeats(s, "k", "tool", ["a", "x"], ["a"]).collect()] == [(1, "a", 1)]
    assert {tuple(r) for r in sequence.last_matching(s, "k", F.col("tool") == "a", "success").collect()} == {(1, 3, None)}
    assert [tuple(r) for r in sequence.repeated_calls(s, "k", "tool").collect()] == [(1, "a", 3)]
    h = {(r["k"], r["step_index"]): r["history"] for r in sequence.prefix_history(s, "k", F.col("tool")).collect()}
    assert h[1, 0] == [] and h[1, 3] == ["a", "a", "x"]
    assert {(r["k"], r["tool"]) for r in sequence.first_per_key(s, ["k"], ["step_index"]).collect()} == {(1, "a"), (2, "b")}
    assert {r["position"] for r in sequence.number_rows(s, ["k"], ["step_index"], start=1).collect()} == {1, 2, 3, 4}


def test_classify(spark):
    df = spark.createDataFrame([(True, None), (None, False), (False, True), (None, None)], "a boolean, b boolean")
    ladder = classify.first_match([(F.col("a"), "A"), (F.col("b"), "B")], "none")
    assert [r[0] for r in df.select(ladder).collect()] == ["A", "none", "B", "none"]
    labels = classify.all_matches([(F.col("b"), "y"), (F.col("a").isNull(), "x")])
    assert [r[0] for r in df.select(labels).collect()] == [[], ["x"], ["y"], ["x"]]
    assert [r[0] for r in df.select(classify.primary_of(labels, ["y"])).collect()] == ["unknown", "unknown", "y", "unknown"]
    assert [r[0] for r in df.select(classify.boolean_outcome(F.col("a"), F.col("b"))).collect()] == ["regressed", "same", "improved", "same"]
    t = spark.createDataFrame([((True,),), ((False,),), ((None,),), (None,)], "r struct<passed:boolean>")
    assert [r[0] for r in t.select(classify.test_state(F.col("r"))).collect()] == ["passed", "failed", "missing", "missing"]
    c = spark.createDataFrame([("g", "x", 2), ("g", "extra", 1)], "arm string, label string, n long")
    assert {(r["label"], r["n"]) for r in classify.zero_filled(c, "label", ["x", "y"], ["arm"]).collect()} == {("x", 2), ("y", 0), ("extra", 1)}


def test_metrics(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 10)] + [("b", None)], "g string, v int")
    r = metrics.length_stats(df, "v", ["g"], [0.9]).collect()
    assert len(r) == 1 and (r[0]["count"], r[0]["mean"], r[0]["median"], r[0]["max"]) == (5, 4.0, 3.0, 10.0) and abs(r[0]["p90"] - 7.6) < 1e-9
    assert metrics.length_stats(df.limit(0), "v").first()["median"] == 0.0
    m = spark.createDataFrame([({"x": 1, "y": 2},), ({"x": 5},), (None,)], "m map<string,int>")
    assert {tuple(r) for r in metrics.merge_counters(m, "m").collect()} == {("x", 6), ("y", 2)}
    assert metrics.rates(df.limit(0), {"f": F.col("v") > 1}).first()["f_rate"] == 0.0
    a, b = (spark.createDataFrame(x, "l string, n long") for x in ([("p", 5), ("q", 1)], [("q", 5), ("p", 1)]))
    assert tuple(metrics.top_delta(a, b, "l", "n").first()) == ("q", 4)
    assert tuple(metrics.all_finite(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), ["x"]).first()) == (True, False)
    assert tuple(metrics.all_finite(spark.createDataFrame([], "x double"), ["x"]).first()) == (False, True)


T = "traj_id long, steps array<struct<phase:string,tool:string,arguments:string,observation:string,tool_success:boolean>>"


def test_examples(spark):
    t = spark.createDataFrame([(1, [("L", "read_file", '{"path": "a.py"}', "bad", True), ("L", "read_file", '{"path": "a.py"}', "later", True), ("V", "run_test", '{"command": "t"}', None, False)]), (2, None), (3, [])], T)
    assert [tuple(r) for r in examples.repository_context(t, "traj_id").collect()] == [(1, "### File: a.py\nbad")]
    e = examples.expand_v1(examples.sft_v1(t, "traj_id", F.lit("Fix"), F.when(F.col("traj_id") == 1, "answer").otherwise(" ")), "traj_id").orderBy("traj_id", "example_index").collect()
    assert [(r["traj_id"], r["example_index"]) for r in e] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert "Observation: bad" not in e[0]["prompt"] and "Observation: bad" in e[1]["prompt"] and e[3]["target"] == "Final Answer: answer"


def test_budget(spark):
    h = [{"tool": "read_file", "arguments": "{}", "observation": "x" * 3000}, {"tool": "list_files", "arguments": "{}", "observation": "file\n" * 800}]
    items, removed, cut = examples.fit_history(h, 900)
    assert removed == 0 and [c["tool"] for c in cut] == ["list_files"] and items[1]["observation"].endswith(examples.TRUNCATED)
    assert examples.fit_history(h, 2) == ([], 2, [])
    rows = [(1, i, "read_file", "{}", "y" * 2000) for i in range(7)]
    out = examples.fit_budget(spark.createDataFrame(rows, "k long, step_index int, tool string, arguments string, observation string"), "k", 1200).orderBy("step_index").collect()
    assert all(r["final_tokens"] <= 1200 for r in out) and out[-1]["removed_history_steps"] >= 2 and out[0]["removed_history_steps"] == 0
    s = spark.createDataFrame([(1, i, 10) for i in range(5)], "k long, i int, n int")
    assert {r["i"] for r in examples.drop_oldest(s, "k", "i", "n", 25).collect()} == {3, 4}
    assert {r["i"] for r in examples.drop_oldest(s, "k", "i", "n", 5, keep=1).collect()} == {4}


def test_masks_weights_padding(spark):
    df = spark.createDataFrame([(1, [5, 6], [5, 6, 7]), (1, [5], [5]), (1, [9], [5, 6])], "b int, p array<int>, f array<int>")
    m = examples.mask_labels(df, "p", "f").collect()
    assert [r["prefix_ok"] for r in m] == [True, False, False] and m[0]["labels"] == [-100, -100, 7]
    pad = examples.pad_batch(df, "b", "f", "p", 0).collect()
    assert all(len(r["f"]) == 3 for r in pad) and sorted(sum(r["attention_mask"]) for r in pad) == [1, 2, 3]
    g = spark.createDataFrame([(i, "a" if i < 3 else None) for i in range(4)], "id long, g string")
    w = examples.balanced_weights(g, "g")
    assert sorted(r["weight"] for r in w.collect()) == [1 / 3, 1 / 3, 1 / 3, 1.0]
    assert {round(r["share"], 9) for r in examples.expected_shares(w, "g", "weight").collect()} == {0.5}
    n = sum(r["times"] for r in examples.weighted_sample(w, "weight", 10_000, "id").collect())
    assert abs(n - 10_000) <= 4
    assert spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(examples.keep_last(F.col("x"), 2)).first()[0] == [2, 3]


def test_splits(spark):
    counts = {"a": 17, "b": 15, "c": 9, "d": 6, "e": 4, "f": 4}
    train, val = splits.search_group_split(counts)
    # the nearest to a fifth of 55 that any subset within the minima has
    assert not train & val and train | val == set(counts) and sum(counts[x] for x in val) == 10
    _, plain = splits.search_group_split(counts, seed=None)
    r = splits.search_group_split_df(spark.createDataFrame(list(counts.items()), "g string, n long"), "g", "n", 40, 8).first()
    assert set(r["validation_groups"].split(",")) == plain
    with pytest.raises(ValueError):
        splits.search_group_split({"a": 1, "b": 1})
    d = spark.createDataFrame([(1, "t", "x"), (2, "v", "x"), (3, "v", "y"), (4, None, "y"), (5, "t", None)], "id long, split string, k string")
    assert [tuple(r) for r in splits.overlap_audit(d, "split", ["k"]).collect()] == [("k", "x", "t,v")]
    assert splits.duplicate_groups(d, "id", F.col("k")).count() == 2
    assert {r["id"] for r in splits.exact_dedup(d, "id", F.col("k")).collect()} == {1, 3, 5}
    e, f = spark.createDataFrame([("a",), ("b",), (None,)], "x string"), spark.createDataFrame([("b",), ("b",), ("c",)], "x string")
    assert {tuple(r) for r in splits.set_differences(e, f, "x").collect()} == {("a", "missing"), ("c", "unexpected"), ("b", "duplicate")}
    with pytest.raises(ValueError):
        splits.assert_unique(f, "x")
    p = spark.createDataFrame([("the GOLD and fail_to_pass", "GOLD ", "")], "p string, g string, e string")
    assert p.select(splits.prompt_leakage(F.col("p"), {"gold": F.col("g"), "empty": F.col("e")}, {"lit": "FAIL_TO_PASS"})).first()[0] == ["gold", "lit"]
    s = splits.seeded_train_split(spark.range(100), "id", 10, 7, 1)
    assert s.count() == 10 and s.filter("split = 'train'").count() == 7 and {r["position"] for r in s.collect()} == set(range(10))
    sm = splits.smoke_subset(spark.range(60).select("id", (F.col("id") * 3).alias("n"), (F.col("id") % 3).alias("ph")), "id", "n", "ph").collect()
    assert {r["id"] for r in sm if r["reason"] == "longest"} == {56, 57, 58, 59} and len(sm) == 10 and len({r["id"] for r in sm}) == 10


def test_compare(spark):
    b = spark.createDataFrame([("i", True, 5), ("j", None, 7)], "id string, ok boolean, n int")
    o = spark.createDataFrame([("i", False, 3), ("j", True, 7), ("z", True, 1)], "id string, ok boolean, n int")
    got = {r["id"]: (r["ok_outcome"], r["n_delta"], r["n_outcome"]) for r in compare.pairwise(b, o, "id", ["ok"], ["n"]).collect()}
    assert got == {"i": ("regressed", -2, "improved"), "j": ("improved", 0, "same")}
    h = compare.comparable(b.limit(1), o.filter("id = 'i'"), ["id", "n"]).collect()
    assert {(r["field"], r["equal"]) for r in h} == {("id", True), ("n", False)}
    i = compare.index_by_last(spark.createDataFrame([("k", "f1", 1), ("k", "f2", None)], "k string, file string, v int"), "k", "file").first()
    assert (i["file"], i["v"]) == ("f2", None)
    files = spark.createDataFrame([("r", "src/parser.py"), ("r", "tests/test_parser.py"), ("r", "docs/x.md"), ("q", "parser.py")], "repo string, path string")
    issues = spark.createDataFrame([(1, "r", ["parser", "docs"])], "id long, repo string, t array<string>")
    ranked = compare.rank_files(issues, files, "id", F.col("t"), top=2).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in ranked] == [("tests/test_parser.py", 13), ("src/parser.py", 12)]


def test_records_and_files(spark):
    from stepmill.functions import actions
    from stepmill.operators import files, records

    f = spark.createDataFrame([("r", "b.py", "one\ntwo\nx = two\n"), ("r", "a.py", "nothing"), ("r", "a.py", "nothing")], "repo string, path string, content string")
    assert [tuple(r) for r in files.list_files(f, "repo", 1).collect()] == [("r", "a.py\n... 1 more files")]
    assert {(r["path"], r["line"]) for r in files.search_code(f, F.lit("two")).collect()} == {("b.py", 2), ("b.py", 3)}
    assert files.search_code(f, F.lit("")).count() == 0
    assert f.filter("path = 'b.py'").select(files.read_lines(F.col("content"), F.lit(2), F.lit(9))).first()[0] == "two\nx = two\n"
    plan = files.navigation_plan(spark.createDataFrame([(1, "d/x.py", 1, 9), (1, "d/x.py", 50, 60), (1, "top.py", 1, 2)], "k long, path string, start int, end int"), "k").orderBy("step_index").collect()
    assert [(r["tool"], r["path"]) for r in plan] == [("list_files", "d"), ("read_file", "d/x.py"), ("read_file", "d/x.py"), ("list_files", "."), ("read_file", "top.py"), ("apply_patch", None)]
    t = spark.createDataFrame([('["a", " ", "b"]',), ("t::x",), (None,), ('{"a": 1}',)], "v string")
    assert [r[0] for r in t.select(actions.test_ids(F.col("v"))).collect()] == [["a", "b"], ["t::x"], [], []]
    s = spark.createDataFrame([('```\n{"a": 1}\n```',), ('{"a": 1} tail',), ("[1]",), ('no {bad} {"b": 2} x',)], "v string")
    assert [r[0] for r in s.select(actions.strict_object(F.col("v"))).collect()] == ['{"a": 1}', None, None, None]
    assert [r[0] for r in s.select(actions.any_object(F.col("v"))).collect()] == ['{"a":1}', '{"a":1}', None, '{"b":2}']
    r = spark.createDataFrame([("Thought: t\nAction: write_file({\"path\": \"a\"})",), ('{"tool": "grep", "arguments": {"query": "q"}}',)], "v string").select(actions.parse_react(F.col("v")).alias("p")).collect()
    assert (r[0]["p"]["tool"], r[0]["p"]["invalid_action"], r[1]["p"]["tool"], r[1]["p"]["invalid_action"]) == ("write_file", False, "search_code", True)
    g = spark.createDataFrame([(1, True), (1, False), (2, None), (2, False)], "k int, bad boolean")
    assert {r["k"] for r in records.all_or_nothing(g, "k", F.col("bad")).collect()} == {2}
    assert "max_results" in actions.tool_schemas()
