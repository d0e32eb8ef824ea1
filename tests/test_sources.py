import json

import pytest
from pyspark.sql import functions as F

from stepmill.plans import prompts, reports
from stepmill.sources import readers, writers
from stepmill.streaming.replay import replay_stream, tool_counts


def test_json_documents(spark, tmp_path):
    (tmp_path / "task_1.json").write_text('{"instance_id": "a",\n "steps": [{"tool": "x"}]}')
    (tmp_path / "task_2.json").write_text("[1]")
    (tmp_path / "task_3.json").write_text("{broken")
    (tmp_path / "other.txt").write_text("{}")
    ok, bad = readers.json_documents(spark, str(tmp_path), "instance_id string, steps array<struct<tool:string>>", "task_*.json")
    assert [(r["instance_id"], r["steps"][0]["tool"]) for r in ok.collect()] == [("a", "x")]
    assert {(r["source_file"][-11:], r["reasons"][0]) for r in bad.collect()} == {("task_2.json", "not_an_object"), ("task_3.json", "invalid_json")}
    with pytest.raises(ValueError):
        readers.require_no_rejects(ok, bad)
    arm, problems = readers.arm(ok, spark.createDataFrame([("a",), ("b",)], "instance_id string"))
    assert arm.count() == 1 and [tuple(r) for r in problems.collect()] == [("b", "missing")]
    assert readers.lookup(ok, "instance_id", "zz", required=False) is None
    with pytest.raises(KeyError):
        readers.lookup(ok, "instance_id", "zz")
    with pytest.raises(ValueError):
        readers.first_files(ok, 2)
    assert readers.first_files(ok, 1).count() == 1
    assert {len(r["sha256"]) for r in readers.file_checksums(spark, str(tmp_path)).collect()} == {64}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": null}\n\n  \n{"a": 2}\nnope\n')
    ok, bad = readers.jsonl(spark, str(p), "a int, b string", required=["a", "b"])
    assert [r["a"] for r in ok.collect()] == [1] and sorted(r["reasons"][0] for r in bad.collect()) == ["invalid_json", "missing:b"]
    ok, bad = readers.jsonl(spark, str(p), "a int, b string", required=["a", "b"], strict=False)
    assert sorted(r["a"] for r in ok.collect()) == [1, 2] and bad.count() == 1


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 3)], "z int, a string, n int")
    writers.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines())
    assert lines[1] == '{"a":"é","n":null,"z":1}'
    writers.write_new(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_new(df, str(tmp_path / "t"))
    for n in (1, 2):
        writers.swap_directory(df.limit(n), str(tmp_path / "v"), {"n": n})
        assert spark.read.parquet(str(tmp_path / "v")).count() == n and json.loads((tmp_path / "v" / "_manifest.json").read_text()) == {"n": n}
    writers.write_report(str(tmp_path / "r.json"), {"ü": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"ü": 1} and not list(tmp_path.glob(".tmp-*"))


def test_checksums(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "s string, i int")
    assert readers.table_checksum(a).first() == readers.table_checksum(b).first() != readers.table_checksum(a.limit(1)).first()
    m = writers.freeze_manifest({"train": a.withColumn("target_tokens", F.col("i") * 10), "validation": a.limit(0).withColumn("target_tokens", F.col("i"))}, "v1", 1024)
    assert m["splits"]["train"]["rows"] == 2 and m["splits"]["train"]["p90"] == 19.0 and len(m["dataset_checksum"]) == 64
    with pytest.raises(ValueError):
        writers.freeze_manifest({"train": a.withColumn("target_tokens", F.lit(2000))}, "v1", 1024)


def test_tasks_and_resume(spark):
    t = spark.createDataFrame([("i", None, 5, "p", None, "h")], "instance_id string, repo string, base_commit int, problem_statement string, test_patch string, hints_text string")
    assert tuple(readers.task_projection(t).first()) == ("i", "", "5", "p", "", "h")
    prev = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", "running")], "k string, status string")
    tasks = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    assert {r["k"] for r in readers.pending(tasks, prev, "k").collect()} == {"c", "d"} and {r["k"] for r in readers.pending(tasks, prev, "k", True).collect()} == {"b", "c", "d"}
    assert set(readers.source_lineage(tasks, "n", "r", "c").columns) == {"k", "dataset_name", "dataset_revision", "dataset_checksum"}


def test_reports_and_prompts(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert reports.markdown_table(df) == "| x | y |\n| --- | --- |\n| a\\|b |  |\n"
    assert "## t" in reports.report("R", {"k": 1}, [("t", df)]) and reports.percent(0.5) == "50.00%" and reports.points(0.5, 0.25) == "-25.00 pp" and reports.percent(None) == "-"
    m = spark.createDataFrame([("issue", "LOCATE", ["b", "a", "b"])], "p string, ph string, t array<string>").select(prompts.messages(F.col("p"), F.col("ph"), F.col("t")).alias("m"))
    r = m.select("m", prompts.chat_prompt(F.col("m")).alias("c")).first()
    assert r["m"][1]["content"] == "## Issue\nissue\n\n## Phase\nLOCATE\n\n## Tools\na, b" and r["c"].endswith("<|im_start|>assistant\n")


def test_streams(spark, tmp_path):
    rows = [(1, 0, "search_code", True), (1, 1, "read_file", True), (2, 0, "list_files", True)]
    schema = "rollout_id long, step_index long, tool string, success boolean"
    src, out = str(tmp_path / "src"), str(tmp_path / "cp")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = replay_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("replay").outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["rollout_id"], r["phase"]) for r in spark.table("replay").collect()} == {(1, "MODIFY"), (2, "LOCATE")}
    spark.createDataFrame([(1, 1, "read_file", True), (1, 2, "apply_patch", True)], schema).coalesce(1).write.mode("append").parquet(src)
    q = replay_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("replay2").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ("VERIFY", 3) in {(r["phase"], r["seen"]) for r in spark.table("replay2").collect()}
    steps = spark.createDataFrame([(1, 0, "read_file", True, 0), (1, 0, "read_file", True, 0), (1, 1, "read_file", False, 60)], "rollout_id long, step_index long, executed_tool string, tool_success boolean, s long").select("rollout_id", "step_index", "executed_tool", "tool_success", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("recorded_at"))
    src = str(tmp_path / "src2")
    steps.coalesce(1).write.parquet(src)
    q = tool_counts(spark.readStream.schema(steps.schema).parquet(src)).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["tool"], r["steps"], r["failures"]) for r in spark.table("counts").collect()] == [("read_file", 2, 1)]


def test_text_on_a_shared_file_system(spark, tmp_path):
    target = f"file://{tmp_path}/deep/report.json"
    for value in (1, 2):
        writers.write_report(target, {"v": value}, spark)
        assert json.loads((tmp_path / "deep/report.json").read_text()) == {"v": value}
    assert not [p for p in (tmp_path / "deep").iterdir() if "tmp-" in p.name and not p.name.startswith(".")]
