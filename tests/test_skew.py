from pyspark.sql import functions as F

from stepmill.operators.skew import distinct_counts, eager_join, heavy_keys, repo_results, scaled_sum, weighted_median
from stepmill.session import broadcast_below, cut, latest_steps

L = "repo string, v int, key string, rows int"


def test_eager_join_equals_row_join(spark):
    left = spark.createDataFrame([("a", i, "k", 1) for i in range(50)] + [("b", 1, "k", 1), (None, 2, "k", 1), ("l", 3, None, 1)], L)
    right = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5), (None, 1), ("r", 9)], "repo string, w int")
    got = eager_join(left, right, "repo", {"v": F.sum("v")}, {"w": F.sum("w")})
    rows = {r["key"]: r for r in got.collect()}
    assert {k: r["joined_rows"] for k, r in rows.items()} == {"a": 100, "b": 1, None: 0, "l": 0, "r": 0}
    want = left.join(right, "repo").agg(F.count("*"), F.sum("v"), F.sum("w")).first()
    total = got.agg(F.sum("joined_rows"), scaled_sum("left_v", "right_rows"), scaled_sum("right_w", "left_rows")).first()
    # NULL joins nothing, so its product is left out of the row join
    assert total[0] == want[0] and total[1] - 2 == want[1] and total[2] - 1 == want[2]


def test_heavy_keys_share_is_exact(spark):
    left = spark.createDataFrame([("x",)] * 5 + [("y",)] * 4 + [(None,)] * 30 + [(f"o{i}",) for i in range(61)], "repo string")
    got = heavy_keys(eager_join(left, left.limit(0), "repo"), {"left": "steps", "right": "task_refs"}).collect()
    assert [(r["table_name"], r["key"]) for r in got] == [("steps", "x")]


def test_median_and_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", None), ("b", None), (None, 4), (None, 5)], "k string, v int")
    assert {r["key"]: r["median"] for r in weighted_median(df, "k", "v").collect()} == {"a": 3.0, "b": None, None: 4.5}
    assert {r["key"]: r["n_v"] for r in distinct_counts(df, "k", "v").collect()} == {"a": 2, "b": 0, None: 2}


def test_repo_results_and_empty(spark):
    steps = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 2, None), (None, 3, 7)], "repo string, rollout_id long, observation_chars int").withColumn("recorded_at", F.timestamp_micros(F.lit(1)))
    refs = spark.createDataFrame([("a", "i", "f"), ("a", "i", "g"), ("a", "i", "g"), ("z", None, "h")], "repo string, instance_id string, source_file string")
    got = {r["repo"]: (r["steps"], r["rollouts"], r["median_observation_chars"], r["refs"], r["instances"], r["files"], r["step_ref_pairs"]) for r in repo_results(steps, refs).collect()}
    assert got == {"a": (3, 2, 15.0, 3, 1, 2, 9), None: (1, 1, 7.0, 0, 0, 0, 0), "z": (0, 0, None, 1, 0, 1, 0)}
    assert repo_results(steps.limit(0), refs.limit(0)).count() == 0


def test_latest_steps_and_helpers(spark):
    rows = [(1, 0, "old", 1), (1, 0, "new", 2), (1, 0, "new", 2), (1, 1, None, 3), (1, 1, "x", 1), (2, 0, "n", None)]
    df = spark.createDataFrame(rows, "rollout_id long, step_index int, observation string, t long").withColumn("ingested_at", F.timestamp_micros("t"))
    assert {(r[0], r[1], r[2]) for r in latest_steps(df, "observation").collect()} == {(1, 0, "new"), (1, 1, None), (2, 0, "n")}
    assert cut(df).count() == 6
    assert "ResolvedHint" in broadcast_below(df, 10, 6)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in broadcast_below(df, 5, 6)._jdf.queryExecution().analyzed().toString()
