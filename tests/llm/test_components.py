import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepmill.llm import components as C


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)] + [("x", "x"), ("n01", "n01")]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "n01"), ("n02", None)], "src string, dst string")
    got = {r["node"]: r["component"] for r in C.hash_to_min(df).collect()}
    assert got == brute(edges)


def test_hash_to_min_star_and_empty(spark):
    star = spark.range(500).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), F.col("id")).alias("dst"))
    assert {r["component"] for r in C.hash_to_min(star).collect()} == {"hub"}
    assert C.hash_to_min(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("text", ["Own-er/Na.me", " own-er/na.me ", "own-er/na.me/", "own-er/na.me.git", "HTTPS://Code.Example/Own-er/Na.me", "https://u@code.example/own-er/na.me.git", "git@code.example:own-er/na.me.git", "ssh://git@code.example/own-er/na.me", "own-er__na.me", "code.example/own-er/na.me"])
def test_repo_spellings(spark, text):
    assert spark.createDataFrame([(text,)], "r string").select(C.repo_key(F.col("r"))).first()[0] == "own-er/na.me"


def test_repo_without_owner_is_none(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("name",)], "r string").select(C.repo_key(F.col("r"))).collect()
    assert [r[0] for r in rows] == [None] * 4


TASKS = "task_id long, instance_id string, repo string, base_commit string, `group` string"
FULL = "a" * 40


def groups(spark, rows, aliases=()):
    t = spark.createDataFrame([(*r, "clash") for r in rows], TASKS)
    a = spark.createDataFrame(list(aliases), "old_repo string, new_repo string")
    return {r["task_id"]: r["group"] for r in C.related_groups(t, a).collect()}


def test_related_groups(spark):
    rows = [
        (1, None, "A/x", "1" * 40), (2, None, "a/X ", "2" * 40), (3, None, "b/x", "3" * 40), (4, "a__x-7", None, None),
        (5, None, None, None), (6, None, "", "3" * 12), (7, None, "c/y", " " + "2" * 14 + "\n"), (8, None, None, None),
        (9, None, "old/z", FULL), (10, None, "new/z", "b" * 40), (11, None, None, "c" * 40), (12, None, None, "C" * 16), (1, None, "A/x", "1" * 40),
    ]
    got = groups(spark, rows, [("OLD/z", "mid/z"), ("mid/z", "new/z"), ("no/where", "else/where")])
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 3, 7: 1, 8: 8, 9: 9, 10: 9, 11: 11, 12: 11}


def test_related_groups_of_nothing(spark):
    assert groups(spark, []) == {}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(400):
        for _ in range(600 if g == 0 else 150 if g < 4 else rng.randrange(1, 12)):
            rows.append((n, g))
            n += 1
    out = C.assign_splits(spark.createDataFrame(rows, "task_id long, `group` long")).collect()
    assert len(out) == n and len({(r["group"], r["split"]) for r in out}) == 400
    c = Counter(r["split"] for r in out)
    assert abs(c["train"] / n - 0.8) < 0.01 and abs(c["test"] / n - 0.1) < 0.01
    again = C.assign_splits(spark.createDataFrame(rows, "task_id long, `group` long")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_splits_of_nothing(spark):
    assert C.assign_splits(spark.createDataFrame([], "task_id long, `group` long")).count() == 0
