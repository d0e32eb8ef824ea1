import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stepmill.llm import overlap as O

SCHEMA = "traj_id long, instance_id string, repo string, problem_statement string, split string, steps array<struct<tool:string,arguments:string,observation:string>>, class string, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("text,want", [("Train", "train"), (" training ", "train"), ("TR", "train"), ("val", "validation"), ("dev", "validation"), ("Valid", "validation"), ("TEST", "test"), ("testing", "test"), (None, None), ("other", None), ("", None)])
def test_split_spellings(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(O.split_class(F.col("s"))).first()[0] == want


def test_normal_words(spark):
    rows = ["## A *bold*  _word_\r\n`x_y` <b>t</b> &amp; 3.5", None, "", " ... "]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "s string").select(O.normal_words(F.col("s"))).collect()]
    assert got == ["a bold word x_y t 3 5", None, "", ""]


def edit(rng, words, share):
    w = list(words)
    for _ in range(int(len(w) * share)):
        k, i = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[i] = f"new{rng.randrange(50)}"
        elif k == 1 and len(w) > 3:
            del w[i]
        else:
            w.insert(i, f"ins{rng.randrange(50)}")
    return w


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_lcs():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        want = plain_lcs(a, b)
        assert O.lcs(a, b) == want and O.lcs(a, b, want) == want and O.lcs(a, b, want + 1) in (0, want)


@pytest.mark.parametrize("width,r", [(1, 0.75), (2, 0.75), (2, 0.85), (3, 0.85)])
def test_bound_holds_for_any_layout(width, r):
    rng = random.Random(width)
    seen = 0
    for _ in range(4000):
        a = [rng.randrange(9999) for _ in range(rng.randrange(1, 60))]
        x, y = list(a), list(a)
        for _ in range(rng.randrange(0, len(a) // 2 + 1)):
            z = rng.choice((x, y))
            z.insert(rng.randrange(len(z) + 1), rng.randrange(9999)) if rng.random() < 0.7 or len(z) < 2 else z.pop(rng.randrange(len(z)))
        n = len(x) + len(y)
        if O.ratio(x, y) > r and n > O.short_words(width, r):
            grams = lambda z: Counter(tuple(z[i : i + width]) for i in range(len(z) - width + 1))
            shared = (grams(x) & grams(y)).total()
            assert shared >= O.shared_shingles(n, width, r)
            assert all(O.shared_shingles(n, width, r) >= O.always_shared(np.array([len(z)]), width, r)[0] for z in (x, y))
            seen += 1
    assert seen > 300


def test_insertions_on_alternating_sides(spark):
    """Ratio 0.896 and not one shingle of five words in common."""
    base = [f"w{i}" for i in range(60)]
    sides = [[], []]
    for i, w in enumerate(base):
        for side in (0, 1):
            sides[side].append(w)
        if i % 4 == 3:
            sides[i // 4 % 2].append(f"only{i}")
    rows = [(1, None, "r", " ".join(sides[0]), "train", None), (2, None, "r", " ".join(sides[1]), "test", None)]
    rows += [(3, None, "r", None, "train", [("read_file", "{}", " ".join(sides[0]))]), (4, None, "r", None, "test", [("read_file", "{}", " ".join(sides[1]))])]
    assert 0.85 < O.ratio(*sides) < 0.92
    assert {(r["eval_id"], r["train_id"]) for r in O.overlap_pairs(frame(spark, rows)).collect()} == {(2, 1), (4, 3)}


@pytest.mark.parametrize("vocabulary", [25, 300])
def test_against_brute_force(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(O, "BUCKET", 700)
    monkeypatch.setattr(O, "CHUNK", 64)
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(vocabulary)]
    rows, n = [], 0
    for size in [1, 1, 2, 3, 4, 6, 9, 12, 17, 30, 60, 120] * 3:
        base = [rng.choice(vocab) for _ in range(size)]
        for share in (0, 0, 0.1, 0.2, 0.3, 0.5):
            n += 1
            steps = None if n % 4 else [("read_file", '{"path": "a"}', " ".join(edit(rng, base, share)))]
            rows.append((n, None, f"r{n % 3}", " ".join(edit(rng, base, share)).upper(), rng.choice(["train", "val", "Test", None]), steps))
    got = {(r["eval_id"], r["train_id"]) for r in O.overlap_pairs(frame(spark, rows)).collect()}
    side = lambda r: r[4] and ("t" if r[4] == "train" else "e")
    words = lambda r: [r[3].lower().split(), ["read_file", "path", "a", *r[5][0][2].split()] if r[5] else []]
    want, edge = set(), 0
    for a in rows:
        for b in rows:
            if side(a) == "e" and side(b) == "t":
                ratios = [2 * plain_lcs(x, y) / (len(x) + len(y)) for x, y in zip(words(a), words(b)) if x and y]
                edge += any(0.75 < q < 0.85 for q in ratios)
                if max(ratios) > 0.75:
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 60 and edge > 10


def test_instance_ids_nulls_and_copies(spark):
    text = "a statement of more than five words for every copy of it"
    rows = [(1, " Own__Name-1", "r", None, "train", None), (2, "own__name-1 ", "r", "", "valid", []), (3, None, "r", text, "train", None), (3, None, "r", text, "train", None), (4, "", "r", text.title() + "!", "TEST", None), (5, "", None, None, "test", None), (6, None, "r", text, None, None), (None, "own__name-1", "r", text, "test", None)]
    pairs = {(r["eval_id"], r["train_id"]): r["kinds"] for r in O.overlap_pairs(frame(spark, rows)).collect()}
    assert pairs == {(2, 1): ["instance_id"], (4, 3): ["problem_statement"]}
    report = {(r["kind"], r["split"]): (r["records"], r["pairs"]) for r in O.overlap_report(frame(spark, rows)).collect()}
    assert report == {("instance_id", "validation"): (1, 1), ("problem_statement", "test"): (1, 1)}


def test_empty(spark):
    assert O.overlap_pairs(frame(spark, [])).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_nothing_is_moved_for_pairs_that_are_not_near(spark):
    """All texts share their words, so each meets each; what is moved follows the texts, not the pairs."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices([f"v{i}" for i in range(60)], k=90))
    rows = [(i, None, "r", text(), "test" if i % 4 == 0 else "train", None) for i in range(2400)]
    rows.append((9999, None, "r", rows[0][3].replace("v1 ", "x ", 2), "train", None))
    before = shuffled(spark)
    assert [(r["eval_id"], r["train_id"]) for r in O.overlap_pairs(frame(spark, rows)).collect()] == [(0, 9999)]
    assert shuffled(spark) - before < 4 * sum(len(r[3]) for r in rows)


def test_words_in_python_are_those_of_the_expression(spark):
    rng = random.Random(9)
    # no letters beyond 16 bits: Java looks behind by 16 bits and takes an underscore after one off
    chars = list("aB9_ <>/&;#.\n\t-\\") + ["é", "é", "́", "ß", "İ", "中", "٣", "²", "Ⅷ", " ", "‍", "😀", "__", "</b>", "&amp;", "&#12;", "_x_"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(40))) for _ in range(3000)] + ["a__b _c_ __ d_", "́_a_́", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", F.lower("s").alias("low"), O.normal_words(F.col("s")).alias("want")).collect()
    assert [(r["s"], " ".join(O.words_of(r["low"]))) for r in rows] == [(r["s"], r["want"]) for r in rows]


def test_places_of_a_bound_never_lose_a_pair():
    """Few columns, many repeated and frequent words, texts of any length: a pair that is near passes."""
    rng, seen = random.Random(21), 0
    for n in (1, 2, 5, 20, 80, 400):
        draw = lambda k: np.array([min(int(rng.expovariate(0.2)), 300) for _ in range(k)], dtype=np.uint16)
        e = sorted((draw(rng.randrange(1, n + 2)) for _ in range(60)), key=len)
        t = sorted([draw(rng.randrange(1, n + 2)) for _ in range(60)] + [np.concatenate([x[: len(x) * 9 // 10], draw(len(x) // 9)]) for x in e if len(x) > 1], key=len)
        want = {(i, j) for i, x in enumerate(e) for j, y in enumerate(t) if 8 * (Counter(x.tolist()) & Counter(y.tolist())).total() > 3 * (len(x) + len(y))}
        assert set(O._near(e, t, 0.75, 16)) == want
        seen += len(want)
    assert seen > 200


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Functions travel by value; what they hold must not be looked up in the package."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps((O.words_of, O._near, O._PLACES, O.shared_shingles)))
    code = "import pickle; w, near, places, _ = pickle.load(open('f', 'rb')); import numpy as np; t = [np.array([places[x] for x in w('a _b_ c_d')], np.uint16)]; print(w('a _b_ c_d'), list(near(t, t, 0.75, 64)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.stdout.split("\n")[0] == "['a', 'b', 'c_d'] [(0, 0)]", run.stderr[-500:]
