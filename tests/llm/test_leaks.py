import random

from stepmill.llm.leaks import find_leaks, myers, piece_length, words


def levenshtein_ends(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[1:]


def test_myers_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        assert myers(p, t) == levenshtein_ends(p, t)


def test_piece_length():
    assert [piece_length(13, e) for e in range(4)] == [7, 4, 3, 2]


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t or "")] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(5, 60)))) for i in range(12)] + [(100, None), (101, ""), (102, "one two three"), (3, "again " * 20)]
    docs = []
    for d in range(60):
        w = make(rng.randrange(0, 40))
        src = words(rng.choice(items[:12])[1])
        a = rng.randrange(max(1, len(src) - 12))
        docs.append((d, ", ".join(w + [x.upper() for x in src[a : a + rng.choice([11, 12, 13, 14, 20])]] + make(5))))
    docs += [(100, None), (101, ""), (5, docs[0][1]), (200, "AGAIN again-" * 5000)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, 13) and len(got) == len({(r[0], r[1]) for r in got})


def test_edits(spark):
    item = " ".join(f"t{i}" for i in range(40))
    doc = item.split()
    doc[10], doc[20] = "x", "y"
    docs = spark.createDataFrame([(1, " ".join(doc[12:22])), (2, " ".join(doc[8:25])), (3, " ".join(doc[5:13])), (4, item)], "doc_id long, text string")
    got = {r["doc_id"]: r["distance"] for r in find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), max_edits=2).collect()}
    assert got == {2: 1, 4: 0}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0 and find_leaks(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
