import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepmill.llm.packing import TOKENIZER, Bm25, Topics, pack_documents, pack_shard, shards_of_topics


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=60), max_size=25), st.integers(5, 30))
def test_every_token_once(texts, capacity):
    items = [np.array(t, dtype=np.int32) for t in texts]
    out = pack_shard(items, capacity)
    assert all(sum(b - a for _, a, b in w) <= capacity for w in out)
    spans = sorted((i, a, b) for w in out for i, a, b in w)
    for i, t in enumerate(texts):
        mine = [(a, b) for k, a, b in spans if k == i]
        assert mine[0][0] == 0 and mine[-1][1] == len(t) and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
        assert len(mine) == max(1, -(-len(t) // capacity))


def test_bm25_against_formula():
    items = [np.array(x) for x in ([1, 1, 2], [1, 3], [4, 4, 4], [2, 5, 6])]
    s = Bm25(items, 1.0).scores(0)
    n, mean = 4, 11 / 4
    want = []
    for d in items:
        t = 0.0
        for q in (1, 2):
            df, tf = sum(q in x for x in items), int((d == q).sum())
            t += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        want.append(t)
    assert np.allclose(s, want)


def test_neighbours_share_windows():
    rng = np.random.default_rng(1)
    # ten topics of eight texts; a window holds eight
    items = [np.concatenate([rng.integers(t * 100, t * 100 + 20, 50)]) for t in range(10) for _ in range(8)]
    out = pack_shard(items, 400)
    assert len(out) == 10 and np.mean([len({i // 8 for i, _, _ in w}) for w in out]) < 1.5


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_frame(spark):
    rows = [(1, "word " * 5000, "a"), (2, None, "a"), (3, "", "a"), (4, "some text", "a"), (4, "some text", "a"), (None, "no id", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = pack_documents(df).collect()
    assert {r["doc_id"] for r in out if r["pieces"] > 1} == {1}
    per = {}
    for r in out:
        per.setdefault(r["container"], []).append((r["position"], r["n_tokens"]))
    assert all(sum(n for _, n in v) <= 2048 and sorted(p for p, _ in v) == list(range(len(v))) for v in per.values())
    assert sum(r["doc_id"] == 4 for r in out) == 2 and any(r["doc_id"] is None for r in out) and any(r["doc_id"] == 2 for r in out)
    assert pack_documents(df.limit(0)).count() == 0


def test_shards_of_topics():
    got = shards_of_topics([(0, 5, 50), (1, 4, 40), (2, 30, 300), (3, 2, 900), (5, 1, 1)], 10, 1000)
    assert got == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 5: (4, 1)}
    assert shards_of_topics([], 10, 10) == {}


def test_topics_keep_neighbours():
    rng = np.random.default_rng(2)
    items = [rng.integers(t * 500, t * 500 + 200, 60) for t in range(6) for _ in range(40)]
    topics = Topics(items[::2], topics=6)
    of = topics.of(items)
    # a text's best neighbour has the same topic; of 239 others 39 are of its kind
    index = Bm25(items, 1.0)
    best = [int(np.argmax(np.where(np.arange(240) == i, -1, index.scores(i)))) for i in range(240)]
    assert np.mean(of[best] == of) > 0.8 and len(set(of)) >= 5
    assert Topics([]).of([np.array([1, 2]), np.zeros(0, int)]).tolist() == [0, 0]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_many_shards_and_a_hot_text(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "the same text over and over") for i in range(150)] + [(1000 + i, " ".join(f"w{x}" for x in rng.integers(i % 5 * 50, i % 5 * 50 + 50, 30))) for i in range(300)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=200, shard_docs=40).collect()
    assert sorted({r["doc_id"] for r in out}) == sorted(i for i, _ in rows)
    shards = {}
    for r in out:
        shards.setdefault(r["container"].split("-")[0], set()).add(r["doc_id"])
    assert len(shards) > 8 and max(map(len, shards.values())) < 90
    per = {}
    for r in out:
        per[r["container"]] = per.get(r["container"], 0) + r["n_tokens"]
    assert max(per.values()) <= 200
    again = pack_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string"), capacity=200, shard_docs=40).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
