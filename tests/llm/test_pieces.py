from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from stepmill.llm.pieces import split_observations, split_text


def check(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in spans) == text
    for k, (a, b, e) in enumerate(spans):
        assert e - a <= limit
        if k:
            before = text[spans[k - 1][0] : spans[k - 1][2]]
            assert text[a:b] == before[-overlap:] if overlap else a == b
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n😀", max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_long_texts():
    check("x" * 50_000, 4000, 200)
    check("\n" * 20_000, 4000, 200)
    check("word " * 60_000, 4000, 200)
    spans = check(("a line of text\n" * 40 + "\n") * 40, 4000, 200)
    # every cut is at a paragraph where paragraphs fit
    assert all(((b) % 601) == 0 for _, b, _ in spans)


def test_limits():
    assert split_text("", 10, 2) == [(0, 0, 0)]
    assert len(split_text("x" * 4000)) == 1 and len(split_text("x" * 4001)) == 2


SCHEMA = "rollout_id long, step_index int, observation string, ingested_at timestamp, piece int, pieces string"


def test_valid_delivery_counts(spark):
    d = [datetime(2025, 1, k) for k in (1, 2, 3)]
    long = "some words here\n" * 400
    rows = [(1, 0, long, d[0], 1, ""), (1, 0, "short", d[1], 1, ""), (1, 1, "short", d[0], 1, ""), (1, 1, long, d[1], 1, ""), (1, 1, long, d[1], 1, ""), (2, 0, None, d[0], 1, ""), (2, 1, "", d[0], 1, ""), (2, 2, "é" * 4000, d[0], 1, "")]
    steps = spark.createDataFrame(rows, SCHEMA)
    budget = spark.createDataFrame([(1, [(1, "read_file")]), (9, []), (8, None)], "rollout_id long, truncated_observations array<struct<history_index:int,tool:string>>")
    out = split_observations(steps, budget).orderBy("piece").collect()
    assert {(r["rollout_id"], r["step_index"], r["in_budget"]) for r in out} == {(1, 1, True)}
    assert "".join(r["piece_text"][r["overlap_chars"] :] for r in out) == long
    assert split_observations(spark.createDataFrame([], SCHEMA)).count() == 0
