"""Splitting oversized items at natural boundaries (problem 5).

Agglomerative merging: a text starts as atomic segments (lines, of long lines sentences, of long sentences words, of long
words slices); a heap holds the boundaries between neighbours, and the weakest boundary is removed first as long as the
merged segment and the overlap fit the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200

_SENTENCE = re.compile(r"(?<=[.!?;:,])\s+|\s+(?=[({\[])")
_BLANK = re.compile(r"\s+")


def _atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary after it) of the atomic segments; strengths: 5 blank line, 4 line end before an
    unindented line, 3 line end, 2 sentence or clause end, 1 blank, 0 inside a word."""
    out: list[tuple[int, int, int]] = []

    def cuts(start: int, end: int, level: int, after: int) -> None:
        if end - start <= room:
            out.append((start, end, after))
            return
        if level == 0:
            # slices of equal length leave their neighbours room to join them
            step = -(-(end - start) // -(-(end - start) // room))
            for i in range(start, end, step):
                j = min(i + step, end)
                out.append((i, j, after if j == end else 0))
            return
        pattern = _SENTENCE if level == 2 else _BLANK
        at = start
        for m in pattern.finditer(text, start, end):
            if at < m.end() < end:
                cuts(at, m.end(), level - 1, level)
                at = m.end()
        cuts(at, end, level - 1, after)

    at, n = 0, len(text)
    while at < n:
        j = text.find("\n", at)
        j = n if j < 0 else j + 1
        if j < n and text[j] in "\r\n":
            strength = 5
        elif text[at:j].strip() == "":
            strength = 5
        else:
            strength = 4 if j < n and not text[j].isspace() else 3
        cuts(at, j, 2, strength)
        at = j
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece, in code points: text[start:end] is the piece, text[start:body start] its overlap.

    Every piece has at most `limit` characters; each but the first starts with the last `overlap` characters of the one
    before (all of it, if that is shorter); the bodies put together are the text. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    room = limit - overlap
    seg = _atoms(text, room)
    k = len(seg)
    start, end, power = ([s[i] for s in seg] for i in range(3))
    prev, nxt, alive, version = list(range(-1, k - 1)), [*range(1, k), -1], [True] * k, [0] * k
    # among equally weak boundaries the smallest merged segment goes first, so that pieces grow evenly
    heap = [(power[i], end[i + 1] - start[i], i, 0, 0) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, vi, vj = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or version[i] != vi or version[j] != vj:
            continue
        # the first piece repeats nothing, so the whole limit is its own
        if size > (room if start[i] else limit):
            continue
        end[i], power[i], nxt[i] = end[j], power[j], nxt[j]
        alive[j] = False
        version[i] += 1
        if nxt[i] >= 0:
            prev[nxt[i]] = i
            heapq.heappush(heap, (power[i], end[nxt[i]] - start[i], i, version[i], version[nxt[i]]))
        if prev[i] >= 0:
            heapq.heappush(heap, (power[prev[i]], end[i] - start[prev[i]], prev[i], version[prev[i]], version[i]))
    out: list[tuple[int, int, int]] = []
    for i in range(k):
        if alive[i]:
            # a piece before may be shorter than the overlap: then all of it is repeated
            at = max(out[-1][0], start[i] - overlap) if out else start[i]
            out.append((at, start[i], end[i]))
    return out


def split_long(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than `limit`: keys, piece (from 0), pieces, overlap_chars, piece_text, all as rows.

    NULL and short texts give no rows, equal texts of other keys are split alike, repeated rows are split each, and extra
    columns are left out. Lengths are code points.
    """
    src = df.filter(F.length(text) > limit).select(*keys, F.col(text).alias("__text"))
    fields = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", piece int, pieces int, overlap_chars int, piece_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                t = row[-1]
                spans = split_text(t, limit, overlap)
                rows.extend((*row[:-1], i, len(spans), b - a, t[a:e]) for i, (a, b, e) in enumerate(spans))
            yield pd.DataFrame(rows, columns=[*keys, "piece", "pieces", "overlap_chars", "piece_text"])

    return src.mapInPandas(run, schema)


def split_observations(steps: DataFrame, budget: DataFrame | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every valid observation over the limit; `in_budget` tells whether budget_results names the step as truncated.

    Of repeated deliveries the one with the latest ingested_at holds, also where only an older one is oversized. Short
    texts are not shuffled: the deduplication carries the text of oversized ones only.
    """
    slim = steps.select("rollout_id", "step_index", "ingested_at", F.when(F.length("observation") > limit, F.col("observation")).alias("observation"))
    valid = slim.groupBy("rollout_id", "step_index").agg(F.max_by("observation", F.coalesce("ingested_at", F.timestamp_micros(F.lit(-(2**62))))).alias("observation"))
    out = split_long(valid, ["rollout_id", "step_index"], "observation", limit, overlap)
    if budget is None:
        return out
    named = budget.select("rollout_id", F.explode("truncated_observations").alias("t")).select("rollout_id", F.col("t.history_index").alias("step_index")).filter("step_index IS NOT NULL").groupBy("rollout_id", "step_index").agg(F.lit(True).alias("named"))
    return out.join(named, ["rollout_id", "step_index"], "left").withColumn("in_budget", F.coalesce("named", F.lit(False))).drop("named")
