"""Evaluation texts leaking into training text (problem 7).

Pigeonhole edit matching on words: a test item is cut into disjoint pieces, as many as its error budget plus one, short
enough that any passage of `min_words` words with at most `max_edits` edits leaves one piece untouched. Documents are
searched for exact pieces, and each hit is verified with Myers' bit-parallel distance over words.
"""

from __future__ import annotations

import re
import sys
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, BLANK = re.compile(r"\w+"), re.compile(" ")
MIN_WORDS = 13
#: Pieces in one block of items: the automaton of a block is some tens of MB, whatever the number of items.
BLOCK_PIECES = 200_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def piece_length(min_words: int, max_edits: int) -> int:
    """Longest q such that min_words words, at most max_edits of them hit, hold an untouched aligned piece of q words."""
    q = (min_words + 1) // (max_edits + 2)
    if q < 1:
        raise ValueError("too many edits for so few words")
    return q


def myers(pattern: list, text: list) -> list[int]:
    """Least edit distance of the whole pattern to any stretch of text ending at each position (bit-parallel, any length)."""
    m = len(pattern)
    if not m:
        return [0] * len(text)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


def _best(doc: list, item: list, at: int, pos: int, q: int, size: int, edits: int) -> tuple[int, int] | None:
    """Least distance of a passage of `size` item words around the piece to the document around the hit, and item start."""
    best = None
    lo, hi = max(0, pos - (size - q)), min(pos, len(item) - size)
    region = doc[max(0, at - (size - q) - edits) : at + size + edits]
    for s in range(lo, hi + 1):
        d = min(myers(item[s : s + size], region), default=size)
        if best is None or d < best[0]:
            best = (d, s)
            if d == 0:
                break
    return best


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, hits): documents that hold `min_words` words of an item with at most max_edits word edits.

    Words are runs of letters, digits and underscores in any case. Items shorter than min_words match nothing. The items
    are a stated query set: they come to the driver block by block (BLOCK_PIECES pieces each, in order of item_id) and
    every block passes over all documents; documents are never moved. NULL and empty texts match nothing; a document that
    occurs in several rows is reported once per id and item; items of equal text are all reported; extra columns are ignored.
    """
    spark, q = documents.sparkSession, piece_length(min_words, max_edits)
    src = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    parts, block, count = [], {}, 0

    def flush() -> None:
        if block:
            parts.append(_search(src, dict(block), q, min_words, max_edits))
            block.clear()

    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        w = words(row["t"])
        if len(w) >= min_words:
            block.setdefault(row["i"], []).append(w)
            count += len(w) // q
            if count >= BLOCK_PIECES:
                flush()
                count = 0
    flush()
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, distance int, hits bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.sum("hits").alias("hits"))


def _search(src: DataFrame, block: dict, q: int, size: int, edits: int) -> DataFrame:
    shared, name = src.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        cache = sys.__dict__.setdefault("_stepmill", {})
        key = ("leaks", name)
        if key not in cache:
            auto, where = ahocorasick.Automaton(), {}
            for i, texts in shared.value.items():
                for t, w in enumerate(texts):
                    for p in range(0, len(w) - q + 1, q):
                        where.setdefault(" " + " ".join(w[p : p + q]) + " ", []).append((i, t, p))
            for piece, at in where.items():
                auto.add_word(piece, (len(piece), at))
            auto.make_automaton()
            cache.clear()
            cache[key] = auto
        auto, items = cache[key], shared.value
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                # all but words becomes one blank, so that a piece is found as plain characters
                flat = " " + " ".join(WORD.findall(text.lower())) + " "
                hits: dict = {}
                for end, (length, at) in auto.iter(flat):
                    for i, t, p in at:
                        hits.setdefault(i, []).append((end + 1 - length, t, p))
                if not hits:
                    continue
                doc, blanks = flat.split(), [m.start() for m in BLANK.finditer(flat)]
                for i, found in hits.items():
                    best = None
                    for start, t, p in found:
                        if best is not None and best[0] == 0:
                            break
                        b = _best(doc, items[i][t], bisect_left(blanks, start), p, q, size, edits)
                        if b is not None and (best is None or b < best):
                            best = b
                    if best is not None and best[0] <= edits:
                        rows.append((d, i, best[0], len(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "hits"])

    ids = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInPandas(run, f"doc_id {ids['doc_id']}, item_id bigint, distance int, hits bigint")
