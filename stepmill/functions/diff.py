"""Unified diffs: hunks, padded and merged line ranges, making and applying diffs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def file_sections(df: DataFrame, key: str, patch: str) -> DataFrame:
    """One row per file of a diff: key, file_index, path, section. Paths that leave the tree are dropped."""
    parts = F.filter(F.split(F.col(patch), r"(?m)^(?=--- [^\n]*\n\+\+\+ )"), lambda s: s.rlike(r"^--- [^\n]*\n\+\+\+ "))
    s = df.select(F.col(key).alias("key"), F.posexplode(parts).alias("file_index", "section"))
    new, old = (F.regexp_extract("section", r, 1) for r in (r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", r"(?m)^--- (?:a/)?([^\t\n]+)"))
    path = F.when(new == "/dev/null", old).otherwise(new)
    return s.select(F.col("key").alias(key), "file_index", path.alias("path"), (old == "/dev/null").alias("is_added"), (new == "/dev/null").alias("is_removed"), "section").filter(~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"))


def hunk_ranges(sections: DataFrame, key: str, pad: int = 30) -> DataFrame:
    """One row per hunk: the old lines it covers, padded by `pad` lines and not before line 1."""
    h = sections.select(key, "path", F.explode(F.transform(F.regexp_extract_all("section", F.lit(HUNK), 0), lambda x: F.struct(F.regexp_extract(x, HUNK, 1).cast("int").alias("at"), F.when(F.regexp_extract(x, HUNK, 2) == "", 1).otherwise(F.regexp_extract(x, HUNK, 2).try_cast("int")).alias("n")))).alias("h"))
    return h.select(key, "path", F.greatest(F.lit(1), F.col("h.at") - pad).alias("start"), (F.col("h.at") + F.greatest(F.col("h.n") - 1, F.lit(0)) + pad).alias("end"))


def merge_ranges(ranges: DataFrame, keys: list[str], gap: int = 20) -> DataFrame:
    """Gaps and islands: ranges whose start is at most `gap` after the end reached so far become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("new", F.when(F.col("start") <= reached + gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


@F.pandas_udf(T.StringType())
def unified_diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two versions of a file; empty if equal. NULL is an absent file."""
    def one(p, a, b):
        return "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "/dev/null" if a is None else f"a/{p}", "/dev/null" if b is None else f"b/{p}"))

    return pd.Series([one(p, a, b) for p, a, b in zip(path, before, after)], dtype=object)


def apply_ops(before: list[str], ops: list[tuple]) -> list[str]:
    out, at = [], 0
    for i1, i2, lines in sorted(ops):
        out += before[at:i1] + lines
        at = i2
    return out + before[at:]


def split_edits(before: str, after: str, path: str, budget: int) -> list[str]:
    """Diffs that, applied one after the other, turn before into after, each within `budget` estimated tokens where it can be.

    Each time the whole remaining change is tried first, then its first hunk, then the first edit alone, halved until it
    fits or is a single line.
    """
    cost = lambda s: max(1, (len(s) + 3) // 4)
    end = "\n\\ No newline at end of file\n"
    make = lambda x, y: "".join(d if d.endswith("\n") else d + end for d in difflib.unified_diff(x, y, f"a/{path}", f"b/{path}"))
    # lines end at line feeds only, as patches do
    a, b = (re.findall(r"[^\n]*\n|[^\n]+", x) for x in (before, after))
    done: list[str] = []
    while a != b:
        match = difflib.SequenceMatcher(None, a, b, autojunk=False)
        new, diff = b, make(a, b)
        if cost(diff) > budget:
            hunk = [(i1, i2, b[j1:j2]) for tag, i1, i2, j1, j2 in next(match.get_grouped_opcodes(3)) if tag != "equal"]
            new = apply_ops(a, hunk)
            diff = make(a, new)
            i1, i2, lines = hunk[0]
            if cost(diff) > budget and len(hunk) > 1:
                new = apply_ops(a, hunk[:1])
                diff = make(a, new)
            while cost(diff) > budget and max(i2 - i1, len(lines)) > 1:
                i2, lines = i1 + (i2 - i1 + 1) // 2, lines[: (len(lines) + 1) // 2]
                new = apply_ops(a, [(i1, i2, lines)])
                diff = make(a, new)
        done.append(diff)
        a = new
    return done


def split_patches(files: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, path, before, after) -> key, path, action_index, patch: bounded sequential diffs per file."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, p, i, d) for k, p, a, b in zip(pdf[key], pdf["path"], pdf["before"], pdf["after"]) for i, d in enumerate(split_edits(a or "", b or "", p, budget))]
            yield pd.DataFrame(rows, columns=[key, "path", "action_index", "patch"])

    return files.select(key, "path", "before", "after").mapInPandas(run, f"`{key}` {kind}, path string, action_index int, patch string")
