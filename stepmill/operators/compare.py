"""Joins and comparisons of two arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.operators.classify import boolean_outcome


def pairwise(base: DataFrame, other: DataFrame, key: str, flags: Sequence[str], lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Inner join of two arms by key: per flag improved/regressed/same, per number its delta and outcome (lower is better)."""
    j = base.alias("b").join(other.alias("o"), key)
    out = [F.col(key)]
    out += [boolean_outcome(F.col(f"b.{c}"), F.col(f"o.{c}")).alias(f"{c}_outcome") for c in flags]
    for c in lower_is_better:
        d = F.col(f"o.{c}") - F.col(f"b.{c}")
        out += [d.alias(f"{c}_delta"), F.when(d < 0, "improved").when(d > 0, "regressed").otherwise("same").alias(f"{c}_outcome")]
    return j.select(*out)


def left_expected(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every expected row with its record, or NULLs; `present` tells which."""
    f = found.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    return expected.join(f, key, "left").withColumn("present", F.col("records").isNotNull())


def metric_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new, delta) of two (metric, value) frames; a metric of one side has NULL on the other."""
    return old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer").withColumn("delta", F.col("new") - F.col("old"))


def comparable(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, equal) of two one-row headers, NULL equal to NULL."""
    j = a.select(*fields).withColumn("__one", F.lit(1)).alias("a").join(b.select(*fields).withColumn("__one", F.lit(1)).alias("b"), "__one")
    return j.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).alias("equal")) for f in fields))).alias("x")).select("x.*")


def join_by_file(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of right under the file names of left, one to one; a missing file or another key in it raises an error in the plan.

    File names are compared without their folders. The key comes from left.
    """
    name = lambda: F.element_at(F.split("source_file", "/"), -1)
    a = left.select(name().alias("file"), F.col(key).alias("__key"))
    b = right.withColumn("file", name()).drop("source_file").withColumnRenamed(key, "__found").withColumn("__there", F.lit(True))
    j = a.join(b, "file", "left")
    wrong = F.when(F.col("__there").isNull(), F.concat(F.lit("missing file: "), "file")).when(~F.col("__key").eqNullSafe(F.col("__found")), F.concat(F.lit("other key in file: "), "file"))
    return j.withColumn(key, F.when(wrong.isNotNull(), F.raise_error(wrong).cast(left.schema[key].dataType)).otherwise(F.col("__key"))).drop("__key", "__found", "__there")


def index_by_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest `order` (later files overwrite earlier ones)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def todo(candidates: DataFrame, outputs: DataFrame, lineage: Sequence[str]) -> DataFrame:
    """Candidates without an existing output of the same lineage keys."""
    return candidates.join(outputs.select(*lineage).distinct(), list(lineage), "left_anti")


def rank_files(issues: DataFrame, files: DataFrame, key: str, terms: Column, top: int = 400) -> DataFrame:
    """(key, path, score, rank): files of each issue ranked by the issue's terms in their paths.

    score = 10 per distinct term contained in the lower-case path, 2 for a source suffix, 1 if it contains test; ties by
    path. Issues and files meet by repo, an equi join; the terms are matched by an array function, so no term is crossed
    with a path. The top is a window over one issue's files.
    """
    from pyspark.sql import Window

    i = issues.select(key, "repo", terms.alias("terms"))
    j = i.join(files.select("repo", "path"), "repo")
    low = F.lower("path")
    score = F.size(F.filter("terms", lambda t: F.contains(low, t))) * 10 + low.rlike(r"\.(py|js|ts|java|c|cc|cpp|h|go|rs|rb)$").cast("int") * 2 + low.contains("test").cast("int")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "path")
    return j.select(key, "path", score.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
