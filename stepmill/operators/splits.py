"""Splits, duplicates and overlap audits as set operations."""

from __future__ import annotations

import random
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.session import cut


def search_group_split(counts: Mapping[str, int], seed: int | None = 42, min_train: int = 40, min_validation: int = 8, fraction: float = 0.2, max_groups: int = 24) -> tuple[set[str], set[str]]:
    """(train groups, validation groups): the proper subset whose rows come nearest to `fraction` of all, within the minima.

    Exhaustive over the subsets of the groups in (seeded) order; ties go to fewer groups, then to the smaller bit mask.
    The number of groups is a bounded input; more than max_groups raise an error.
    """
    names = sorted(counts)
    if seed is not None:
        random.Random(seed).shuffle(names)
    if len(names) > max_groups:
        raise ValueError(f"{len(names)} groups; exhaustive search takes at most {max_groups}")
    total, best = sum(counts.values()), None
    sums = [0] * (1 << len(names))
    for mask in range(1, (1 << len(names)) - 1):
        low = mask & -mask
        sums[mask] = sums[mask ^ low] + counts[names[low.bit_length() - 1]]
        n = sums[mask]
        if n >= min_validation and total - n >= min_train:
            score = (abs(n - fraction * total), mask.bit_count(), mask)
            if best is None or score < best:
                best = score
    if best is None:
        raise ValueError("no split meets the minima")
    chosen = {names[i] for i in range(len(names)) if best[2] >> i & 1}
    return set(names) - chosen, chosen


def search_group_split_df(counts: DataFrame, group: str, n: str, min_train: int, min_validation: int, fraction: float = 0.2) -> DataFrame:
    """The same search as a plan: subsets are rows of a bit mask range, groups in alphabetical order. Raises for more than 20 groups."""
    packed = counts.agg(F.array_sort(F.collect_list(F.struct(group, n))).alias("g"))
    k = F.when(F.size("g") > 20, F.raise_error(F.lit("search_group_split_df takes at most 20 groups")).cast("int")).otherwise(F.size("g"))
    packed = packed.select("g", k.alias("k"), F.lit(1).alias("one"))
    # the subsets are spread over tasks, the groups are one row of at most 20 entries
    masks = counts.sparkSession.range(1, 1 << 20).select(F.col("id").alias("mask"), F.lit(1).alias("one")).join(F.broadcast(packed), "one").filter(F.expr("mask < shiftleft(1, k) - 1")).drop("one", "k")
    inside = F.filter("g", lambda x, i: F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == 1)
    m = masks.select("mask", inside.alias("v"), F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x[n]).alias("total"))
    m = m.withColumn("rows", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x[n])).filter((F.col("rows") >= min_validation) & (F.col("total") - F.col("rows") >= min_train))
    best = m.agg(F.min_by(F.struct("v", "rows", "total"), F.struct(F.abs(F.col("rows") - F.col("total") * fraction), F.size("v"), F.col("mask"))).alias("b"))
    return best.select(F.array_join(F.transform("b.v", lambda x: x[group]), ",").alias("validation_groups"), F.col("b.rows").alias("validation_rows"), (F.col("b.total") - F.col("b.rows")).alias("train_rows")).filter("validation_rows IS NOT NULL")


def apply_group_split(df: DataFrame, group: str, split: DataFrame) -> DataFrame:
    """Adds split from (group, split); rows without one are kept with NULL, so that they can be reported."""
    return df.join(split.select(group, "split"), group, "left")


def overlap_audit(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(key, value, splits): values of the keys that occur in more than one split."""
    parts = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    d = df.select(split, F.explode(parts).alias("p")).select("p.key", "p.value", split).filter(F.col("value").isNotNull() & F.col(split).isNotNull())
    return d.groupBy("key", "value", split).agg(F.lit(1).alias("one")).groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def duplicate_groups(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(digest, n, first_id): texts that occur more than once. Membership follows by joining on the digest; ids are not collected."""
    return df.select(key, F.sha2(text, 256).alias("digest")).filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).filter("n > 1")


def exact_dedup(df: DataFrame, key: str, text: Column) -> DataFrame:
    """One row per distinct text, that of the smallest key; rows of NULL text are all kept, as nothing tells that they are equal.

    The digests are grouped without the texts; the semi join by key then moves each row once.
    """
    keep = df.select(F.col(key), F.sha2(text, 256).alias("digest")).filter("digest IS NOT NULL").groupBy("digest").agg(F.min(key).alias(key)).select(key)
    return df.filter(text.isNotNull()).join(keep, key, "left_semi").unionByName(df.filter(text.isNull()))


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing (expected, not found), unexpected, duplicate (found more than once)."""
    e, f = expected.select(key).filter(F.col(key).isNotNull()).distinct(), found.select(key).filter(F.col(key).isNotNull())
    return e.join(f, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(f.join(e, key, "left_anti").distinct().withColumn("problem", F.lit("unexpected"))).unionByName(f.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("duplicate").alias("problem")))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The frame itself; raises if a key occurs twice."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[0] for r in twice]}")
    return df


def prompt_leakage(prompt: Column, secrets: Mapping[str, Column], literals: Mapping[str, str] | None = None, least: int = 1) -> Column:
    """Sorted labels of the secrets whose trimmed text stands in the prompt, and of literals in any case; empty secrets never match."""
    labels = []
    for name, c in secrets.items():
        s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        labels.append(F.when((F.length(s) >= least) & F.contains(prompt, s), name))
    for name, literal in (literals or {}).items():
        labels.append(F.when(F.contains(F.lower(prompt), F.lit(literal.lower())), name))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))


def seeded_selection(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in a seeded order of the keys' hashes, numbered from 0. A top-n, so no full sort."""
    h = F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256)
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).withColumn("position", F.row_number().over(_order("__h", key)) - 1).drop("__h")


def _order(*cols: str):
    from pyspark.sql import Window

    # only over the n rows that a limit left
    return Window.orderBy(*cols)


def seeded_train_split(df: DataFrame, key: str, n: int, train: int, seed: int) -> DataFrame:
    return seeded_selection(df, key, n, seed).withColumn("split", F.when(F.col("position") < train, "train").otherwise("validation"))


def smoke_subset(df: DataFrame, key: str, tokens: str, phase: str, longest: int = 4, per_phase: int = 2, seed: int = 42, count: int | None = None) -> DataFrame:
    """The longest rows and a few hashed picks of each phase, filled up to `count` rows by least hash, with the reason of the rule that chose them."""
    from pyspark.sql import Window

    top = df.orderBy(F.desc(tokens), key).limit(longest).select(key, F.lit("longest").alias("reason"))
    h = F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256)
    # least hashes per phase as bounded aggregates instead of a sort of a whole phase
    rest = df.join(F.broadcast(top.select(key)), key, "left_anti")
    cand = rest.withColumn("bucket", F.spark_partition_id()).withColumn("__h", h)
    w = Window.partitionBy(phase, "bucket").orderBy("__h", key)
    cand = cand.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_phase)
    w = Window.partitionBy(phase).orderBy("__h", key)
    picks = cand.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_phase).select(key, F.lit("phase").alias("reason"))
    chosen = top.unionByName(picks)
    if count is None:
        return chosen
    # a few keys for each phase
    chosen = cut(chosen)
    fill = df.select(key, h.alias("__h")).join(chosen.select(key), key, "left_anti").orderBy("__h", key).limit(max(0, count - chosen.count()))
    return chosen.unionByName(fill.select(key, F.lit("fill").alias("reason")))
