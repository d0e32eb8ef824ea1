"""Aggregates: distributions, length statistics, merged counters, rates, unpivoted metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.text import guarded_ratio


def distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, value: str, by: Sequence[str] = (), percentiles: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """count, mean, median, percentiles (linear interpolation) and max; zeros where a group has no value.

    Exact percentiles from a histogram: values are counted per group first, so a group's task holds distinct values only.
    """
    hist = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).filter("__v IS NOT NULL")
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    aggs = [F.coalesce(F.sum("__n"), F.lit(0)).alias("count"), z(F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias("mean"), z(F.expr("percentile(__v, 0.5D, __n)")).alias("median")]
    aggs += [z(F.expr(f"percentile(__v, {p}D, __n)")).alias(f"p{round(p * 100)}") for p in percentiles] + [z(F.max("__v")).alias("max")]
    return hist.groupBy(*by).agg(*aggs)


def merge_counters(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of MAP<key, count> columns key by key, as rows."""
    return df.select(*by, F.explode(column).alias("key", "__n")).groupBy(*by, "key").agg(F.sum("__n").alias("n"))


def rates(df: DataFrame, flags: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """rows, and of every flag the count of TRUE and its share (0.0 without rows); NULL is not TRUE."""
    d = df.select(*by, *(c.alias(n) for n, c in flags.items()))
    counts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(n)).alias(f"{n}_count") for n in flags))
    return counts.select(*by, "rows", *(x for n in flags for x in (f"{n}_count", guarded_ratio(F.col(f"{n}_count"), F.col("rows")).alias(f"{n}_rate"))))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per id and metric with a DOUBLE value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.select(*ids, F.explode(pairs).alias("__m")).select(*ids, "__m.metric", "__m.value")


def top_delta(base: DataFrame, other: DataFrame, label: str, value: str) -> DataFrame:
    """The label whose value differs most between two sides (ties: the greater label)."""
    j = base.select(label, F.col(value).alias("a")).join(other.select(label, F.col(value).alias("b")), label, "full_outer")
    delta = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return j.select(label, delta.alias("delta")).agg(F.max_by(F.struct(label, "delta"), F.struct(F.abs("delta"), F.col(label))).alias("m")).select(f"m.{label}", "m.delta")


def all_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """has_rows and finite: whether every value of the columns is a finite number."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return df.agg((F.count(F.lit(1)) > 0).alias("has_rows"), F.coalesce(F.every(ok), F.lit(True)).alias("finite"))
