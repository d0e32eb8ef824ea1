"""Per-key results under heavy key skew: eager aggregation through joins.

Both inputs are reduced to one compact state per key before anything is joined, with map-side partial aggregation, so a
key that holds a third of all rows reaches a reducer as a handful of partial states. The join then runs on the states
(one row per key and side) and everything that the row-level join would give is derived algebraically: the number of
joined rows of a key is the product of both counts, a sum over the joined rows is a sum times the other side's count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, aggs: Mapping[str, Column]) -> DataFrame:
    """One row per value of `key` (NULL is a value) with `rows` and the given aggregates.

    The aggregates must be mergeable (count, sum, min, max, percentile with frequencies ...). An empty input gives no row.
    """
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"), *(a.alias(n) for n, a in aggs.items()))


def eager_join(left: DataFrame, right: DataFrame, key: str, left_aggs: Mapping[str, Column] | None = None, right_aggs: Mapping[str, Column] | None = None, how: str = "full") -> DataFrame:
    """Join two inputs on `key` after reducing each to key states.

    Columns: key, left_rows, right_rows, joined_rows (the product: rows of the row-level equi join), left_<agg>,
    right_<agg>. NULL keys meet in one row whose joined_rows is 0, as NULL joins nothing. A key on one side only has
    0 rows on the other and NULL aggregates. Names of other input columns are irrelevant, as only aggregates leave.
    """
    left_aggs, right_aggs = left_aggs or {}, right_aggs or {}
    l, r = key_states(left, key, left_aggs).alias("l"), key_states(right, key, right_aggs).alias("r")
    j = l.join(r, F.col("l.key").eqNullSafe(F.col("r.key")), {"full": "full_outer"}.get(how, how))
    lr, rr = F.coalesce(F.col("l.rows"), F.lit(0)), F.coalesce(F.col("r.rows"), F.lit(0))
    key_col = F.coalesce(F.col("l.key"), F.col("r.key"))
    return j.select(
        key_col.alias("key"), lr.alias("left_rows"), rr.alias("right_rows"), F.when(key_col.isNull(), F.lit(0)).otherwise(lr * rr).alias("joined_rows"),
        *(F.col(f"l.{n}").alias(f"left_{n}") for n in left_aggs), *(F.col(f"r.{n}").alias(f"right_{n}") for n in right_aggs),
    )


def scaled_sum(value_sum: str, other_rows: str) -> Column:
    """Sum of a column of one side over the joined rows: its per-key sum times the other side's count."""
    return F.sum(F.coalesce(F.col(value_sum), F.lit(0)) * F.col(other_rows))


def heavy_keys(joined: DataFrame, names: Mapping[str, str], share: float = 0.05) -> DataFrame:
    """Keys (not NULL) that hold at least `share` of all rows of a side. names: side ("left", "right") -> name in `table_name`.

    The totals come from the states, not from another scan, and count NULL keys too. Exact integer comparison, so a
    key with precisely the share counts.
    """
    stacked = joined.select("key", F.explode(F.array(*(F.struct(F.lit(n).alias("table_name"), F.col(f"{s}_rows").alias("rows")) for s, n in names.items()))).alias("s")).select("key", "s.table_name", "s.rows")
    totals = stacked.groupBy("table_name").agg(F.sum("rows").alias("total"))
    # one row per side: the size of this broadcast doesn't depend on the data
    return stacked.join(F.broadcast(totals), "table_name").filter(F.col("key").isNotNull() & (F.col("rows") > 0) & (F.col("rows") >= F.lit(share) * F.col("total")))


def weighted_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of `value` per key (mean of the two middle values), from a pre-aggregated histogram.

    The first shuffle is on (key, value) and spreads a hot key over all tasks; what reaches the task of the key is one
    row per distinct value with its count. NULL values are left out; a key without values gives NULL.
    """
    hist = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("key").agg(F.expr("percentile(value, 0.5D, CASE WHEN value IS NULL THEN 0 ELSE n END)").alias("median"))


def distinct_counts(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Exact number of distinct non-NULL values per key and column, salted by the value itself.

    Each column is deduplicated on (key, value), a shuffle that no hot key can unbalance, and then counted with partial sums.
    """
    tagged = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)))).alias("t")).select("key", "t.c", "t.v")
    unique = tagged.groupBy("key", "c", "v").agg(F.lit(1).alias("one"))
    return unique.groupBy("key").agg(*(F.count(F.when(F.col("c") == i, F.col("v"))).alias(f"n_{c}") for i, c in enumerate(columns)))


def repo_results(steps: DataFrame, refs: DataFrame) -> DataFrame:
    """Per repo (as written): steps, rollouts, median observation length, latest step; instances, files; joined pairs.

    `steps` holds one row per step (see session.latest_steps) with repo, rollout_id, observation_chars, recorded_at; `refs` has
    repo, instance_id, source_file. NULL repo is one group. Repeated rows of refs count once as distinct values.
    """
    s = steps.select("repo", "rollout_id", "recorded_at", "observation_chars")
    states = eager_join(s, refs, "repo", {"latest_step": F.max("recorded_at")})
    out = states
    for side in (weighted_median(s, "repo", "observation_chars").withColumnRenamed("median", "median_observation_chars"), distinct_counts(s, "repo", "rollout_id"), distinct_counts(refs, "repo", "instance_id", "source_file")):
        out = out.alias("a").join(side.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")), "left").select("a.*", *(F.col(f"b.{c}") for c in side.columns if c != "key"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return out.select(
        F.col("key").alias("repo"), F.col("left_rows").alias("steps"), zero("n_rollout_id", "rollouts"), "median_observation_chars", F.col("left_latest_step").alias("latest_step"),
        F.col("right_rows").alias("refs"), zero("n_instance_id", "instances"), zero("n_source_file", "files"), F.col("joined_rows").alias("step_ref_pairs"),
    )
