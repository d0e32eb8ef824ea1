"""Operators over the ordered steps of a trajectory. `key` names the trajectory, `step_index` its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.dims import PHASE_TOOLS


def last_matching(steps: DataFrame, key: str, condition: Column, value: str) -> DataFrame:
    """(key, last_step, value) of the last step that meets the condition; keys without such a step are absent."""
    return steps.filter(condition).groupBy(key).agg(F.max("step_index").alias("last_step"), F.max_by(value, "step_index").alias(value))


def consecutive_repeats(steps: DataFrame, key: str, tool: str, only: list[str], of: list[str]) -> DataFrame:
    """Per key and tool: steps equal to the step before, over the sequence of the tools in `only`, counted for those in `of`."""
    w = Window.partitionBy(key).orderBy("step_index")
    s = steps.filter(F.col(tool).isin(only)).withColumn("again", F.coalesce(F.col(tool) == F.lag(tool).over(w), F.lit(False)))
    return s.filter(F.col("again") & F.col(tool).isin(of)).groupBy(key, F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("repeats"))


def repeated_calls(steps: DataFrame, key: str, action: str, least: int = 3) -> DataFrame:
    """Calls with the same text that occur at least `least` times in a trajectory, wherever."""
    return steps.filter(F.col(action).isNotNull()).groupBy(key, F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least)


def phase_transitions(steps: DataFrame, by: list[str]) -> DataFrame:
    """Counts of previous -> current phase where both are known and differ."""
    ok = F.col("previous_phase").isNotNull() & F.col("phase").isNotNull() & (F.col("previous_phase") != F.col("phase"))
    return steps.filter(ok).groupBy(*by, F.concat_ws(" -> ", "previous_phase", "phase").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def phase_reach(steps: DataFrame, key: str) -> DataFrame:
    """Per key whether each phase was recorded as current or previous, and the source: recorded phases or, without any, tools."""
    reached = {p: F.coalesce(F.bool_or((F.col("phase") == p) | (F.col("previous_phase") == p)), F.lit(False)) for p in PHASE_TOOLS}
    proxy = {p: F.coalesce(F.bool_or(F.col("executed_tool").isin(*t)), F.lit(False)) for p, t in PHASE_TOOLS.items()}
    known = F.count("phase") > 0
    return steps.groupBy(key).agg(*(F.when(known, reached[p]).otherwise(proxy[p]).alias(f"reached_{p.lower()}") for p in PHASE_TOOLS), F.when(known, "recorded").otherwise("tools").alias("source"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per keys in the given order; a combinable minimum, so a hot key is never sorted. Ties go to any row."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*(c if c in keys else F.col(f"__first.`{c}`").alias(c) for c in df.columns))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "position", start: int = 0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) + (start - 1))


def prefix_history(steps: DataFrame, key: str, item: Column, name: str = "history") -> DataFrame:
    """Every step with the array of all earlier steps of its trajectory."""
    w = Window.partitionBy(key).orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn(name, F.collect_list(item).over(w))


def replay_phases(steps: DataFrame, key: str, search_limit: int = 3, list_limit: int = 2) -> DataFrame:
    """Replay of the phase machine: (key, final_phase, blocked, path).

    A conditional fold over the ordered steps: a blocked step (too many searches or listings in a row, a patch before any
    read, a tool that the phase does not allow) changes no counter; successes of the phase's tool move on, a failed test
    moves back. Folded inside the JVM by aggregate() over the array of one trajectory's slim structs.
    """
    arr = F.array_sort(F.collect_list(F.struct("step_index", F.col("tool"), F.coalesce(F.col("success"), F.lit(False)).alias("ok"))))
    seq = steps.groupBy(key).agg(arr.alias("steps"))
    zero = F.struct(F.lit("LOCATE").alias("phase"), F.lit(False).alias("read"), F.lit(0).alias("searches"), F.lit(0).alias("lists"), F.lit(0).alias("blocked"), F.lit("LOCATE").alias("path"))
    allowed = F.create_map(*[x for p, ts in PHASE_TOOLS.items() for x in (F.lit(p), F.array(*(F.lit(t) for t in ts)))])

    def step(s: Column, x: Column) -> Column:
        tool, ok = x["tool"], x["ok"]
        stop = ((tool == "list_files") & (s["lists"] >= list_limit)) | ((tool != "read_file") & (s["searches"] >= search_limit)) | ((tool == "apply_patch") & ~s["read"]) | ~F.coalesce(F.array_contains(allowed[s["phase"]], tool), F.lit(False))
        stop = F.coalesce(stop, F.lit(True))
        p = s["phase"]
        nxt = F.when(ok & (p == "LOCATE") & (tool == "search_code"), "UNDERSTAND").when(ok & (p == "UNDERSTAND") & (tool == "read_file"), "MODIFY").when(ok & (p == "MODIFY") & (tool == "apply_patch"), "VERIFY").when(~ok & (p == "VERIFY") & (tool == "run_test"), "UNDERSTAND").otherwise(p)
        nxt = F.when(stop, p).otherwise(nxt)
        return F.struct(
            nxt.alias("phase"),
            (s["read"] | (~stop & ok & (tool == "read_file"))).alias("read"),
            F.when(stop, s["searches"]).when(tool == "search_code", s["searches"] + 1).otherwise(0).alias("searches"),
            F.when(stop, s["lists"]).when(tool == "list_files", s["lists"] + 1).otherwise(0).alias("lists"),
            (s["blocked"] + stop.cast("int")).alias("blocked"),
            F.when(nxt != p, F.concat(s["path"], F.lit(">"), nxt)).otherwise(s["path"]).alias("path"),
        )

    return seq.select(key, F.aggregate("steps", zero, step).alias("r")).select(key, F.col("r.phase").alias("final_phase"), F.col("r.blocked").alias("blocked"), F.col("r.path").alias("path"))
