"""Streaming forms: windowed tool counts with a watermark and the phase machine as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepmill.functions.dims import PHASE_TOOLS


def tool_counts(steps: DataFrame, time: str = "recorded_at", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Steps and failures per tool and tumbling window; rows later than the watermark are dropped, repeats within it count once."""
    s = steps.withWatermark(time, late).dropDuplicatesWithinWatermark(["rollout_id", "step_index"])
    g = s.groupBy(F.window(time, window).alias("w"), F.col("executed_tool").alias("tool"))
    return g.agg(F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("tool_success")).alias("failures")).select(F.col("w.start").alias("window_start"), "tool", "steps", "failures")


def replay_stream(steps: DataFrame, search_limit: int = 3, list_limit: int = 2) -> DataFrame:
    """Phase machine over a stream of (rollout_id, step_index, tool, success); emits (rollout_id, phase, blocked, seen) per batch.

    State per rollout is a handful of counters. Steps are folded in order of step_index within a batch; a step at or before
    the last one folded is a repeat and changes nothing.
    """
    phases = {p: set(t) for p, t in PHASE_TOOLS.items()}
    nxt = {("LOCATE", "search_code", True): "UNDERSTAND", ("UNDERSTAND", "read_file", True): "MODIFY", ("MODIFY", "apply_patch", True): "VERIFY", ("VERIFY", "run_test", False): "UNDERSTAND"}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        phase, read, searches, lists, blocked, last = state.get if state.exists else ("LOCATE", False, 0, 0, 0, -1)
        pdf = pd.concat(list(batches)).sort_values("step_index", kind="stable")
        for i, tool, ok in zip(pdf["step_index"], pdf["tool"], pdf["success"]):
            if i <= last:
                continue
            last = int(i)
            ok = bool(ok) if ok is not None and ok == ok else False
            stop = (tool == "list_files" and lists >= list_limit) or (tool != "read_file" and searches >= search_limit) or (tool == "apply_patch" and not read) or tool not in phases[phase]
            if stop:
                blocked += 1
                continue
            searches = searches + 1 if tool == "search_code" else 0
            lists = lists + 1 if tool == "list_files" else 0
            read = read or (ok and tool == "read_file")
            phase = nxt.get((phase, tool, ok), phase)
        state.update((phase, read, searches, lists, blocked, last))
        yield pd.DataFrame({"rollout_id": [key[0]], "phase": [phase], "blocked": [blocked], "seen": [last + 1]})

    s = steps.select("rollout_id", "step_index", "tool", "success")
    return s.groupBy("rollout_id").applyInPandasWithState(fold, "rollout_id long, phase string, blocked long, seen long", "phase string, read boolean, searches long, lists long, blocked long, last long", "update", "NoTimeout")
