"""Repeated consecutive events in sequences (problem 3).

Each event is reduced to the digest of its call's meaning, compared with its predecessor through a lag window, and the
running sum of the change flags numbers the runs. A sequence of any length is cut into blocks of consecutive positions
that are handled in different tasks; only runs that touch a block's edge meet in a second, small window.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepmill.functions.dims import ALIASES

# Defaults that may be given or left out.
DEFAULTS = {"list_files": {"path": ".", "max_entries": 200}, "search_code": {"path": ".", "max_results": 50}}
BLOCK = 4096

_CALL = re.compile(r"\s*([^({]*?)\s*\((.*)\)\s*\Z", re.S)
_BARE = re.compile(r"\s*([^({\s:]+)\s*:?\s*(\{.*\})\s*\Z", re.S)
_SCRATCH = re.compile(r"""\s(?:--(?:basetemp|rootdir-tmp|cache-dir|tmpdir|temp-dir)(?:=|\s+)(?:"[^"]*"|'[^']*'|\S+)|-o\s*cache_dir=\S+|-p\s*no:cacheprovider|--cache-clear|--no-cache(?:-dir)?)(?=\s|\Z)""")


def _parse(text: str):
    text = text.strip()
    if not text:
        return {}
    try:
        return json.loads(text, strict=False)
    except ValueError:
        pass
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def _path(p: str) -> str:
    p = p.strip().replace("\\", "/")
    out: list[str] = []
    for part in p.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(part)
    return ("/" if p.startswith("/") else "") + "/".join(out) or "."


def canonical_call(action: str | None) -> str | None:
    """The meaning of `tool(arguments)` as a string; equal strings are equal calls. NULL stays NULL.

    What can't be parsed is compared as its own text, outer blanks aside, under the tool's one name.
    """
    if action is None:
        return None
    m = _CALL.match(action) or _BARE.match(action)
    name, body = (m[1], m[2]) if m else (action, "")
    tool = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")
    tool = ALIASES.get(tool, tool)
    args = _parse(body)
    if not isinstance(args, dict):
        return f"{tool}\x00{' '.join(body.split())}"
    clean = {}
    for k, v in args.items():
        k = str(k).strip()
        if v is None:
            continue
        if isinstance(v, str):
            if k in ("path", "file", "file_path", "directory"):
                v = _path(v)
            elif k == "query":
                v = v.strip().lower()
            elif k == "command":
                before = None
                v = " ".join(v.split())
                while before != v:
                    before, v = v, _SCRATCH.sub("", v)
        elif isinstance(v, float) and v.is_integer():
            v = int(v)
        if DEFAULTS.get(tool, {}).get(k) == v and not isinstance(v, bool):
            continue
        clean[k] = v
    return f"{tool}\x00{json.dumps(clean, sort_keys=True, default=repr)}"


@F.pandas_udf(T.BinaryType())
def call_digest(actions: pd.Series) -> pd.Series:
    seen: dict = {}

    def one(a):
        if a is None:
            return None
        d = seen.get(a)
        if d is None:
            d = seen[a] = hashlib.blake2b(canonical_call(a).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return d

    return actions.map(one)


def collapse_runs(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each rollout with every run of equal consecutive events as one event.

    Columns: rollout_id, first_step_index, last_step_index, n_steps, phase, executed_tool, started_at, ended_at,
    duration_s. A run is broken by a gap in step_index. Repeated deliveries are one step, the latest ingested_at holds.
    NULL phase, tool or action equals NULL. started_at and ended_at are the least and largest recorded_at in the run that
    are not NULL, duration_s is their difference, NULL if there is none. Rows with NULL rollout_id or step_index are no
    part of a sequence and are left out. Empty input gives an empty result; extra columns are ignored.
    """
    s = steps.filter("rollout_id IS NOT NULL AND step_index IS NOT NULL").select(
        "rollout_id", "step_index", F.floor(F.col("step_index") / block).alias("block"), "phase", "executed_tool", call_digest("action").alias("call"), "recorded_at",
        F.coalesce(F.col("ingested_at"), F.timestamp_micros(F.lit(-(2**62)))).alias("ingested_at"),
    )
    # one shuffle: deduplication, lag and running sum all keep to (rollout_id, block)
    s = s.repartition("rollout_id", "block")
    w = Window.partitionBy("rollout_id", "block").orderBy("step_index", F.desc("ingested_at"))
    s = s.withColumn("first_row", F.coalesce(F.lag("step_index").over(w) != F.col("step_index"), F.lit(True))).filter("first_row").drop("first_row", "ingested_at")
    w = Window.partitionBy("rollout_id", "block").orderBy("step_index")
    same = F.col("step_index").eqNullSafe(F.lag("step_index").over(w) + 1)
    for c in ("phase", "executed_tool", "call"):
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    s = s.withColumn("changed", F.when(same, 0).otherwise(1))
    s = s.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = s.groupBy("rollout_id", "block", "run").agg(*_merged("step_index", "step_index", F.lit(1)), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("ended_at"), *(F.first(c).alias(c) for c in ("phase", "executed_tool", "call")))
    # runs inside a block are complete; those at an edge of a block meet in the part -1 of their rollout
    edge = (F.pmod("first_step_index", F.lit(block)) == 0) | (F.pmod(F.col("last_step_index") + 1, F.lit(block)) == 0)
    local = local.withColumn("edge", edge).withColumn("part", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("block")))
    w = Window.partitionBy("rollout_id", "part").orderBy("first_step_index")
    same = F.col("edge") & F.col("first_step_index").eqNullSafe(F.lag("last_step_index").over(w) + 1)
    for c in ("phase", "executed_tool", "call"):
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    local = local.withColumn("joined", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.groupBy("rollout_id", "part", "joined").agg(*_merged("first_step_index", "last_step_index", F.col("n_steps")), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *(F.first(c).alias(c) for c in ("phase", "executed_tool")))
    cols = ["rollout_id", "first_step_index", "last_step_index", "n_steps", "phase", "executed_tool", "started_at", "ended_at"]
    return runs.select(cols).withColumn("duration_s", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def _merged(first: str, last: str, n) -> list:
    return [F.min(first).alias("first_step_index"), F.max(last).alias("last_step_index"), F.sum(n).alias("n_steps")]
