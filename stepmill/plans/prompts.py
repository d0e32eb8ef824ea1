"""Prompt assembly as expressions: ordered sections, chat messages, a chat template."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text around issue and transcript.
ORACLE = """You are a coding agent. Use one structured tool call to make the required change.
Issue:
{issue}

Repository navigation transcript:
{transcript}

Return exactly one JSON object with fields tool and arguments."""
SYSTEM = "You repair code in a repository. Answer with one JSON tool call."


def messages(problem: Column, phase: Column, tools: Column, history: Column | None = None, index: Column | None = None, test_command: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>>: system and user message; absent sections leave no gap, allowed tools are distinct and sorted."""
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c))
    none = F.lit(None).cast("string")
    user = F.concat_ws("\n\n", section("Issue", problem), section("Files", index if index is not None else none), section("Phase", phase), section("Tools", F.array_join(F.array_sort(F.array_distinct(tools)), ", ")), section("Test", test_command if test_command is not None else none), section("History", history if history is not None else none))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def chat_prompt(m: Column) -> Column:
    """Messages in a plain chat template, ending where the answer begins."""
    return F.concat(F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("<|im_end|>\n"))), ""), F.lit("<|im_start|>assistant\n"))


@F.pandas_udf(T.StringType())
def oracle_prompt(problem: pd.Series, steps: pd.Series) -> pd.Series:
    """Prompt of a navigation transcript: the trimmed issue and the steps as indented JSON. NULL problem counts as empty, arguments that are no JSON stay text."""

    def arguments(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return text

    def one(issue, items):
        items = [] if items is None else items
        transcript = [{"phase": s["phase"], "action": {"tool": s["tool"], "arguments": arguments(s["arguments"])}, "observation": s["observation"], "tool_success": s["tool_success"]} for s in items]
        return ORACLE.format(issue=(issue or "").strip(), transcript=json.dumps(transcript, ensure_ascii=False, indent=2))

    return pd.Series([one(p, s) for p, s in zip(problem, steps)], dtype=object)
