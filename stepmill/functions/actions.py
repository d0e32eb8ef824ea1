"""Model responses in other forms than one JSON object, history items and test ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepmill.functions.calls import is_object, parse_call
from stepmill.functions.dims import PARAMETERS, TOOLS
from stepmill.functions.text import strip, tool_of

LEGACY = ("read_file", "write_file", "run_test")


def strict_object(text: Column) -> Column:
    """The object that the whole text, or the body of its one code fence, is; NULL for anything else, text around it included."""
    t = F.regexp_replace(strip(text), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    # the parser takes an object with text after it, so the last brace has to close the text
    return F.when(t.rlike(r"(?s)^\{.*\}$") & is_object(t) & F.from_json(t, "map<string,string>").isNotNull(), t)


def any_object(text: Column) -> Column:
    """The first object that parses, starting at any brace."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == "{")
    found = F.filter(F.transform(starts, lambda i: F.substr(text, i)), lambda s: is_object(s))
    return F.to_json(F.try_parse_json(F.get(found, F.lit(0))))


def parse_react(response: Column) -> Column:
    """struct(tool, arguments, legacy) of `Action: tool(arguments)` after a Thought; the three legacy tools are never repaired.

    Without both labels the response is read as one JSON call.
    """
    legacy = response.rlike(r"(?i)Thought\s*:") & response.rlike(r"(?i)Action\s*:")
    name = F.lower(F.regexp_extract(response, r"(?i)Action\s*:\s*([A-Za-z_]\w*)", 1))
    args = F.regexp_extract(response, r"(?is)Action\s*:\s*[A-Za-z_]\w*\s*[(:]?\s*(?:Action Input\s*:)?\s*(\{.*\})", 1)
    call = parse_call(response)
    return F.when(legacy, F.struct(name.alias("tool"), F.coalesce(F.nullif(args, F.lit("")), F.lit("{}")).alias("arguments"), (~name.isin(*LEGACY)).alias("invalid_action"), F.lit(True).alias("legacy"))).otherwise(F.struct(call["tool"].alias("tool"), call["arguments"].alias("arguments"), call["invalid_action"].alias("invalid_action"), F.lit(False).alias("legacy")))


def history_item(phase: Column, previous: Column, tool: Column, executed: Column, arguments: Column, success: Column, proposed: Column, reason: Column, observation: Column) -> Column:
    """A step as history: absent parts fall back or are left out (NULL in the struct, absent in its JSON)."""
    name = F.coalesce(F.nullif(tool, F.lit("")), F.nullif(executed, F.lit("")))
    return F.struct(F.coalesce(F.nullif(phase, F.lit("")), F.lit("UNKNOWN")).alias("phase"), previous.alias("previous_phase"), name.alias("tool"), F.coalesce(arguments, F.lit("{}")).alias("arguments"), success.alias("tool_success"), F.when(proposed != name, proposed).alias("model_proposed_tool"), F.nullif(reason, F.lit("")).alias("intervention_reason"), F.coalesce(observation, F.lit("")).alias("observation"))


def test_ids(value: Column) -> Column:
    """Test ids out of a JSON list in a string; other text is one id, NULL and blanks none."""
    ids = F.coalesce(F.from_json(value, "array<string>"), F.array(value))
    return F.coalesce(F.filter(F.when(strip(value).startswith("{"), F.array().cast("array<string>")).otherwise(ids), lambda x: strip(x) != ""), F.array().cast("array<string>"))


def is_model_step(executed: Column, proposed: Column, action: Column, reason: Column) -> Column:
    """Steps that the model proposed: not a forced final test, and with a proposed tool or an invalid( action."""
    return F.coalesce(reason != "final_verification", F.lit(True)) & (proposed.isNotNull() | F.coalesce(action.startswith("invalid("), F.lit(False)))


def test_reached_process(executed: Column, observation: Column) -> Column:
    o = F.lower(F.coalesce(observation, F.lit("")))
    return F.coalesce(executed == "run_test", F.lit(False)) & ~o.rlike("^(blocked|refused|invalid arguments)")


def known_tool(c: Column) -> Column:
    return F.coalesce(tool_of(c).isin(*TOOLS), F.lit(False))


def tool_schemas() -> str:
    """The parameter table as JSON, indented."""
    import json

    return json.dumps([{"name": t, "parameters": {p[1]: {"type": p[2], **({"minimum": p[3]} if p[3] is not None else {}), **({"maximum": p[4]} if p[4] is not None else {})} for p in PARAMETERS if p[0] == t}, "required": [p[1] for p in PARAMETERS if p[0] == t and p[5]]} for t in TOOLS], indent=2)
