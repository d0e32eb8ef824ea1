"""Structured tool calls: canonical JSON and validation against the parameter table, through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.dims import PARAMETERS, PHASE_TOOLS, TOOLS
from stepmill.functions.text import first_object, guess_action, normal_name, tool_of


def canonical_json(c: Column) -> Column:
    """Compact JSON with keys sorted at every level; NULL for text that is no JSON."""
    return F.to_json(F.try_parse_json(c))


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def parse_call(response: Column) -> Column:
    """struct(tool, arguments, original_action, repaired_action, invalid_action, repair_applied) of a model response.

    The first JSON object counts. A tool known only by an alias is repaired and flagged invalid; an unknown one is invalid.
    """
    j = F.try_parse_json(first_object(response))
    name = F.try_variant_get(j, "$.tool", "string")
    args = F.coalesce(F.to_json(F.try_variant_get(j, "$.arguments", "variant")), F.lit("{}"))
    tool, plain = tool_of(name), normal_name(name)
    repaired = F.coalesce(tool != plain, F.lit(False))
    return F.struct(F.coalesce(tool, plain).alias("tool"), args.alias("arguments"), F.coalesce(name, guess_action(response)).alias("original_action"), F.when(repaired, tool).alias("repaired_action"), (repaired | ~F.coalesce(tool.isin(*TOOLS), F.lit(False))).alias("invalid_action"), repaired.alias("repair_applied"))


def call_status(tool: Column, arguments: Column, bounds: bool = True) -> Column:
    """Why a call is not valid, NULL if it is: unknown_tool, invalid_json, missing_argument, unexpected_argument, wrong_type, out_of_bounds.

    An integer is a JSON number without fraction, never a boolean.
    """
    v = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = None
    for t in TOOLS:
        params = [p for p in PARAMETERS if p[0] == t]
        required = [p[1] for p in params if p[5]]
        missing = F.lit(False)
        for name in required:
            missing |= ~F.array_contains(keys, name)
        unexpected = F.size(F.array_except(keys, F.array(*(F.lit(p[1]) for p in params)))) > 0
        wrong, outside = F.lit(False), F.lit(False)
        for _, name, kind, low, high, _ in params:
            given = F.array_contains(keys, name)
            s = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))
            wrong |= given & ~s.isin(*(("STRING",) if kind == "string" else ("BIGINT",)))
            if kind == "integer":
                n = F.when(s == "BIGINT", F.try_variant_get(v, f"$.{name}", "bigint"))
                outside |= F.coalesce(n < low, F.lit(False)) | (F.coalesce(n > high, F.lit(False)) if high else F.lit(False))
        status = F.when(missing, "missing_argument").when(unexpected, "unexpected_argument").when(wrong, "wrong_type")
        status = status.when(outside, "out_of_bounds") if bounds else status
        out = F.when(tool == t, status) if out is None else out.when(tool == t, status)
    return F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), "unknown_tool").when(v.isNull() | keys.isNull(), "invalid_json").otherwise(out)


def phase_allows(phase: Column, tool: Column) -> Column:
    allowed = F.create_map(*[x for p, ts in PHASE_TOOLS.items() for x in (F.lit(p), F.array(*(F.lit(t) for t in ts)))])
    return F.coalesce(F.array_contains(allowed[phase], tool), F.lit(False))


def target_status(phase: Column, tool: Column, arguments: Column) -> Column:
    """Status of a training target: as call_status without bounds, then unsupported_phase and phase_tool_mismatch."""
    return F.coalesce(call_status(tool, arguments, bounds=False), F.when(~F.coalesce(phase.isin(*PHASE_TOOLS), F.lit(False)), "unsupported_phase").when(~phase_allows(phase, tool), "phase_tool_mismatch"))


def key_set_status(df: DataFrame, json_column: str, expected: list[str]) -> DataFrame:
    """Adds missing_keys and unexpected_keys (sorted arrays) of a JSON text against an exact field list; both NULL if it is no object."""
    keys, want = F.json_object_keys(json_column), F.array(*(F.lit(k) for k in expected))
    return df.withColumn("missing_keys", F.array_sort(F.array_except(want, keys))).withColumn("unexpected_keys", F.array_sort(F.array_except(keys, want)))
