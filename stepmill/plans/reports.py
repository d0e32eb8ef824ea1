"""Markdown of small result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.2f}%"


def points(a: float, b: float) -> str:
    return f"{100 * (b - a):+.2f} pp"


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table: headers and the rows in the frame's order. Pipes and line ends in cells are escaped; more than `limit` rows raise an error."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table holds at most {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def report(title: str, header: Mapping[str, object], tables: Sequence[tuple[str, DataFrame]]) -> str:
    parts = [f"# {title}", "", *(f"- {k}: {v}" for k, v in header.items()), ""]
    for name, df in tables:
        parts += [f"## {name}", "", markdown_table(df)]
    return "\n".join(parts)
