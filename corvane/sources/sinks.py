"""Sinks: JSON documents, small markdown tables and memos, Parquet tables (objects.py keeps versioned objects)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, path: str) -> None:
    """One JSON object a line, by Spark's commit protocol."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def table(rows: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "append") -> None:
    w = rows.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def markdown_table(rows: DataFrame, limit: int = 100) -> str:
    """A report's small table; at most limit rows reach the driver."""
    got = rows.limit(limit).collect()
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in got)


def memo(title: str, sections: Mapping[str, Sequence[str] | str]) -> str:
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", "", *([body] if isinstance(body, str) else [f"- {x}" for x in body] or ["_None._"]), ""]
    return "\n".join(out)


def report(summary: Mapping[str, object]) -> str:
    return json.dumps(summary, indent=2, sort_keys=True, default=str)
