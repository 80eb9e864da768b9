"""Read a query's physical plan (the text ``DataFrame.explain`` prints) and summarise it."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Operators that must never appear in a registered query's plan.
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "FlatMapGroupsInPandas",
    "MapInPandas",
    "PythonUDF",
)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@dataclass
class PlanSummary:
    shuffles: int = 0
    single_partition: int = 0
    range_partition: int = 0
    broadcasts: int = 0
    joins: list[str] = field(default_factory=list)
    aggregates: dict[str, int] = field(default_factory=dict)
    subqueries: int = 0
    windows: int = 0
    scans: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)


_NODE = re.compile(r"^\((\d+)\) (.+?)\s*$")


def summarize(text: str) -> PlanSummary:
    s = PlanSummary()
    lines = text.splitlines()
    seen: set[str] = set()
    for i, line in enumerate(lines):
        m = _NODE.match(line)
        if not m or m.group(1) in seen:
            continue
        seen.add(m.group(1))
        node = m.group(2)
        args = ""
        for nxt in lines[i + 1 : i + 12]:
            if nxt.startswith("Arguments:") or nxt.startswith("Join type:") or nxt.startswith("ReadSchema:"):
                args += nxt + "\n"
            if not nxt.strip():
                break
        if node.startswith("Exchange"):
            if "SinglePartition" in args:
                s.single_partition += 1
            elif "rangepartitioning" in args:
                s.range_partition += 1
            else:
                s.shuffles += 1
        elif node.startswith("BroadcastExchange"):
            s.broadcasts += 1
        elif "Join" in node:
            jt = re.search(r"Join type: (\w+)", args)
            s.joins.append(f"{node.split()[0]}:{jt.group(1) if jt else '?'}")
        elif node.endswith("Aggregate"):
            s.aggregates[node] = s.aggregates.get(node, 0) + 1
        elif node.startswith("Window"):
            s.windows += 1
        elif node.startswith("Scan"):
            rs = re.search(r"ReadSchema: struct<(.*)>", args)
            s.scans.append(str(len(re.findall(r"(\w+):", rs.group(1)))) if rs else "0")
    s.subqueries = len(re.findall(r"^Subquery:\d+", text, flags=re.M))
    s.forbidden = [f for f in FORBIDDEN if f in text]
    return s
