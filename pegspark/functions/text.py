"""Reports and trees as text."""

from __future__ import annotations

import json


def failure(report: dict, data: bytes | None = None) -> str:
    """Where and why a match failed, with the line of the input and a mark under the place."""
    lines = [f"match failed at byte {report['offset']} (line {report['line']}, column {report['column']}):"]
    expected = report["expected"]
    if len(expected) > 3:
        expected = [*expected[:-1], f"or {expected[-1]}"]
    if expected:
        lines.append(f"  expected: {', '.join(expected)}")
    lines.append(f"  found: {report['found']}")
    if report["rule_stack"]:
        lines.append(f"  in: {' > '.join(report['rule_stack'])}")
    if data:
        begin = data.rfind(b"\n", 0, report["offset"]) + 1
        line = data[begin:].split(b"\n", 1)[0].decode("utf-8", "replace")
        before = len(data[begin : report["offset"]].decode("utf-8", "replace"))
        lines += ["", f"  {line}", f"  {' ' * before}^"]
    return "\n".join(lines)


def tree(nodes: list[dict]) -> str:
    """A tree in pre-order, one node a line; long texts are cut."""
    last = {}
    for node in nodes:
        last[node["parent"]] = node["id"]
    lines, stems = [], {-1: ""}
    for node in nodes:
        own, parent = node["id"], node["parent"]
        shown = node["text"] if len(node["text"]) <= 40 else node["text"][:37] + "..."
        name = f"{node['rule']} [{node['start']}..{node['end']}]" + (f" {json.dumps(shown, ensure_ascii=False)}" if shown else "")
        ends = last[parent] == own
        lines.append(name if parent < 0 else stems[parent] + ("└── " if ends else "├── ") + name)
        stems[own] = "" if parent < 0 else stems[parent] + ("    " if ends else "│   ")
    return "\n".join(lines)
