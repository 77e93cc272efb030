"""Reports of a scan or run as JSON, YAML and Markdown: files for people, made of a scan's sections item by item.

Fixed values: headings, labels and sentences of the reports.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import TYPE_CHECKING, Any

from marlstone.functions import fixed
from marlstone.operators import graph
from marlstone.plans import sections
from marlstone.plans.sections import Section

if TYPE_CHECKING:
    from marlstone.plans.scan import Scan


def yaml(data: Any, depth: int = 0) -> str:
    """Nested dicts and lists as plain YAML without quotes; a list's nested items follow a lone ``-``."""
    pad = "  " * depth
    if not isinstance(data, dict | list):
        return f"{pad}{data}"
    out = []
    for key, value in data.items() if isinstance(data, dict) else ((None, v) for v in data):
        head = "-" if isinstance(data, list) else f"{key}:"
        out.append(f"{pad}{head}\n{yaml(value, depth + 1)}" if isinstance(value, dict | list) else f"{pad}{head} {value}")
    return "\n".join(out)


def yaml_lines(data: dict[str, Any], depth: int = 0) -> Iterator[str]:
    """The same for nested dicts whose leaves are sections, one item at a time."""
    for name, value in data.items():
        yield f"{'  ' * depth}{name}:"
        if isinstance(value, dict):
            yield from yaml_lines(value, depth + 1)
        else:
            yield from (yaml([x] if key is None else {key: x}, depth + 1) for key, x in value)
            if not value.rows:
                yield ""


def json_pieces(data: dict[str, Any] | Section, depth: int = 0) -> Iterator[str]:
    """JSON, indented by two, of nested dicts whose leaves are sections, one item at a time."""
    inner, count = "\n" + "  " * (depth + 1), 0
    named = isinstance(data, dict) or data.key is not None
    for key, value in data.items() if isinstance(data, dict) else data:
        yield ("," if count else "{" if named else "[") + inner + (f"{json.dumps(key, ensure_ascii=False)}: " if named else "")
        if isinstance(data, dict):
            yield from json_pieces(value, depth + 1)
        else:
            yield json.dumps(value, ensure_ascii=False, indent=2).replace("\n", inner)
        count += 1
    yield ("\n" + "  " * depth if count else "{" if named else "[") + ("}" if named else "]")


def bullets(items: Iterable[str], none: str) -> Iterator[str]:
    empty = True
    for x in items:
        empty = False
        yield f"- {x}"
    if empty:
        yield f"- {none}"


def nested(found: dict[str, Section]) -> dict[str, Any]:
    """The analysis as nested sections, in the order in which it is shown."""
    return {
        "files": found["files"],
        "symbols": found["symbols"],
        "repo_map": {n: found[n] for n in ("directories", "entrypoints", "tests")},
        "attention": found["attention"],
        "dependency_graph": found["dependency_graph"],
        "dependency_order": found["dependency_order"],
    }


def machine_report(found: dict[str, Section], root: str) -> Iterator[str]:
    """Lines of the report; the graph is read for a diagram only where one is drawn."""
    near = found["dependency_graph"]
    pairs = [(a, b) for a, bs in near for b in bs] if near.rows <= fixed.DIAGRAM_NODES else []
    yield from ("# Project Machine Analysis Report", "", f"**Root Directory:** `{Path(root).resolve()}`", f"**Total Files Discovered:** {found['files'].rows}", "")
    yield from ("## Dependency Graph Map", "", graph.diagram(range(near.rows), pairs), "", "## Repo Map Summary", "", "### Directories", "")
    yield from (f"- `{d}`: {i['files']} files (languages: {', '.join(i['languages']) or 'none'})" for d, i in found["directories"])
    yield from ("", "### Entrypoints", "", *bullets(found["entrypoints"].items(), "(none detected)"), "", "### Tests", "")
    yield from bullets((f"`{t}`" for t in found["tests"].items()), "(none)")
    yield from ("", "## Attention Points", "")
    yield from bullets(found["attention"].items(), "No critical risks or attention points detected.")
    yield from ("", "## File Inventory", "", "| Path | Kind | Language | Size (Bytes) | Hash | Status |", "| :--- | :--- | :--- | :--- | :--- | :--- |")
    yield from (f"| `{f['path']}` | {f['kind']} | {f['language']} | {f['size']} | `{f['hash'][:10]}` | {f['status']} |" for f in found["files"].items())


def coverage_section(total: int, documented: int, missing: Iterable[str], extra: list[str], weak: list[str], fallback: list[str], lacking: int | None = None) -> Iterator[str]:
    """Lines of the coverage; ``lacking`` is the number of missing ones where these are no list."""
    percent = 100.0 if not total else documented / total * 100
    counts = {"Source files discovered": total, "Source files with matching docs": documented, "Source files missing matching docs": len(missing) if lacking is None else lacking, "Extra docs without matching source": len(extra), "Weak or failed docs": len(weak), "Fallback docs generated": len(fallback), "Coverage": f"{percent:.1f}%"}
    yield from ("## Source Coverage", "", *(f"- {k}: {v}" for k, v in counts.items()), "")
    for title, items in (("Fallback Generated Source Docs", fallback), ("Missing Source Docs", missing), ("Extra Docs Without Matching Source", extra), ("Weak Or Failed Docs", weak)):
        yield from (f"### {title}", "")
        yield from bullets((f"`{x}`" for x in items), "(none)")
        yield ""


def analysis_lines(root: str, head: dict[str, str], summary: str, coverage: Iterable[str], history: Iterable[str]) -> Iterator[str]:
    yield from (f"# Project Analysis Report: {Path(root).name}", "", *(f"**{k}:** {v}  " for k, v in ({"Root Directory": f"`{root}`"} | head).items()), "", "## Executive Summary", "", summary, "")
    yield from coverage
    yield from ("## Step History", "", "| Step | Kind | Status | Summary |", "| :--- | :--- | :--- | :--- |")
    yield from history
    yield ""


def analysis_report(root: str, head: dict[str, str], summary: str, coverage: Iterable[str], history: Iterable[str]) -> str:
    """The report of a scan or of a controller's run; ``history`` has lines of a table."""
    return "\n".join(analysis_lines(root, head, summary, coverage, history))


NO_MODEL = {"Backend": "none (machine scan only)", "Runtime": "controller", "Status": "finished", "Steps Used": "0", "Approx Tokens": "0", "Worker Budget": "0 tokens, 0 LLM calls", "Synthesis RLM Budget": "0 tokens, 0 LLM calls", "Global Budget": "0 tokens, 0 LLM calls"}


def index(name: str, found: dict[str, Section]) -> Iterator[str]:
    yield from (f"# Directory: {name}", "", f"Welcome to the static analysis index for `{name}`.", "", "## Project Summary", f"- **Total Source Files:** {found['files'].rows}", "- **Status:** Static Scan Complete", "")
    yield from ("## Stale or Newly Added Files (Need Explanation)", "These files are either new or modified, and their corresponding documentation (if any) may be stale.")
    if not found["explanations"].rows:
        yield "- No modified or added files detected. All files are unchanged."
    yield from (f"- [ ] `{x['path']}`" + (f" ({x['reason']})" if x["reason"] else "") for x in found["explanations"].items())
    yield from ("", "## High Priority Files to Inspect (Attention Points)", "These files have warnings or high complexity:")
    yield from bullets(found["attention"].items(), "No critical attention points.")
    yield from ("", "## Directory Structure Overview", "Refer to [machine_report.md](./machine_report.md) for the full inventory.", "")


def write_reports(scan: Scan, root: str, out: Path) -> dict[str, Any]:
    """The sections' folder, and of it machine_analysis.json and .yaml, machine_report.md, analysis_report.md and index.md.

    These five are single files for people: the driver copies them from the sections a line at a time and holds no list of rows. Gives
    back the manifest.
    """
    made = sections.write(scan, out)
    found, total = sections.read(out)
    full = str(Path(root).resolve())
    lacking = found["missing_docs"]
    coverage = coverage_section(total, total - lacking.rows, lacking.items(), [], [], [], lacking.rows)
    summary = "This report summarizes the static machine scan of the project. No LLM resources were utilized."
    done = ["| 1 | machine_scan | OK | Static machine scan completed successfully. |"]
    lines = {
        "machine_analysis.yaml": yaml_lines(nested(found)),
        "machine_report.md": machine_report(found, root),
        "analysis_report.md": analysis_lines(full, NO_MODEL, summary, coverage, done),
        "index.md": index(Path(full).name, found),
    }
    with open(out / "machine_analysis.json", "w", encoding="utf-8", newline="\n") as to:
        to.writelines(json_pieces(nested(found)))
    for name, some in lines.items():
        with open(out / name, "w", encoding="utf-8", newline="\n") as to:
            to.writelines(x if i == 0 else f"\n{x}" for i, x in enumerate(some))
    return made


def result_json(status: str, result: Any, steps: list[dict], error: str | None, budget: dict) -> str:
    """A run's result; values that JSON lacks are shown as text."""
    return json.dumps({"status": status, "result": result, "steps": steps, "error": error, "budget": budget}, ensure_ascii=False, indent=2, default=repr)
