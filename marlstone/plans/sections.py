"""The data of a scan as ordered JSON lines, written by executors: a folder for each section and a manifest.

A range exchange sorts each section, so its part files, read by name, are in order. Reports read them line by line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators import graph

if TYPE_CHECKING:
    from marlstone.plans.scan import Scan

#: Folder of the sections below a report's folder.
FOLDER = "machine_analysis"


def frames(scan: Scan) -> dict[str, tuple[DataFrame, list[Column]]]:
    """Rows of each section and their order, which is that of the scan."""
    place = scan.files.select("repo_id", "path", "file_ord")
    first = scan.files.groupBy("repo_id", paths.directory(F.col("path")).alias("directory")).agg(F.min("file_ord").alias("at"))
    col = F.col
    return {
        "files": (scan.files.select("path", "hash", "mtime", "size", "language", "kind", "last_seen_commit", "status", "todo_count", "repo_id", "file_ord"), [col("repo_id"), col("file_ord")]),
        "symbols": (scan.symbols.join(place, ["repo_id", "path"]).select("path", "symbols", "imports", "exports", "repo_id", "file_ord"), [col("repo_id"), col("file_ord")]),
        "directories": (scan.directories.join(first, ["repo_id", "directory"]), [col("repo_id"), col("at")]),
        "entrypoints": (scan.entrypoints, [col("repo_id"), col("file_ord"), col("ord")]),
        "tests": (scan.tests, [col("repo_id"), col("path")]),
        "attention": (scan.attention, [col("repo_id"), col("rule_ord"), col("file_ord"), col("path")]),
        "dependency_graph": (graph.adjacency(scan.edges, graph.graph_nodes(scan.files)).join(place, ["repo_id", "path"]), [col("repo_id"), col("file_ord")]),
        "dependency_order": (scan.order, [col("repo_id"), col("pos")]),
        "explanations": (scan.explain, [col("repo_id"), col("pos").asc_nulls_last(), col("path")]),
        "missing_docs": (scan.doc_states.filter("doc_state = 'missing'").select("repo_id", "path"), [col("repo_id"), col("path")]),
    }


#: Columns that are written; the others only order rows.
SHOWN = {
    "files": ["path", "hash", "mtime", "size", "language", "kind", "last_seen_commit", "status", "todo_count"],
    "symbols": ["path", "symbols", "imports", "exports"],
    "directories": ["directory", "files", "languages"],
    "entrypoints": ["entrypoint"],
    "tests": ["path"],
    "attention": ["message"],
    "dependency_graph": ["path", "neighbours"],
    "dependency_order": ["path"],
    "explanations": ["path", "reason"],
    "missing_docs": ["path"],
}


def write(scan: Scan, out: Path) -> dict[str, Any]:
    """Write every section below ``out``/machine_analysis, then manifest.json with each one's rows and part files, which it returns.

    The manifest is written last, so that a reader who finds it finds whole sections.
    """
    folder = out / FOLDER
    (folder / "manifest.json").unlink(missing_ok=True)
    made: dict[str, Any] = {"sections": {}}
    for name, (rows, order) in frames(scan).items():
        seen = Observation(f"rows of {name}")
        lines = rows.orderBy(*order).select(*SHOWN[name]).observe(seen, F.count("*").alias("rows"))
        lines.write.mode("overwrite").option("ignoreNullFields", "false").json(f"file://{(folder / name).resolve()}")
        made["sections"][name] = {"rows": seen.get["rows"], "parts": sorted(p.name for p in (folder / name).glob("part-*"))}
    made["targets"] = scan.doc_states.count()
    (folder / "manifest.json").write_text(json.dumps(made, indent=2), encoding="utf-8")
    return made


@dataclass
class Section:
    """A section that was written: ``rows`` in number, and its items, one at a time and as often as asked.

    ``key``: the field whose value names the item in a mapping; ``item`` turns a row into what is shown.
    """

    folder: Path
    rows: int
    parts: list[str]
    item: Callable[[dict], Any] = dict
    key: str | None = None

    def __iter__(self) -> Iterator[tuple[str | None, Any]]:
        for part in self.parts:
            with open(self.folder / part, encoding="utf-8", newline="\n") as lines:
                for line in lines:
                    row = json.loads(line)
                    yield row[self.key] if self.key else None, self.item(row)

    def items(self) -> Iterator[Any]:
        return (x for _, x in self)


def read(out: Path) -> tuple[dict[str, Section], int]:
    """The sections of a written scan by name, and the number of coverage targets."""
    folder = out / FOLDER
    made = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
    one = lambda field: lambda row: row[field]
    shown: dict[str, tuple[Callable[[dict], Any], str | None]] = {
        "directories": (lambda r: {"files": r["files"], "languages": r["languages"]}, "directory"),
        "dependency_graph": (one("neighbours"), "path"),
        "entrypoints": (one("entrypoint"), None),
        "attention": (one("message"), None),
        **{n: (one("path"), None) for n in ("tests", "dependency_order", "missing_docs")},
    }
    return {n: Section(folder / n, s["rows"], s["parts"], *shown.get(n, (dict, None))) for n, s in made["sections"].items()}, made["targets"]
