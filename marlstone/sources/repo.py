"""What goes with a repository's tree: the state of git, ignore files and snapshots."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def ignore_patterns(root: str) -> list[str]:
    """The lines of the root's .gitignore that are patterns; comments and ``!`` lines aren't."""
    file = Path(root, ".gitignore")
    lines = [x.strip() for x in file.read_text(encoding="utf-8").splitlines()] if file.exists() else []
    return [x for x in lines if x and x[0] not in "#!"]


def _git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=600, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def git_commits(spark: SparkSession, root: str) -> DataFrame:
    """repo_id, path, last_seen_commit, from one log of the whole tree."""
    repo, last, commit = Path(root).resolve().name, {}, ""
    for line in _git(root, "log", "--format=%x01%H", "--name-only", "--relative", "-z").replace("\0", "\n").splitlines():
        if line.startswith("\x01"):
            commit = line[1:]
        elif line.strip():
            last.setdefault(line, commit)
    return spark.createDataFrame([(repo, p, c) for p, c in last.items()], "repo_id string, path string, last_seen_commit string")


def git_status(spark: SparkSession, root: str) -> DataFrame:
    """repo_id, path, status: added, deleted or changed for what differs from the last commit, from one call."""
    repo, rows = Path(root).resolve().name, []
    entries = iter(_git(root, "status", "--porcelain", "-z").split("\0"))
    for e in entries:
        if len(e) > 3:
            mark, path = e[:2], e[3:]
            if "R" in mark:
                next(entries, None)
            rows.append((repo, path, "deleted" if "D" in mark else "changed" if "M" in mark else "added"))
    return spark.createDataFrame(rows, "repo_id string, path string, status string")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """Files of an earlier scan; None if there are none or they can't be read."""
    try:
        found = spark.read.parquet(path)
        return found if not found.isEmpty() else None
    except AnalysisException:
        return None
