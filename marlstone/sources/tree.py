"""Directory trees as tables: a listing made by executors in rounds, contents of the files that are wanted, and a data source.

Roots must be mounted on all executors. The driver lists no more than some dozens of directories for the data source, and none
for :func:`listing`.
"""

from __future__ import annotations

import contextlib
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from marlstone.functions import fixed
from marlstone.plans.scratch import cut, free

FILES = "repo_id string, path string, size long, mtime long, mtime_exact double, content binary"
#: A listing: a file with its size, or a directory that the round left for the next (size null). ``dir`` is "" for the root.
ENTRIES = "repo_id string, root string, dir string, path string, size long, mtime_exact double"
#: Directories that one task lists in a round before it leaves the rest of its queue to others.
DIRS_EACH = 500
#: Rows of a batch of a listing.
ROWS_EACH = 10_000
#: Tasks of a round, and bytes of contents that one task and one batch should hold.
MOST_TASKS, TASK_BYTES, BATCH_BYTES = 20_000, 128 << 20, 16 << 20


def entered(name: str) -> bool:
    """Whether a directory of this name is listed."""
    return name not in fixed.IGNORED_NAMES and not name.endswith(".egg-info")


def entries(root: str, folder: str) -> Iterator[tuple[str, int | None, float | None]]:
    """path, size, mtime of a directory's files, and of the directories to enter, these without size and mtime.

    Links, and directories that can't be read, are left out. A name that isn't valid UTF-8 gets replacement characters; such a
    file can't be opened by its path and has no content.
    """
    with contextlib.suppress(OSError), os.scandir(os.path.join(root, folder)) as found:
        for e in found:
            name = os.fsencode(e.name).decode("utf-8", "replace")
            path = f"{folder}/{name}" if folder else name
            with contextlib.suppress(OSError):
                if e.is_dir(follow_symlinks=False):
                    if entered(name):
                        yield path, None, None
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    yield path, stat.st_size, stat.st_mtime


def contents(root: str, path: str) -> bytes | None:
    """A file's bytes; None for binary files and those that can't be read."""
    if os.path.splitext(path)[1].lower() in fixed.BINARY_SUFFIXES:
        return None
    try:
        return Path(root, path).read_bytes()
    except OSError:
        return None


def _lister(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists directories breadth first, ``most`` in a task; those not listed come out as rows without a path."""
    schema = pa.schema([("repo_id", pa.string()), ("root", pa.string()), ("dir", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_exact", pa.float64())])
    batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows = 0, []
        for batch in batches:
            queue = deque(tuple(r.values()) for r in batch.to_pylist())
            while queue and done < most:
                repo, root, folder = queue.popleft()
                done += 1
                for path, size, mtime in entries(root, folder):
                    if size is not None:
                        rows.append((repo, root, folder, path, size, mtime))
                    elif len(queue) < most:
                        queue.append((repo, root, path))
                    else:
                        rows.append((repo, root, path, None, None, None))
                    if len(rows) >= ROWS_EACH:
                        yield batch_of(rows)
                        rows = []
            rows += [(*q, None, None, None) for q in queue]
        yield batch_of(rows)

    return run


def listing(spark: SparkSession, *roots: str, dirs_each: int = DIRS_EACH) -> DataFrame:
    """repo_id, root, path, size, mtime_exact of every regular file below the roots, hidden ones too, as a written table.

    A round lists the directories that the last one left, spread over tasks, and each task goes down by itself until it has
    listed ``dirs_each``; the rounds end when none are left. The same root given twice is listed twice.
    """
    todo = spark.createDataFrame([(Path(r).resolve().name, str(Path(r).resolve()), "") for r in roots], "repo_id string, root string, dir string")
    rounds, waiting = [], len(roots)
    while waiting:
        spread = todo.repartition(min(waiting, MOST_TASKS))
        rounds.append(cut(spread.mapInArrow(_lister(dirs_each), ENTRIES), "tree"))
        todo = rounds[-1].filter("path is null").select("repo_id", "root", "dir")
        waiting = todo.count()
    found = spark.createDataFrame([], ENTRIES)
    for r in rounds:
        found = found.unionByName(r)
    out = cut(found.filter("path is not null").drop("dir"), "tree")
    free(*rounds)
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds contents where ``wanted``; a batch ends once its contents reach BATCH_BYTES."""
    names = ["repo_id", "path", "size", "mtime", "mtime_exact", "content"]
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        roots, paths, wanted = (columns[n].to_pylist() for n in ("root", "path", "wanted"))
        first, held, got = 0, 0, []
        for i, path in enumerate(paths):
            got.append(contents(roots[i], path) if wanted[i] else None)
            held += len(got[-1] or b"")
            if held >= BATCH_BYTES or i + 1 == len(paths):
                kept = [columns[n].slice(first, len(got)) for n in names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.binary())], names=names)
                first, held, got = i + 1, 0, []


def read_tree(spark: SparkSession, *roots: str, content: bool | Column = True) -> DataFrame:
    """repo_id, path, size, mtime (whole seconds), mtime_exact, content (null for binary files and those that can't be read).

    ``content`` may be a condition on repo_id, path, size and mtime_exact: other files are listed but never opened.
    """
    wanted = F.coalesce(content if isinstance(content, Column) else F.lit(content), F.lit(False))
    rows = listing(spark, *roots).withColumn("wanted", wanted)
    size = rows.agg(F.count("*").alias("files"), F.sum(F.when(F.col("wanted"), F.col("size"))).alias("bytes")).first()
    tasks = max(1, min(MOST_TASKS, size["files"] // 20_000 + (size["bytes"] or 0) // TASK_BYTES + 1))
    dealt = rows.withColumn("mtime", F.col("mtime_exact").cast("long")).repartition(max(tasks, min(spark.sparkContext.defaultParallelism, size["files"] // 100)), "root", "path")
    return dealt.mapInArrow(_reader, FILES)


class Part(InputPartition):
    """A directory, with all below it or its own files alone."""

    def __init__(self, repo: str, root: str, folder: str, deep: bool) -> None:
        self.repo, self.root, self.folder, self.deep = repo, root, folder, deep


#: Filters that the source tests before it opens a file.
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


class TreeReader(DataSourceReader):
    """Partitions are directories: the driver goes down until it has ``splits`` of them, executors list and read the rest."""

    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [r for r in options["path"].split(os.pathsep) if r]
        self.splits = int(options.get("splits", "64"))
        self.with_content = options.get("content", "true").lower() == "true"
        self.pushed: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column not in ("repo_id", "path", "size", "mtime", "mtime_exact") or type(f) not in (*TESTS, IsNotNull):
                yield f
            elif type(f) in TESTS:
                self.pushed.append((type(f), column, f.value))

    def partitions(self) -> list[Part]:
        queue = deque((r, "") for r in self.roots)
        out = []
        while queue and len(queue) + len(out) < self.splits:
            root, folder = queue.popleft()
            out.append(Part(Path(root).resolve().name, root, folder, False))
            queue.extend((root, p) for p, size, _ in entries(root, folder) if size is None)
        return out + [Part(Path(r).resolve().name, r, f, True) for r, f in queue]

    def read(self, part: Part) -> Iterator[tuple]:
        queue = deque([part.folder])
        while queue:
            for path, size, mtime in entries(part.root, queue.popleft()):
                if size is None:
                    if part.deep:
                        queue.append(path)
                    continue
                row = {"repo_id": part.repo, "path": path, "size": size, "mtime": int(mtime), "mtime_exact": mtime}
                if all(TESTS[kind](row[column], value) for kind, column, value in self.pushed):
                    yield *row.values(), contents(part.root, path) if self.with_content else None


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").load(root)``: every file of a tree, or of several joined by the path separator.

    Filters on every column but content are tested before a file is opened. Options: content (true), splits (64).
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``repo_files`` known to the session, and let it push filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoFiles)
