"""A sink of files: each row of a frame becomes one file, written by the executors.

    sink.register(spark)
    rows.write.format("marlstone_files").option("root", where).mode("append").save()

Rows have ``path`` (relative, with ``/``) and ``content`` (string or binary; null: an empty file).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "marlstone_files"
#: Folder below the root in which tasks write; it goes when the job ends.
STAGING = "_marlstone_staging"


def located(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a root: a URI (file, s3, gs, hdfs) or an absolute path."""
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/")


def checked(path: str | None) -> str:
    """The path, if it lies below the root."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING:
        raise ValueError(f"not a path below the root: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its staging folder and the number of its files."""

    folder: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    """Tasks write whole files into folders of their own, one for each attempt; nothing is seen below the root until the job commits.

    The commit moves the files, folder by folder, each in one step: a reader sees a file whole or not at all. A task that fails, is
    lost or runs twice leaves a folder that no message names; commit and abort delete it with the staging folder.
    """

    def __init__(self, root: str, job: str, overwrite: bool) -> None:
        self.root, self.job, self.overwrite = root, job, overwrite

    @property
    def staging(self) -> str:
        return f"{located(self.root)[1]}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _ = located(self.root)
        task = TaskContext.get()
        folder, n = f"{self.staging}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}", 0
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                target = f"{folder}/{checked(path)}"
                system.create_dir(posixpath.dirname(target), recursive=True)
                value = content.as_py()
                with system.open_output_stream(target) as out:
                    out.write(value.encode() if isinstance(value, str) else value or b"")
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.root)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name != STAGING:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for message in messages:
            if message is None or not message.files:
                continue
            for info in system.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                if info.type == fs.FileType.File:
                    target = root + info.path[len(message.folder) :]
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    system.move(info.path, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.root)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)
        above = f"{root}/{STAGING}"
        if system.get_file_info(above).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class FilesSink(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        import uuid

        if {"path", "content"} - set(schema.fieldNames()):
            raise ValueError("rows of files have the columns path and content")
        if not self.options.get("root"):
            raise ValueError("the option root names the folder to write below")
        return FilesWriter(self.options["root"], uuid.uuid4().hex, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
