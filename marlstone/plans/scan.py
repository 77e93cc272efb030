"""The scan of a repository: all frames of an analysis, and its files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import code, fixed, paths, text
from marlstone.operators import coverage, graph, inventory
from marlstone.plans import render
from marlstone.plans.scratch import cut
from marlstone.sources import repo, tree


@dataclass
class Scan:
    """Frames of one scan, each with repo_id."""

    files: DataFrame
    symbols: DataFrame
    directories: DataFrame
    entrypoints: DataFrame
    tests: DataFrame
    attention: DataFrame
    edges: DataFrame
    order: DataFrame
    docs: DataFrame
    doc_states: DataFrame
    explain: DataFrame
    #: How many files were met and how many of them a rule left out; known once the files were read, from that very pass.
    counts: Observation


def imports_of(symbols: DataFrame) -> DataFrame:
    """repo_id, path, import_ord, module, internal."""
    rows = symbols.select("repo_id", "path", F.posexplode("imports").alias("import_ord", "i"))
    return rows.select("repo_id", "path", "import_ord", F.col("i.module").alias("module"), F.col("i.internal").alias("internal"))


def left_out(patterns: list[str]) -> Column:
    """Whether a rule leaves the file out of the scan."""
    return paths.ignored(F.col("path")) | paths.matches_ignore_file(F.col("path"), patterns)


def analyze(files: DataFrame, previous: DataFrame | None = None, git: DataFrame | None = None, commits: DataFrame | None = None, docs: DataFrame | None = None, patterns: list[str] = [], internal: tuple[str, ...] = fixed.INTERNAL_PREFIXES) -> Scan:  # noqa: B006
    """All frames from rows as :func:`tree.read_tree` gives them. Files are read once: what is parsed from them is cut."""
    spark = files.sparkSession
    counts = Observation("scanned files")
    seen = files.observe(counts, F.count("*").alias("total"), F.count_if(left_out(patterns)).alias("ignored"))
    kept = inventory.with_order(inventory.scanned(seen, patterns))
    meta = inventory.change_status(inventory.metadata(kept), previous, git)
    if commits is not None:
        meta = meta.join(commits, ["repo_id", "path"], "left")
    else:
        meta = meta.withColumn("last_seen_commit", F.lit(None).cast("string"))
    meta = cut(meta.withColumn("content", text.decoded("content")), "scan-files")
    found = code.symbols_of(internal)("content", "language", paths.is_binary(F.col("path")))
    symbols = cut(meta.select("repo_id", "path", found.alias("s")).select("repo_id", "path", "s.*"), "scan-symbols")
    docs = spark.createDataFrame([], "repo_id string, path string, mtime double") if docs is None else docs
    edges = cut(graph.edges(imports_of(symbols), meta), "scan-edges")
    order = cut(graph.dependency_order(edges, graph.graph_nodes(meta)), "scan-order")
    states = coverage.doc_state(meta, docs)
    return Scan(meta, symbols, inventory.directories(meta), inventory.entrypoints(meta), inventory.tests(meta), inventory.attention(meta, symbols, previous), edges, order, docs, states, coverage.needs_explanation(meta, states, order), counts)


def existing_docs(spark: SparkSession, repo_id: str, output_dir: str) -> DataFrame:
    """repo_id, path, mtime of the Markdown files below a folder."""
    root = Path(output_dir)
    rows = [(repo_id, p.relative_to(root).as_posix(), p.stat().st_mtime) for p in root.rglob("*.md") if p.is_file()] if root.exists() else []
    return spark.createDataFrame(rows, "repo_id string, path string, mtime double")


def scan(spark: SparkSession, root: str, output_dir: str) -> Scan:
    """Scan a tree, write its reports and a snapshot below ``output_dir``, and compare with the snapshot there is."""
    out, name = Path(output_dir), Path(root).resolve().name
    out.mkdir(parents=True, exist_ok=True)
    where = f"file://{out.resolve()}/snapshot"
    before = repo.snapshot(spark, where)
    before = cut(before, "scan-before") if before is not None else None
    patterns = repo.ignore_patterns(root)
    files = tree.read_tree(spark, root, content=~left_out(patterns))
    got = analyze(files, before, repo.git_status(spark, root), repo.git_commits(spark, root), existing_docs(spark, name, output_dir), patterns)
    render.write_reports(got, root, out)
    got.files.select("repo_id", "path", "hash", "todo_count", "mtime").write.mode("overwrite").parquet(where)
    return got
