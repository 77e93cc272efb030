"""From sources and the results of runs to the written documents of any number of repositories, in one plan.

Each source gets a document from its own text; what a run has returned stands over these; sources that none of the documents
names get a fallback; a report tells of the run and of the coverage. All are rows until the last step writes one file for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import budget, coverage, documents, runs
from marlstone.plans import render
from marlstone.plans.scratch import cut
from marlstone.sources import sink

#: Places of documents: what a run returns comes first, then those of sources, then fallbacks.
OF_SOURCES, FALLBACKS = 1 << 61, 1 << 62


def published(files: DataFrame, results: DataFrame, steps: DataFrame, root_name: str = "project", backend: str = "none", model: str = "none") -> DataFrame:
    """repo_id, kind (document, fallback, artifact, report), path, content of all that is written for each repository.

    ``files``: repo_id, path, content (text). ``results`` and ``steps``: as :func:`runs.results` and :func:`runs.replay` give them,
    run_id being the repository's; a repository without a run gets the documents of its sources and fallbacks alone. Paths are
    made safe and distinct. A run that didn't finish has an index that tells why, and keeps its other documents.
    """
    sources = cut(coverage.source_files(files).select("repo_id", "path", "content"), "sources")
    # Five readers follow: written once, or each would look for the definitions again.
    worker = cut(documents.worker_documents(sources).withColumn("ord", F.lit(OF_SOURCES) + F.pmod(F.xxhash64("path"), F.lit(OF_SOURCES))), "worker")
    own = cut(runs.structured(results, root_name).withColumn("ord", F.col("ord").cast("long")), "own")
    known = results.select(F.col("run_id").alias("repo_id"))
    # Of one path the run's document stands.
    over = worker.join(own.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").unionByName(own)
    named = cut(runs.bodies(over.select("repo_id", "ord", "path", "title", "content")), "documents")
    written = named.select("repo_id", F.col("out_path").alias("path"), "content")
    lacking = coverage.missing(sources, written)
    spare = documents.fallback_documents(lacking).withColumn("ord", F.lit(FALLBACKS) + F.pmod(F.xxhash64("path"), F.lit(OF_SOURCES)))
    taken = named.select("repo_id", "ord", F.col("out_path").alias("path"))
    names = documents.distinct_names(taken.unionByName(spare.select("repo_id", "ord", "path"))).filter(F.col("ord") >= FALLBACKS)
    fallback = cut(spare.drop("path").join(names.select("repo_id", "ord", "out_path"), ["repo_id", "ord"]), "fallbacks")
    every = written.withColumn("kind", F.lit("document")).unionByName(fallback.select("repo_id", F.col("out_path").alias("path"), "content", F.lit("fallback").alias("kind")))
    artifacts = documents.artifacts(worker).withColumns({"kind": F.lit("artifact"), "path": F.concat(F.lit("artifacts/"), F.col("path"))})
    return every.unionByName(artifacts).unionByName(reports(sources, every, results, steps, known, root_name, backend, model))


def reports(sources: DataFrame, docs: DataFrame, results: DataFrame, steps: DataFrame, known: DataFrame, root_name: str, backend: str, model: str) -> DataFrame:
    """analysis_report.md of each run: its budgets, summary, coverage and history. Its lists hold names alone, as the file does."""
    listed = lambda rows, column, name: rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(column)).alias(name))
    shown = docs.select("repo_id", "path", "content")
    fallback = docs.filter("kind = 'fallback'").select("repo_id", F.regexp_replace("path", r"\.md$", "").alias("source"))
    frames = [listed(coverage.missing(sources, shown), "path", "missing"), listed(coverage.extra(sources, shown), "doc_path", "extra"), listed(coverage.weak(shown), "doc_path", "weak"), listed(fallback, "source", "fallback")]
    history = steps.groupBy("run_id").agg(F.max("step").alias("last"))
    lines = documents.step_history(steps).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]).alias("history"))
    counts = sources.groupBy("repo_id").agg(F.count("*").alias("total"))
    done = coverage.documented(sources, shown).groupBy("repo_id").agg(F.count("*").alias("documented"))
    index = docs.filter("path = 'index.md'").select("repo_id", F.col("content").alias("summary"))
    rows = known
    for frame in (counts, done, index, *frames, *(x.withColumnRenamed("run_id", "repo_id") for x in (results.select("run_id", "status", "steps"), history, lines, budget.totals(steps)))):
        rows = rows.join(frame, "repo_id", "left")

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                some = lambda name, r=r: list(r[name]) if r[name] is not None else []
                number = lambda name, r=r: 0 if pd.isna(r[name]) else int(r[name])
                budgets = {k: f"{number(f'{s}_tokens')} tokens, {number(f'{s}_llm_calls')} LLM calls" for k, s in (("Worker Budget", "worker"), ("Synthesis RLM Budget", "synthesis"), ("Global Budget", "global"))}
                head = {"Backend": f"{backend} ({model})", "Runtime": "controller", "Status": r["status"], "Steps Used": str(number("steps")), "Approx Tokens": str(number("local_tokens"))} | budgets
                section = render.coverage_section(number("total"), number("documented"), some("missing"), some("extra"), some("weak"), some("fallback"))
                out.append((r["repo_id"], render.analysis_report(root_name, head, r["summary"] or "", section, some("history")), "analysis_report.md", "report"))
            yield pd.DataFrame(out, columns=["repo_id", "content", "path", "kind"])

    return rows.mapInPandas(render_all, "repo_id string, content string, path string, kind string")


def write(rows: DataFrame, root: str, by_repository: bool = True) -> None:
    """Write :func:`published` below ``root``, those of each repository in a folder of its name unless there is but one."""
    sink.register(rows.sparkSession)
    path = F.concat("repo_id", F.lit("/"), "path") if by_repository else F.col("path")
    rows.select(path.alias("path"), "content").write.format(sink.FORMAT).option("root", root).mode("append").save()
