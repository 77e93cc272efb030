"""Runs of a controller as tables: a log of steps is checked, budgeted and merged; a model is a function over prompts.

Code that a model writes is parsed and judged, never run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import answers, text
from marlstone.operators import budget, documents
from marlstone.plans.scratch import cut

LlmFunction = Callable[[str], str]


def asked(prompts: DataFrame, llm_fn: LlmFunction, column: str = "prompt") -> DataFrame:
    """Add response: what ``llm_fn`` says to each prompt; an error becomes the text ``[Error: ...]``, as a model's own would."""

    def one(prompt: str) -> str:
        try:
            return llm_fn(prompt)
        except Exception as e:  # what a model raises is an answer too
            return f"[Error: {e}]"

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(one)

    return prompts.withColumn("response", run(column))


def scripted(responses: dict[str, str], otherwise: str = "") -> LlmFunction:
    """A model that answers from a table, for tests and replays."""
    return lambda prompt: responses.get(prompt, otherwise)


def replay(log: DataFrame, limits: budget.Limits = budget.Limits()) -> DataFrame:  # noqa: B008
    """What a log of steps amounts to under limits.

    ``log``: run_id, step, phase, prompt, response, llm_calls, stdout, error, result (JSON where the step finished, else
    null), and depth if runs have one. Adds the sums of :func:`budget.running`, violation, kind (ok, finished,
    execution_error, invalid_code, model_error), code, code_error and run_status (finished, budget_exceeded). A run ends with
    the step that finishes it, or the first that breaks a limit; one that does neither has used its steps up.
    """
    rows = budget.violations(budget.running(log), limits)
    rows = rows.withColumn("v", answers.validated_code("response")).withColumns({"code": F.col("v.code"), "code_error": F.col("v.error"), "code_kind": F.col("v.kind")}).drop("v")
    over = Window.partitionBy("run_id")
    done = F.col("result").isNotNull() & F.col("violation").isNull() & (F.col("code_kind") == "code")
    rows = rows.withColumn("end", F.min(F.when(done, F.col("step"))).over(over)).filter(F.coalesce(F.col("step") <= F.col("end"), F.lit(True)))
    kept = budget.cut_off(rows.withColumn("done", F.coalesce(F.col("step") == F.col("end"), F.lit(False))), limits)
    kind = F.when(F.col("violation").isNotNull(), "model_error").when(F.col("code_kind") != "code", F.col("code_kind")).when(F.coalesce(F.col("error"), F.lit("")) != "", "execution_error").when(F.col("done"), "finished").otherwise("ok")
    finished = F.max(F.col("done")).over(over)
    return kept.withColumn("kind", kind).withColumn("run_status", F.when(finished, "finished").otherwise("budget_exceeded")).drop("done", "end", "code_kind", "first_broken")


def results(steps: DataFrame) -> DataFrame:
    """run_id, status, result, error, steps: one row for each run of :func:`replay`."""
    last = F.max_by(F.struct("result", F.coalesce("violation", "error", "code_error").alias("error")), "step").alias("last")
    return steps.groupBy("run_id").agg(F.first("run_status").alias("status"), F.count("*").alias("steps"), last).select("run_id", "status", F.when(F.col("status") == "finished", F.col("last.result")).alias("result"), F.when(F.col("status") != "finished", F.col("last.error")).alias("error"), "steps")


def structured(results_: DataFrame, root_name: str) -> DataFrame:
    """repo_id (the run), ord, path, title, content: documents of each result, with an index made of the summary if it has none.

    A run that didn't finish gets an index that tells why; its other documents stay.
    """
    shape = "struct<summary: string, result: string, documents: array<struct<path: string, title: string, content: string>>>"
    rows = results_.withColumn("r", F.from_json("result", shape))
    summary = F.coalesce(F.nullif("r.summary", F.lit("")), F.nullif("r.result", F.lit("")), F.lit(""))
    advice = F.concat(F.when(F.col("status") == "budget_exceeded", "Try increasing --max-total-tokens or --max-steps. ").otherwise(""), F.lit("If the controller keeps failing, retry with --runtime legacy."))
    failed = F.concat(F.lit("["), "status", F.lit("] "), F.coalesce("error", summary), F.lit(" "), advice)
    name = F.coalesce(F.nullif("d.path", F.lit("")), F.lit("index.md"))
    listed = rows.select("run_id", "status", F.posexplode("r.documents").alias("ord", "d"))
    base = F.regexp_extract(name, r"([^/]*?)(\.[^./]*)?$", 1)
    own = listed.select("run_id", "status", (F.col("ord") + 1).alias("ord"), name.alias("path"), F.coalesce(F.nullif("d.title", F.lit("")), base).alias("title"), F.coalesce("d.content", F.lit("")).alias("content"))
    own = own.filter("status = 'finished' or path <> 'index.md'").drop("status")
    indexed = own.filter("path = 'index.md'").select("run_id").distinct()
    ok = F.col("status") == "finished"
    index = rows.join(indexed, "run_id", "left_anti").select("run_id", F.lit(0).alias("ord"), F.lit("index.md").alias("path"), F.when(ok, F.lit(f"Directory: {root_name}")).otherwise(F.concat(F.lit("Analysis stopped: "), "status")).alias("title"), F.when(ok, summary).otherwise(failed).alias("content"))
    return index.unionByName(own).withColumnRenamed("run_id", "repo_id")


def bodies(docs: DataFrame) -> DataFrame:
    """repo_id, ord, path, out_path, content as written: a heading before a body that has none, and a name of its own."""
    body = F.when(F.col("content") == "", F.concat(F.lit("# "), "title", F.lit("\n"))).when(F.ltrim("content").startswith("#"), F.col("content")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "content"))
    names = documents.distinct_names(docs.select("repo_id", "ord", "path"))
    return docs.withColumn("content", body).join(names.drop("path"), ["repo_id", "ord"])


def folded(files: DataFrame, summarise: Callable[[Column, Column], Column], max_depth: int | None = None) -> DataFrame:
    """repo_id, directory, depth, summary: directories from the deepest up, each made of its files and its directories' summaries.

    ``files``: repo_id, path, summary. ``summarise(directory, parts)`` turns the sorted parts into a text. One aggregate for each
    depth, which is that of the deepest file; with ``max_depth``, files of deeper directories count as in the one at that depth.
    """
    where = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(?s:(.*))/[^/]*$", 1)).otherwise("")
    level = lambda d: F.when(d == "", 0).otherwise(F.size(F.split(d, "/")))
    if max_depth is None:
        max_depth = files.agg(F.max(level(where))).first()[0] or 0
    directory = F.array_join(F.slice(F.split(where, "/"), 1, max(max_depth, 1)), "/")
    items = files.select("repo_id", directory.alias("directory"), F.col("path").alias("name"), "summary")
    pending = items.withColumn("depth", level(F.col("directory")))
    out = None
    for depth in range(max_depth, -1, -1):
        here = pending.filter(F.col("depth") == depth).groupBy("repo_id", "directory", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "summary"))), lambda x: F.concat(x["name"], F.lit(": "), x["summary"])).alias("parts"))
        made = cut(here.select("repo_id", "directory", "depth", summarise(F.col("directory"), F.col("parts")).alias("summary")), "folded")
        out = made if out is None else out.unionByName(made)
        if depth:
            above = F.when(F.instr("directory", "/") > 0, F.regexp_extract("directory", r"^(.*)/[^/]*$", 1)).otherwise("")
            up = made.select("repo_id", above.alias("above"), F.concat("directory", F.lit("/")).alias("name"), "summary").select("repo_id", F.col("above").alias("directory"), "name", "summary")
            pending = pending.filter(F.col("depth") < depth).unionByName(up.withColumn("depth", level(F.col("directory"))))
    return out


def with_fallback(children: DataFrame) -> DataFrame:
    """Add answer to child runs (goal, status, result, error, and context if they have one): the result of those that finished, else a text that stands for it."""
    return children.withColumn("answer", F.when(F.col("status") == "finished", F.col("result")).otherwise(documents.child_fallback(F.col("goal"), F.col("status"), F.col("error"), F.col("context") if "context" in children.columns else None)))


def state_text(state: Column, items: int = 20, chars: int = 160) -> Column:
    """The first names of a state, sorted, with their values cut."""
    entries = F.slice(F.array_sort(F.map_entries(state)), 1, items)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), text.capped(e["value"], chars).alias("value"))))
