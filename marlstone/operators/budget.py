"""Budgets over logs of steps: running sums with cut-offs. A log may hold any number of runs; each is a window partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text


@dataclass(frozen=True)
class Limits:
    """The default limits of a run."""

    max_steps: int = 30
    max_depth: int = 1
    max_total_tokens: int = 90_000
    max_local_tokens: int = 90_000
    max_worker_tokens: int = 90_000
    max_synthesis_tokens: int = 90_000
    max_global_llm_calls: int | None = None
    max_worker_llm_calls: int | None = None
    max_synthesis_llm_calls: int | None = None
    step_timeout_seconds: float = 15.0
    llm_timeout_seconds: float = 120.0
    stdout_chars: int = 2000
    state_items: int = 20
    state_value_chars: int = 160


def running(events: DataFrame) -> DataFrame:
    """Add sums along each run to rows (run_id, step, phase, prompt, response, llm_calls).

    prompt_tokens, response_tokens; local_before, phase_before and global_before (without the row) and local_total, phase_total
    and global_total (with it); phase_calls and global_calls. Worker rows add to their own phase and to the calls of all, but
    not to the tokens of the run or of all.
    """
    own = F.col("phase") != "worker"
    both = F.col("prompt_tokens") + F.col("response_tokens")
    run = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    phase = Window.partitionBy("run_id", "phase").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"prompt_tokens": text.tokens(F.col("prompt")), "response_tokens": text.tokens(F.col("response"))}).withColumn("tokens", both)
    counted = F.when(own, F.col("tokens")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"local_total": F.sum(counted).over(run), "phase_total": F.sum("tokens").over(phase), "phase_calls": F.sum("llm_calls").over(phase), "global_calls": F.sum("llm_calls").over(run)})
    return rows.withColumns({"global_total": F.col("local_total"), "local_before": F.col("local_total") - counted, "phase_before": F.col("phase_total") - F.col("tokens"), "global_before": F.col("local_total") - counted})


def violations(rows: DataFrame, limits: Limits) -> DataFrame:
    """Add violation to rows of :func:`running`: the first limit that a step breaks, or null.

    Before the call the prompt alone is weighed against the local, phase and global tokens; after it the totals are, then calls.
    """
    own = F.col("phase") != "worker"
    phase_limit = F.when(own, F.lit(limits.max_synthesis_tokens)).otherwise(F.lit(limits.max_worker_tokens))
    title = F.initcap("phase")
    would = lambda before: F.col(before) + F.col("prompt_tokens")

    def calls(name: str, count: str, limit: int | None, where: Column) -> list[tuple[Column, Column]]:
        return [] if limit is None else [(where & (F.col(count) > limit), F.lit(f"[{name.capitalize()} Call Budget Exceeded] max_{name}_llm_calls={limit} reached"))]

    def said(kind: str, rest: str) -> Column:
        return F.lit(f"[{kind} Token Budget Exceeded] {rest}")

    by_prompt = lambda kind, limit, before, name: F.concat(F.lit(f"[{kind} Token Budget Exceeded] max_{name}_tokens={limit} would be exceeded by prompt (prompt_tokens="), F.col("prompt_tokens").cast("string"), F.lit(f", current_{'global' if name == 'total' else name}_tokens="), F.col(before).cast("string"), F.lit(")"))
    checks = [
        (own & (would("local_before") > limits.max_local_tokens), by_prompt("Local", limits.max_local_tokens, "local_before", "local")),
        (own & (would("phase_before") > phase_limit), by_prompt("Synthesis", limits.max_synthesis_tokens, "phase_before", "synthesis")),
        (own & (would("global_before") > limits.max_total_tokens), by_prompt("Global", limits.max_total_tokens, "global_before", "total")),
        (own & (F.col("local_total") > limits.max_local_tokens), said("Local", f"max_local_tokens={limits.max_local_tokens} reached")),
        (F.col("phase_total") > phase_limit, F.concat(F.lit("["), title, F.lit(" Token Budget Exceeded] max_"), F.col("phase"), F.lit("_tokens="), phase_limit.cast("string"), F.lit(" reached"))),
        *calls("worker", "phase_calls", limits.max_worker_llm_calls, ~own),
        *calls("synthesis", "phase_calls", limits.max_synthesis_llm_calls, own),
        (F.col("global_total") > limits.max_total_tokens, said("Global", f"max_total_tokens={limits.max_total_tokens} reached")),
        *calls("global", "global_calls", limits.max_global_llm_calls, F.lit(True)),
    ]
    out = F.lit(None).cast("string")
    for broken, message in reversed(checks):
        out = F.when(broken, message).otherwise(out)
    return rows.withColumn("violation", out)


def cut_off(rows: DataFrame, limits: Limits) -> DataFrame:
    """What a run gets to: rows with violation, up to the first that breaks a limit (kept, with kind model_error) and max_steps; status of the run.

    Runs deeper than max_depth (column depth, if there) get to no step at all.
    """
    run = Window.partitionBy("run_id")
    if "depth" in rows.columns:
        rows = rows.filter(F.col("depth") <= limits.max_depth)
    rows = rows.withColumn("first_broken", F.min(F.when(F.col("violation").isNotNull(), F.col("step"))).over(run)).withColumn("place", F.row_number().over(run.orderBy("step")))
    many = F.max("place").over(run) > limits.max_steps
    kept = rows.withColumn("run_status", F.when(F.col("first_broken").isNotNull() | many, "budget_exceeded").otherwise("finished"))
    kept = kept.filter((F.col("place") <= limits.max_steps) & (F.coalesce(F.col("step") <= F.col("first_broken"), F.lit(True))))
    return kept.withColumn("kind", F.when(F.col("violation").isNotNull(), "model_error").otherwise("ok")).drop("place")


def totals(events: DataFrame) -> DataFrame:
    """run_id and sums by scope: local, worker, synthesis and global tokens, and calls of the last three."""
    worker = F.col("phase") == "worker"
    tokens = text.tokens(F.col("prompt")) + text.tokens(F.col("response"))
    some = lambda where, what: F.coalesce(F.sum(F.when(where, what)), F.lit(0))
    return events.groupBy("run_id").agg(
        some(~worker, tokens).alias("local_tokens"),
        some(worker, tokens).alias("worker_tokens"),
        some(~worker, tokens).alias("synthesis_tokens"),
        some(~worker, tokens).alias("global_tokens"),
        some(worker, F.col("llm_calls")).alias("worker_llm_calls"),
        some(~worker, F.col("llm_calls")).alias("synthesis_llm_calls"),
        F.sum("llm_calls").alias("global_llm_calls"),
    )


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Run totals after child runs: a child is seeded from its parent's global count, and its own then stands for it; local counts leave it out.

    ``parents``: run_id, local_tokens, global_tokens, global_llm_calls; ``children``: run_id, parent_id and the same sums of their own steps.
    """
    added = children.groupBy(F.col("parent_id").alias("run_id")).agg(F.sum("global_tokens").alias("child_tokens"), F.sum("global_llm_calls").alias("child_calls"))
    out = parents.join(added, "run_id", "left").fillna(0, ["child_tokens", "child_calls"])
    return out.withColumns({"global_tokens": F.col("global_tokens") + F.col("child_tokens"), "global_llm_calls": F.col("global_llm_calls") + F.col("child_calls")}).drop("child_tokens", "child_calls")
