"""Runs that ask child runs: budgets passed down and spent sums passed up, over logs of any number of trees of runs.

A child begins with the counts that its whole tree has spent so far, and what it spends stays spent for all that comes after it; its
own (local) count begins at 0. So each tree is one sequence of events: a step, then the children that it asks, then the next
step. Sums are windows over that sequence. A run that breaks a limit loses its later steps and the children below them, which
changes what comes after; the first break of each tree is certain, so a round settles one for every tree at once, and
trees without a new break are done.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import documents
from marlstone.operators.budget import Limits, violations
from marlstone.plans.scratch import cut, free

#: Place of what a child returns: after all that it holds.
AFTER = 2_147_483_647


def child_limits(limits: Limits, max_steps: int | None = None, max_total_tokens: int | None = None, max_local_tokens: int | None = None) -> Limits:
    """Limits of child runs: those of the parent, but for the ones given."""
    given = {"max_steps": max_steps, "max_total_tokens": max_total_tokens, "max_local_tokens": max_local_tokens}
    return replace(limits, **{k: v for k, v in given.items() if v is not None})


def placed(runs: DataFrame, max_depth: int) -> DataFrame:
    """Add root, depth, way (its place in its tree's sequence) and above (run and step of each run that it hangs on), down to the first depth not allowed.

    ``runs``: run_id, parent_id, parent_step and ord (place among the children of a step). Runs whose parents aren't there, or
    that hang on themselves, belong to no tree and are left out. A join for each depth.
    """
    nobody = F.array().cast(f"array<struct<run_id:{runs.schema['run_id'].dataType.simpleString()},step:bigint>>")
    level = runs.filter("parent_id is null").withColumns({"root": F.col("run_id"), "depth": F.lit(0), "way": F.array().cast("array<bigint>"), "above": nobody})
    levels = [level]
    for depth in range(1, max_depth + 2):
        up = level.select(F.col("run_id").alias("parent_id"), "root", F.col("way").alias("_way"), F.col("above").alias("_above"))
        level = runs.join(up, "parent_id").withColumns({
            "depth": F.lit(depth),
            "way": F.concat("_way", F.array(F.col("parent_step").cast("bigint"), F.col("ord").cast("bigint") + 1)),
            "above": F.concat("_above", F.array(F.struct(F.col("parent_id").alias("run_id"), F.col("parent_step").cast("bigint").alias("step")))),
        }).drop("_way", "_above")
        level = cut(level, "children")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def by_depth(own: Column | int | None, child: Column | int | None) -> Column:
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.col("depth") == 0, wrap(own)).otherwise(wrap(child))


def summed(events: DataFrame) -> DataFrame:
    """Add the sums that :func:`budget.violations` weighs, along each tree (global, phase) and each run (local)."""
    own = F.when(F.col("phase") != "worker", F.col("spent")).otherwise(F.lit(0).cast("long"))
    span = (Window.unboundedPreceding, 0)
    tree = Window.partitionBy("root").orderBy("key").rowsBetween(*span)
    phase = Window.partitionBy("root", "phase").orderBy("key").rowsBetween(*span)
    run = Window.partitionBy("run_id").orderBy("key").rowsBetween(*span)
    total = {"local_total": F.sum(own).over(run), "phase_total": F.sum("spent").over(phase), "global_total": F.sum(own).over(tree), "phase_calls": F.sum("calls").over(phase), "global_calls": F.sum("calls").over(tree)}
    rows = events.withColumns(total)
    return rows.withColumns({"local_before": F.col("local_total") - own, "phase_before": F.col("phase_total") - F.col("spent"), "global_before": F.col("global_total") - own})


def judged(events: DataFrame, limits: Limits, child: Limits) -> DataFrame:
    """Events with their sums and violation, null for what a child returns."""
    rows = violations(summed(events), limits).withColumnRenamed("violation", "_own")
    rows = violations(rows, child).withColumn("violation", F.when(F.col("step").isNotNull(), by_depth(F.col("_own"), F.col("violation"))))
    return rows.drop("_own")


def replayed(log: DataFrame, runs: DataFrame, limits: Limits = Limits(), child: Limits | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """What trees of runs amount to under limits: (steps, runs).

    ``log``: run_id, step, phase, prompt, response, llm_calls, executed (whether the step's code ran) and result (null unless it finished
    the run). ``runs``: run_id, parent_id, parent_step, ord, goal, context (JSON or null) and raised (an error before any step, or null).

    A run ends with the step that finishes it, the first that breaks a limit, or its last allowed one. A prompt that would break a limit isn't
    sent: it counts for nothing. A child runs only if its parent gets to the step that asks it and that step's code ran. A child below
    ``max_depth`` doesn't run. steps has root, depth, the sums and violation. runs has status (finished, budget_exceeded,
    execution_error), error, result, steps, local_tokens, calls, global_after (what its tree has spent when it returns), and for
    children answer, what the parent's code is given: the result, or a text that stands for it, or nothing where the tree has
    then spent more than the parent may (answer_error tells). Runs that are never asked aren't in it.

    Rows with null run or step are left out; repeated steps of a run are ordered by prompt and response; null texts count as empty ones, a token each; a run
    without steps has used its steps up. Long texts count by their length alone.
    """
    child = limits if child is None else child
    tree = cut(placed(runs, limits.max_depth), "trees")
    rows = log.filter("run_id is not null and step is not null").join(tree.select("run_id", "root", "depth", "way", "above"), "run_id")
    rows = rows.filter((F.col("depth") <= limits.max_depth))
    order = Window.partitionBy("run_id").orderBy("step", "prompt", "response")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= by_depth(limits.max_steps, child.max_steps))
    rows = rows.withColumns({
        "prompt_tokens": F.coalesce(text.tokens(F.col("prompt")), F.lit(0)).cast("long"),
        "response_tokens": F.coalesce(text.tokens(F.col("response")), F.lit(0)).cast("long"),
        "step": F.col("step").cast("long"),
        "calls": F.coalesce(F.col("llm_calls"), F.lit(0)).cast("long"),
        "done": F.coalesce(F.col("executed"), F.lit(False)) & F.col("result").isNotNull(),
    })
    kept = ["run_id", "root", "depth", "step", "place", "phase", "prompt_tokens", "response_tokens", "calls", "executed", "done", "result", "above", "key"]
    rows = rows.withColumn("key", F.concat("way", F.array(F.col("step"), F.lit(0).cast("long"), F.col("place").cast("long")))).select(*kept)
    # The step that finishes a run is its last, whatever else is cut.
    end = F.min(F.when(F.col("done"), F.col("place"))).over(Window.partitionBy("run_id"))
    rows = rows.withColumn("_end", end).filter("_end is null or place <= _end").drop("_end")
    # Runs that a failing start ends have no steps.
    rows = rows.join(tree.filter("raised is not null").select("run_id"), "run_id", "left_anti")
    returns = tree.select("run_id", "root", "depth", "above", F.concat("way", F.array(F.lit(AFTER).cast("long"))).alias("key"))
    none = {"step": "long", "place": "int", "phase": "string", "prompt_tokens": "long", "response_tokens": "long", "calls": "long", "executed": "boolean", "done": "boolean", "result": log.schema["result"].dataType.simpleString()}
    returns = returns.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).select(*kept).withColumns({"phase": F.lit("synthesis"), "calls": F.lit(0).cast("long"), "prompt_tokens": F.lit(0).cast("long"), "response_tokens": F.lit(0).cast("long")})
    events = cut(rows.unionByName(returns), "events")
    # Children of steps that no run gets to, or whose code didn't run, are never asked.
    hangs = tree.select("run_id", F.explode("above").alias("a")).select("run_id", F.col("a.run_id").alias("over"), F.col("a.step").alias("at"))
    ran = events.filter("executed and step is not null").select(F.col("run_id").alias("over"), F.col("step").alias("at")).distinct()
    unasked = hangs.join(ran, ["over", "at"], "left_anti").select("run_id").distinct()
    live = cut(events.join(unasked, "run_id", "left_anti").withColumns({"spent": F.col("prompt_tokens") + F.col("response_tokens"), "settled": F.lit(False)}), "events")
    free(events)

    while True:
        seen = judged(live, limits, child)
        local = F.col("violation").startswith("[Local")
        broken = seen.filter("violation is not null and not settled")
        # Local sums hang on the run alone: its first local break ends it at the latest. Others are certain for the first of a tree.
        first = broken.groupBy("root").agg(F.min_by(F.struct("run_id", "place", "step", "violation"), "key").alias("b")).select("b.*")
        own = broken.filter(local).groupBy("run_id").agg(F.min_by(F.struct("place", "step", "violation"), "key").alias("b")).select("run_id", "b.*")
        ends = first.unionByName(own).groupBy("run_id").agg(F.min_by(F.struct("place", "step", "violation"), "place").alias("b"))
        ends = cut(ends.select("run_id", F.col("b.place").alias("last"), F.col("b.step").alias("at"), F.col("b.violation").contains("would be exceeded").alias("refused")), "ends")
        if ends.isEmpty():
            free(ends)
            break
        lost = live.select("run_id", F.explode("above").alias("a")).distinct().join(ends.select(F.col("run_id").alias("over"), "at"), (F.col("a.run_id") == F.col("over")) & (F.col("a.step") >= F.col("at"))).select("run_id").distinct()
        rows = live.join(lost, "run_id", "left_anti").join(ends, "run_id", "left").filter("last is null or place is null or place <= last")
        here = F.coalesce(F.col("place") == F.col("last"), F.lit(False))
        before, live = live, cut(rows.withColumns({"spent": F.when(here & F.col("refused"), F.lit(0).cast("long")).otherwise(F.col("spent")), "settled": F.col("settled") | here}).drop("last", "at", "refused"), "events")
        free(before, ends)

    seen = cut(judged(live, limits, child), "judged")
    free(live)
    steps = seen.filter("step is not null").withColumn("kind", F.when(F.col("violation").isNotNull(), "model_error").when(F.col("done"), "finished").otherwise("ok"))
    steps = steps.select("run_id", "root", "depth", "step", "phase", "prompt_tokens", "response_tokens", "spent", "local_total", "phase_total", "global_total", "global_calls", "violation", "kind")
    return steps, outcomes(seen, tree, limits, child)


def outcomes(seen: DataFrame, tree: DataFrame, limits: Limits, child: Limits) -> DataFrame:
    """A row for each run that was asked, see :func:`replayed`."""
    own = seen.filter("step is not null").groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.max_by("violation", "key").alias("violation"),
        F.max_by(F.when(F.col("violation").isNull() & F.col("done"), F.col("result")), "key").alias("result"),
        F.sum(F.when(F.col("phase") != "worker", F.col("spent"))).alias("local_tokens"),
        F.sum("calls").alias("calls"),
    )
    back = seen.filter("step is null").select("run_id", F.col("global_total").alias("global_after"), F.col("phase_total").alias("_phase"), F.col("global_calls").alias("_calls"))
    rows = tree.join(back, "run_id").join(own, "run_id", "left").fillna(0, ["steps", "local_tokens", "calls"])
    deep = F.col("depth") > limits.max_depth
    most = by_depth(limits.max_steps, child.max_steps).cast("string")
    status = F.when(deep, "budget_exceeded").when(F.col("raised").isNotNull(), "execution_error").when(F.col("result").isNotNull(), "finished").otherwise("budget_exceeded")
    error = F.when(deep, F.concat(F.lit("[Depth Budget Exceeded] max_depth="), by_depth(limits.max_depth, child.max_depth).cast("string"), F.lit(" reached"))).when(F.col("raised").isNotNull(), F.col("raised"))
    error = error.when(F.col("result").isNotNull(), F.lit(None)).when(F.col("violation").isNotNull(), F.col("violation")).otherwise(F.concat(F.lit("[Step Budget Exceeded] max_steps="), most, F.lit(" reached")))
    rows = rows.withColumns({"status": status, "error": error})
    # What the parent may have spent when the child returns: the parent of a child at depth 1 is a root.
    may = lambda name: F.when(F.col("depth") == 1, F.lit(getattr(limits, name))).otherwise(F.lit(getattr(child, name)))
    over = F.when(F.col("global_after") > may("max_total_tokens"), F.concat(F.lit("[Global Token Budget Exceeded] max_total_tokens="), may("max_total_tokens").cast("string"), F.lit(" reached")))
    over = over.when(F.col("_phase") > may("max_synthesis_tokens"), F.concat(F.lit("[Synthesis Token Budget Exceeded] max_synthesis_tokens="), may("max_synthesis_tokens").cast("string"), F.lit(" reached")))
    if limits.max_synthesis_llm_calls is not None:
        over = over.when(F.col("_calls") > limits.max_synthesis_llm_calls, F.lit(f"[Synthesis Call Budget Exceeded] max_synthesis_llm_calls={limits.max_synthesis_llm_calls} reached"))
    answer = F.when(F.col("status") == "finished", F.col("result")).otherwise(documents.child_fallback(F.col("goal"), F.col("status"), F.col("error"), F.col("context")))
    is_child = F.col("depth") > 0
    rows = rows.withColumn("answer_error", F.when(is_child, over)).withColumn("answer", F.when(is_child & F.col("answer_error").isNull(), answer))
    return rows.select("run_id", "parent_id", "root", "depth", "status", "error", "result", "steps", "local_tokens", "calls", "global_after", "answer", "answer_error")
