"""Trees of runs against a replay of one tree after the other in plain Python."""

import math
import random
from dataclasses import replace

import pytest

from marlstone.operators import children
from marlstone.operators.budget import Limits

LOG = "run_id string, step int, phase string, prompt string, response string, llm_calls int, executed boolean, result string"
RUNS = "run_id string, parent_id string, parent_step int, ord int, goal string, context string, raised string"


class Tree:
    """Counts of one tree, step by step."""

    def __init__(self, log, runs, limits, child):
        self.log, self.runs, self.limits, self.child = log, runs, limits, child
        self.spent, self.calls, self.steps, self.out = 0, 0, [], {}

    def run(self, run, depth=0):
        limits = self.child if depth else self.limits
        own, status, error, result, n = 0, "budget_exceeded", None, None, 0
        if depth > limits.max_depth:
            error = f"[Depth Budget Exceeded] max_depth={limits.max_depth} reached"
        elif run["raised"] is not None:
            status, error = "execution_error", run["raised"]
        else:
            for row in self.log.get(run["run_id"], [])[: limits.max_steps]:
                n += 1
                p, r = (max(1, math.ceil(len(x) / 4)) for x in (row["prompt"], row["response"]))
                spent, broken = p + r, None
                if own + p > limits.max_local_tokens:
                    broken, spent = f"[Local Token Budget Exceeded] max_local_tokens={limits.max_local_tokens} would be exceeded by prompt (prompt_tokens={p}, current_local_tokens={own})", 0
                elif self.spent + p > limits.max_synthesis_tokens:
                    broken, spent = f"[Synthesis Token Budget Exceeded] max_synthesis_tokens={limits.max_synthesis_tokens} would be exceeded by prompt (prompt_tokens={p}, current_synthesis_tokens={self.spent})", 0
                elif self.spent + p > limits.max_total_tokens:
                    broken, spent = f"[Global Token Budget Exceeded] max_total_tokens={limits.max_total_tokens} would be exceeded by prompt (prompt_tokens={p}, current_global_tokens={self.spent})", 0
                own, self.spent, self.calls = own + spent, self.spent + spent, self.calls + row["llm_calls"]
                if broken is None:
                    if own > limits.max_local_tokens:
                        broken = f"[Local Token Budget Exceeded] max_local_tokens={limits.max_local_tokens} reached"
                    elif self.spent > limits.max_synthesis_tokens:
                        broken = f"[Synthesis Token Budget Exceeded] max_synthesis_tokens={limits.max_synthesis_tokens} reached"
                    elif self.spent > limits.max_total_tokens:
                        broken = f"[Global Token Budget Exceeded] max_total_tokens={limits.max_total_tokens} reached"
                self.steps.append((run["run_id"], row["step"], spent, own, self.spent, broken))
                if broken:
                    error = broken
                    break
                if row["executed"]:
                    for kid in sorted((x for x in self.runs if x["parent_id"] == run["run_id"] and x["parent_step"] == row["step"]), key=lambda x: x["ord"]):
                        self.run(kid, depth + 1)
                    if row["result"] is not None:
                        status, error, result = "finished", None, row["result"]
                        break
            else:
                error = f"[Step Budget Exceeded] max_steps={limits.max_steps} reached"
        refused = None
        if depth:
            above = self.limits if depth == 1 else self.child
            if self.spent > above.max_total_tokens:
                refused = f"[Global Token Budget Exceeded] max_total_tokens={above.max_total_tokens} reached"
            elif self.spent > above.max_synthesis_tokens:
                refused = f"[Synthesis Token Budget Exceeded] max_synthesis_tokens={above.max_synthesis_tokens} reached"
        self.out[run["run_id"]] = (run["run_id"], depth, status, error, result, n, own, self.spent, refused)


def expected(log, runs, limits, child):
    by_run = {}
    for row in sorted(log, key=lambda r: r["step"]):
        by_run.setdefault(row["run_id"], []).append(row)
    steps, out = [], []
    for root in (r for r in runs if r["parent_id"] is None):
        tree = Tree(by_run, runs, limits, child)
        tree.run(root)
        steps += tree.steps
        out += tree.out.values()
    return sorted(steps, key=repr), sorted(out, key=repr)


def row(run, step, prompt, response, executed=True, result=None, calls=1):
    return {"run_id": run, "step": step, "phase": "synthesis", "prompt": prompt, "response": response, "llm_calls": calls, "executed": executed, "result": result}


def asked(run, parent=None, step=None, ord=0, goal="look", context=None, raised=None):
    return {"run_id": run, "parent_id": parent, "parent_step": step, "ord": ord, "goal": goal, "context": context, "raised": raised}


def both(spark, log, runs, limits, child):
    steps, out = children.replayed(spark.createDataFrame([tuple(r.values()) for r in log], LOG), spark.createDataFrame([tuple(r.values()) for r in runs], RUNS), limits, child)
    return steps, out, {r["run_id"]: r for r in out.collect()}


@pytest.mark.parametrize("seed", range(1))
def test_random_trees(spark, seed):
    """Every kind of break at once: trees of up to four levels with narrow limits of all kinds."""
    draw = random.Random(seed)
    log, runs = [], []
    for t in range(40):
        names = [f"t{t}-0"]
        runs.append(asked(names[0]))
        for k in range(1, draw.randint(1, 9)):
            names.append(f"t{t}-{k}")
            parent = draw.choice(names[:-1])
            runs.append(asked(names[-1], parent, draw.randint(0, 3), k, raised="Traceback\nValueError: boom" if draw.random() < 0.08 else None))
        for name in names:
            for s in range(draw.randint(0, 4)):
                log.append(row(name, s, "p" * draw.randint(0, 160), "r" * draw.randint(0, 120), draw.random() < 0.9, "done" if draw.random() < 0.3 else None, draw.randint(0, 2)))
    runs += [asked("lost", "nowhere", 1), asked("loop", "loop", 1)]
    limits = Limits(max_steps=4, max_depth=2, max_total_tokens=draw.choice((150, 260)), max_local_tokens=110, max_synthesis_tokens=220)
    child = children.child_limits(limits, max_steps=3, max_total_tokens=200, max_local_tokens=60)
    steps, out, _ = both(spark, log, runs, limits, child)
    want_steps, want_runs = expected(log, runs, limits, child)
    got = [(r["run_id"], r["step"], r["spent"], r["local_total"], r["global_total"], r["violation"]) for r in steps.collect()]
    assert sorted(got, key=repr) == want_steps
    got = [(r["run_id"], r["depth"], r["status"], r["error"], r["result"], r["steps"], r["local_tokens"], r["global_after"], r["answer_error"]) for r in out.collect()]
    assert sorted(got, key=repr) == want_runs
    assert any(r[5] and "would be exceeded" in r[5] for r in want_steps)


CARD = '{"file": {"path": "lib/x.py", "info": {"language": "python", "line_count": 7}, "symbols": {"symbols": ["def a():\\n  pass"]}, "excerpt": "E", "reasons": ["entrypoint", "large"]}}'


def test_child_step_budget(spark):
    log = [row("r", 1, "ask", "code"), row("c", 1, "p", "x = 1"), row("c", 2, "p", "y = 1"), row("r", 2, "then", "finish", result="all")]
    _, _, got = both(spark, log, [asked("r"), asked("c", "r", 1, context=CARD)], Limits(max_steps=2), Limits(max_steps=1))
    assert got["r"]["status"] == "finished" and got["r"]["steps"] == 2
    answer = got["c"]["answer"]
    assert "budget_exceeded: [Step Budget Exceeded] max_steps=1 reached" in answer and "deep-dive child query for `lib/x.py`" in answer
    for line in ("- Language: python", "- Lines: 7", "- Selection reasons: entrypoint, large", "- Symbols: ['def a():\\n  pass']", "```\nE\n```"):
        assert line in answer


@pytest.mark.parametrize(("context", "path"), [(None, None), ("[1]", None), ("not json", None), ('{"file": 3}', "unknown"), ('{"path": "a.go"}', "a.go"), ('{"info": {"path": "b.go"}, "path": ""}', "b.go")])
def test_cards(spark, context, path):
    _, _, got = both(spark, [row("r", 1, "p", "c")], [asked("r"), asked("c", "r", 1, goal="why", context=context, raised="Traceback\n  at x\nValueError: boom\n")], Limits(), Limits())
    answer = got["c"]["answer"]
    assert "execution_error: ValueError: boom)" in answer
    if path is None:
        assert "No file card was provided" in answer and answer.endswith("## Focus\n\nwhy")
    else:
        assert f"child query for `{path}`" in answer and "- Language: None" in answer and "not recorded" in answer


def test_child_spends_the_parent_s_budget(spark):
    log = [row("r", 1, "", ""), row("c", 1, "p" * 40, "r" * 40, result="sum"), row("r", 2, "x" * 80, "")]
    steps, _, got = both(spark, log, [asked("r"), asked("c", "r", 1)], Limits(max_total_tokens=30), Limits(max_total_tokens=2000))
    assert got["c"]["status"] == "finished" and got["c"]["answer"] == "sum" and got["c"]["answer_error"] is None
    assert got["r"]["status"] == "budget_exceeded" and "would be exceeded by prompt (prompt_tokens=20, current_global_tokens=22)" in got["r"]["error"]
    _, _, got = both(spark, log, [asked("r"), asked("c", "r", 1)], Limits(max_total_tokens=5), Limits(max_total_tokens=2000))
    assert got["c"]["answer"] is None and got["c"]["answer_error"] == "[Global Token Budget Exceeded] max_total_tokens=5 reached"


def test_depth_and_calls(spark):
    log = [row("a", 1, "p", "r"), row("b", 1, "p", "r"), row("c", 1, "p", "r", result="deep"), row("n", 1, "p", "r", executed=False)]
    runs = [asked("a"), asked("b", "a", 1), asked("c", "b", 1), asked("n"), asked("never", "n", 1), asked("late", "a", 9)]
    _, _, got = both(spark, log, runs, Limits(), Limits())
    assert set(got) == {"a", "b", "c", "n"}
    assert got["c"]["status"] == "budget_exceeded" and "[Depth Budget Exceeded] max_depth=1 reached" in got["c"]["answer"] and got["c"]["steps"] == 0
    limits = replace(Limits(max_depth=3), max_global_llm_calls=2)
    _, _, got = both(spark, log, runs, limits, limits)
    assert got["c"]["error"] == "[Global Call Budget Exceeded] max_global_llm_calls=2 reached"


def test_nothing(spark):
    steps, out = children.replayed(spark.createDataFrame([], LOG), spark.createDataFrame([], RUNS))
    assert steps.count() == out.count() == 0
