"""Documents from sources and runs, written one file a row; what a failing task leaves."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.operators import budget, runs
from marlstone.plans import publish
from marlstone.plans.scratch import cut
from marlstone.sources import sink

FILES = [("one", "src/app.py", "import os\n\ndef run():\n    pass\n"), ("one", "lib/x.go", "package x\nfunc Go() {\n}\n"), ("one", "notes.txt", "no source"), ("two", "main.rs", "fn main() {}\n")]
LOG = "run_id string, step int, phase string, prompt string, response string, llm_calls int, stdout string, error string, result string"


def result():
    docs = [{"path": "src/app.py.md", "title": "App", "content": "# App\n\nThe controller's own words about the application and what it does."}, {"path": "../escape.md", "title": "Out", "content": "text"}, {"path": "analysis_report.md", "title": "R", "content": "mine"}]
    return json.dumps({"summary": "All is well.", "documents": docs})


@pytest.fixture(scope="module")
def rows(spark):
    log = [("one", 1, "synthesis", "p" * 8, "x = 1", 1, "said | this", None, None), ("one", 2, "synthesis", "p", "finish(1)", 1, None, None, result()), ("two", 1, "synthesis", "p", "import os", 1, None, None, None)]
    steps = cut(runs.replay(spark.createDataFrame(log, LOG), budget.Limits()))
    return cut(publish.published(spark.createDataFrame(FILES, "repo_id string, path string, content string"), runs.results(steps), steps, "demo"))


def test_published(rows):
    got = {(r["repo_id"], r["kind"], r["path"]): r["content"] for r in rows.collect()}
    assert got["one", "document", "src/app.py.md"].startswith("# App\n\nThe controller's own words")
    assert "## Responsibility" in got["one", "document", "lib/x.go.md"] and "- `func Go() {`" in got["one", "document", "lib/x.go.md"]
    assert got["one", "document", "index.md"] == "# Directory: demo\n\nAll is well."
    assert got["one", "document", "escape.md"] == "# Out\n\ntext" and got["one", "document", "analysis_report_1.md"] == "# R\n\nmine"
    assert "[budget_exceeded]" in got["two", "document", "index.md"] and "## Responsibility" in got["two", "document", "main.rs.md"]
    report = got["one", "report", "analysis_report.md"]
    for line in ("# Project Analysis Report: demo", "**Status:** finished", "- Source files discovered: 2", "- Source files missing matching docs: 0", "- `analysis_report_1.md`", "| 1 | ok | OK | said &#124; this |", "**Steps Used:** 2"):
        assert line in report
    assert "**Status:** budget_exceeded" in got["two", "report", "analysis_report.md"]
    manifest = json.loads(got["one", "artifact", "artifacts/manifest.json"])
    assert {d["document_path"] for d in manifest["documents"]} == {"src/app.py.md", "lib/x.go.md"}
    assert json.loads(got["one", "artifact", "artifacts/relationships.json"])["relationships"][0]["target"] == "os"


def test_definitions_are_looked_for_once(spark):
    steps = cut(runs.replay(spark.createDataFrame([("one", 1, "synthesis", "p", "finish(1)", 1, None, None, result())], LOG), budget.Limits()))
    rows = publish.published(spark.createDataFrame(FILES, "repo_id string, path string, content string"), runs.results(steps), steps, "demo")
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_written(spark, rows, tmp_path):
    publish.write(rows, str(tmp_path / "out"))
    found = {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f"{r['repo_id']}/{r['path']}": r["content"] for r in rows.collect()}
    publish.write(rows.filter("repo_id = 'two'"), f"file://{tmp_path}/two", by_repository=False)
    assert (tmp_path / "two" / "main.rs.md").exists() and not list(tmp_path.rglob(sink.STAGING))


def test_failed_task_leaves_nothing(spark, tmp_path):
    sink.register(spark)
    write = lambda rows, mode="append": rows.write.format(sink.FORMAT).option("root", str(tmp_path)).mode(mode).save()
    write(spark.createDataFrame([("a/b.txt", "old"), ("c.txt", None)], "path string, content string"))
    assert (tmp_path / "a" / "b.txt").read_text() == "old" and (tmp_path / "c.txt").read_bytes() == b""
    bad = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("content"), "id").repartition(4)
    with pytest.raises(PySparkException):
        write(bad.select(F.when(F.col("id") == 33, "../out").otherwise(F.col("path")).alias("path"), "content"))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.txt", "c.txt"] and not (tmp_path / sink.STAGING).exists()
    write(bad, "overwrite")
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == sorted(map(str, range(40)))


@pytest.mark.parametrize("path", ["", None, "/a", "a//b", "a/../b", "./a", "a\\b", f"{sink.STAGING}/x"])
def test_paths_outside(path):
    with pytest.raises(ValueError, match="below the root"):
        sink.checked(path)
