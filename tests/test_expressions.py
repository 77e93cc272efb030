"""Expressions and operators over small tables with known results."""

import random
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import answers, code, lexer, paths, reprs, text, validate
from marlstone.operators import budget, coverage, documents, runs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_kinds(spark):
    want = {"src/test_helpers.py": "source", "src/auth_tester.py": "source", "pkg/test_utils.py": "source", "src/a_test.go": "test", "test_x/a.py": "test", "docs/a.py": "doc", "a.pdf": "doc", "a.png": "other", "LICENSE": "doc", "x/conftest.py": "config", "a.xyz": "source"}
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", paths.kind(F.col("path")).alias("kind"))
    assert {r["path"]: r["kind"] for r in rows.collect()} == want


def test_names(spark):
    rows = spark.createDataFrame([(p,) for p in (".gitignore", "a.tar.gz", "x/a.", "b")], "path string")
    got = {r["path"]: (r["s"], r["b"]) for r in rows.select("path", paths.suffix(F.col("path")).alias("s"), paths.stem(F.col("path")).alias("b")).collect()}
    assert got == {".gitignore": ("", ".gitignore"), "a.tar.gz": (".gz", "a.tar"), "x/a.": ("", "a."), "b": ("", "b")}


def test_paths(spark):
    r = one(spark, paths.without_dots(F.lit(".github/x")).alias("a"), paths.artifact_path(F.lit("./a//b")).alias("b"), paths.within_root(F.lit("repo/a/../b"), "repo").alias("c"), paths.within_root(F.lit("../x"), "repo").alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("github/x", "a/b", "b", None)
    with pytest.raises(Exception, match="escapes"):
        one(spark, paths.artifact_path(F.lit("a/../../b")))


def test_search(spark):
    r = one(spark, text.hits(F.lit("first stream mention\nsecond line\nanother STREAM mention"), "stream", 5, 8).alias("h"))["h"]
    assert [(h["offset"], h["line"], h["match"]) for h in r] == [(6, 1, "stream"), (41, 3, "STREAM")]


def test_slices_and_cells(spark):
    long = F.lit("abcdef" * 500)
    r = one(spark, text.piece(long, 3, 4).alias("a"), F.length(text.piece(long, 0, 3000)).alias("b"), text.cell(F.lit("hello | world")).alias("c"), text.cell(F.lit("line1\nline2")).alias("d"), text.cell(F.lit("ends\\")).alias("e"), text.lines_by_break(F.lit("one\ntwo\nthree")).alias("f"))
    assert tuple(r) == ("defa", 2000, "hello &#124; world", "line1 line2", "ends\\\\", 3)


def test_decoding_drops_bad_bytes(spark):
    assert spark.createDataFrame([(b"a\xffb",)], "c binary").select(text.decoded("c").alias("x")).first()["x"] == "ab"


def test_code_checks():
    assert answers.checked("```python\nx = 1\n```")["code"] == "x = 1"
    assert answers.checked("> x = 1")["code"] == "x = 1"
    assert answers.checked("'x = 1'")["code"] == "x = 1"
    assert answers.checked("import os")["error"].startswith("Import statements")
    assert answers.checked("finish = 1")["error"].startswith("Assigning to helper")
    assert answers.checked("globals['x']")["kind"] == "invalid_code"
    assert answers.checked("[Error: x]")["kind"] == "model_error"
    assert answers.checked("plain prose here")["error"].startswith("SyntaxError")
    assert answers.checked("  ")["error"] == "Model returned an empty response."


def test_symbols_of_other_languages():
    got = code.other_symbols("export class X\nclass Y {\nfunc z() {\nimport './q'\n", ("src",))
    assert [s["name"] for s in got["symbols"]] == ["Y", "z"] and got["imports"] == [{"module": "./q", "internal": True}]


def test_short_reprs():
    assert reprs.summary_of([1, 2], 50) == "list [1, 2]"
    assert reprs.summary_of("x" * 20, 10).startswith("str(len=20)")
    assert reprs.summary_of(list(range(200)), 50) == "list(len=200) [0, ...]"


def test_result_shape(spark):
    rows = spark.createDataFrame([("[1]",), ('{"summary": "s"}',), ('{"documents": 3}',), ('{"summary": 1, "documents": [{"path": 2}, 5]}',)], "r string")
    got = [r["e"] for r in rows.select(validate.result_errors(F.col("r")).alias("e")).collect()]
    assert got[0] == ["Expected finish(value) to receive a dict, got list."]
    assert got[1] == []
    assert got[2] == ["Missing required key 'summary'.", "Expected 'documents' to be list, got int."]
    assert got[3] == ["Expected 'summary' to be str, got int.", "Expected documents[0]['path'] to be str, got int.", "Expected documents[1] to be dict, got int."]


def test_summaries_are_completed(spark):
    r = one(spark, validate.completed_summary(F.lit("x" * 50 + "\n## Relationships")).alias("s"))["s"]
    assert r.count("## ") == 4 and "## Major directories\n\n- This section" in r


@pytest.mark.parametrize(("docs", "want"), [([], (1, 0, 1, 0, 0)), (["app.md"], (1, 1, 0, 0, 0)), (["app.py"], (1, 1, 0, 0, 0)), (["app.py.md", "notes.md"], (1, 1, 0, 1, 0)), (["index.md"], (1, 0, 1, 0, 0))])
def test_source_coverage(spark, docs, want):
    files = spark.createDataFrame([("r", "app.py")], "repo_id string, path string")
    frame = spark.createDataFrame([("r", d, "y" * 60) for d in docs], "repo_id string, path string, content string")
    r = coverage.source_coverage(files, frame).first()
    assert tuple(r[k] for k in ("total", "documented", "missing", "extra", "weak")) == want


def test_weak_document(spark):
    files = spark.createDataFrame([("r", "app.py")], "repo_id string, path string")
    docs = spark.createDataFrame([("r", "app.py.md", "")], "repo_id string, path string, content string")
    assert coverage.source_coverage(files, docs).first()["weak"] == 1


def test_worker_documents_and_artifacts(spark):
    files = spark.createDataFrame([("r", "app.py", "import os\n\ndef hello(name):\n    return name\n")], "repo_id string, path string, content string")
    docs = documents.worker_documents(files).withColumn("ord", F.lit(0))
    r = docs.first()
    assert r["path"] == "app.py.md" and "- `def hello(name):`" in r["content"] and "`python` source file with 5 lines" in r["content"]
    links = documents.relationships(docs).collect()
    assert [(x["source"], x["target"], x["statement"]) for x in links] == [("app.py", "os", "import os")]
    kept = {x["path"]: x["content"] for x in documents.artifacts(docs).collect()}
    assert set(kept) == {"manifest.json", "relationships.json", "source-docs/app.py.md"} and '"target":"os"' in kept["relationships.json"]
    assert documents.grep(documents.artifacts(docs), "responsibility").first()["path"] == "source-docs/app.py.md"
    assert documents.fallback_documents(files).first()["content"].startswith("# Source: app.py")


def test_names_that_interplay(spark):
    rows = spark.createDataFrame([("r", i, p) for i, p in enumerate(["doc.md", "doc_1.md", "doc.md", "doc.md", "analysis_report.md"])], "repo_id string, ord int, path string")
    got = {r["ord"]: r["out_path"] for r in documents.distinct_names(rows).collect()}
    assert got == {0: "doc.md", 1: "doc_1.md", 2: "doc_2.md", 3: "doc_3.md", 4: "analysis_report_1.md"}


def names_one_by_one(rows):
    """out_path by ord of (ord, safe path) as one who writes file after file picks names."""
    taken, out = {"analysis_report.md"}, {}
    for n, safe in sorted(rows):
        folder, slash, base = safe.rpartition("/")
        stem = base.removesuffix(".md")
        for i in range(len(rows) + 2):
            tail = f"_{i}" if i else ""
            name = f"{folder}{slash}{stem[: 255 - 3 - len(tail)]}{tail}.md"
            if name not in taken:
                break
        taken.add(name)
        out[n] = name
    return out


def test_names_as_if_written_one_by_one(spark):
    rng = random.Random(11)
    long = "x" * 250
    pools = [
        ["doc", "doc_1", "doc_2", "doc_3", "doc_7", "doc_1_1", "doc_1_2", "doc_01", "doc_", "doc_x", "d/doc", "d/doc_1"],
        [f"a_{i}" if i else "a" for i in range(12)] + ["a"] * 20,
        ["analysis_report", "analysis_report_1", "analysis_report_2", "b/analysis_report"],
        [long, long + "_1", long + "_12", long[:248] + "_1", long[:249] + "_1", long + "yz", "x"],
        ["p", "p_1", "p_1_1", "p_1_1_1", "p_2", "p_1_2", "p_999999999999999999999"],
    ]
    cases = {}
    for c in range(60):
        pool = rng.choice(pools) + (rng.choice(pools) if c % 3 == 0 else [])
        cases[f"r{c}"] = [(i, rng.choice(pool) + ".md") for i in range(rng.randrange(1, 60))]
    rows = spark.createDataFrame([(r, i, p) for r, some in cases.items() for i, p in some], "repo_id string, ord int, path string")
    got: dict = {}
    for r in documents.distinct_names(rows).collect():
        assert got.setdefault(r["repo_id"], {}).setdefault(r["ord"], r["out_path"]) == r["out_path"]
    assert got == {r: names_one_by_one([(i, safe_name(p)) for i, p in some]) for r, some in cases.items()}
    assert documents.distinct_names(rows.limit(0)).count() == 0


def safe_name(path):
    """The part of the safe path's rule that these cases need: names of 255 characters, then the suffix."""
    cut = path[:255]
    return cut if cut.endswith(".md") else cut + ".md"


def test_last_document_wins(spark):
    worker = spark.createDataFrame([("r", "a", "t", "old", 0), ("r", "b", "t", "b", 1)], "repo_id string, path string, title string, content string, ord int")
    result = spark.createDataFrame([("r", "a", "t", "new", 0), ("r", None, "t", "x", 1)], "repo_id string, path string, title string, content string, ord int")
    got = documents.overlaid(worker, result).orderBy("place").collect()
    assert [(r["path"], r["content"]) for r in got] == [("a", "new"), ("b", "b")]


LOG = "run_id string, step int, phase string, prompt string, response string, llm_calls int, stdout string, error string, result string"


def test_replay(spark):
    rows = [
        ("a", 1, "synthesis", "p", "x = 1", 1, "out", None, None),
        ("a", 2, "synthesis", "p", "finish({})", 1, None, None, '{"summary": "done", "documents": [{"path": "d.md", "title": "D", "content": "c"}]}'),
        ("a", 3, "synthesis", "p", "x = 2", 1, None, None, None),
        ("b", 1, "synthesis", "g" * 2000, "x = 1", 1, None, None, None),
        ("b", 2, "synthesis", "p", "x = 1", 1, None, None, None),
        ("c", 1, "synthesis", "p", "some prose", 1, None, None, None),
    ]
    steps = runs.replay(spark.createDataFrame(rows, LOG), budget.Limits(max_total_tokens=100))
    kinds = {(r["run_id"], r["step"]): r["kind"] for r in steps.collect()}
    assert kinds == {("a", 1): "ok", ("a", 2): "finished", ("b", 1): "model_error", ("c", 1): "invalid_code"}
    got = {r["run_id"]: r for r in runs.results(steps).collect()}
    assert got["a"]["status"] == "finished" and got["b"]["status"] == "budget_exceeded" and "[Global Token Budget Exceeded]" in got["b"]["error"]
    docs = {(r["repo_id"], r["path"]): r["content"] for r in runs.structured(runs.results(steps), "root").collect()}
    assert docs["a", "index.md"] == "done" and docs["a", "d.md"] == "c" and docs["b", "index.md"].startswith("[budget_exceeded]")
    assert {r["out_path"] for r in runs.bodies(runs.structured(runs.results(steps), "root")).filter("repo_id = 'a'").collect()} == {"index.md", "d.md"}


def test_worker_budget_leaves_global_tokens(spark):
    rows = [("w", 1, "worker", "x" * 80, "y" * 80, 0)]
    events = spark.createDataFrame(rows, "run_id string, step int, phase string, prompt string, response string, llm_calls int")
    limits = budget.Limits(max_worker_tokens=20)
    r = budget.violations(budget.running(events), limits).first()
    assert r["violation"] == "[Worker Token Budget Exceeded] max_worker_tokens=20 reached" and r["global_total"] == 0


def test_models_and_folds(spark):
    asked = runs.asked(spark.createDataFrame([("p",), ("q",)], "prompt string"), runs.scripted({"p": "yes"}, "no"))
    assert {r["prompt"]: r["response"] for r in asked.collect()} == {"p": "yes", "q": "no"}
    files = spark.createDataFrame([("r", "a/b/x.py", "1"), ("r", "a/y.py", "2"), ("r", "z.py", "3")], "repo_id string, path string, summary string")
    got = {r["directory"]: r["summary"] for r in runs.folded(files, lambda d, p: F.array_join(p, " | ")).collect()}
    assert got["a/b"] == "a/b/x.py: 1" and got["a"] == "a/b/: a/b/x.py: 1 | a/y.py: 2" and got[""].startswith("a/: ")
    failed = spark.createDataFrame([("g", "budget_exceeded", None, "x\nlast line")], "goal string, status string, result string, error string")
    assert "(budget_exceeded: last line)" in runs.with_fallback(failed).first()["answer"]


def test_stream(spark, tmp_path):
    from marlstone.streaming import incremental

    def put(at, content):
        spark.createDataFrame([("r", "a.py", 1, 1, content)], "repo_id string, path string, size long, mtime long, content binary").write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        incremental.watch(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "cp"), lambda df, _: seen.extend(r["status"] for r in df.collect())).awaitTermination()
        return seen

    assert put(0, b"x") == ["added"]
    assert put(1, b"x") == ["unchanged"]
    assert put(2, b"y") == ["changed"]


def test_contexts():
    assert reprs.context_of({"a": [1, (2,)]}) == "dict {'a': [1, (2,)]}"
    assert reprs.context_of([[[[[[[1]]]]]]]) == "list [[[[[[list(len=1)]]]]]]"
    assert reprs.context_of("x" * 1300).startswith("str str(len=1300) xxx")
    assert reprs.context_of(list(range(300))).endswith("199, ...]")


def test_command_line(spark, tmp_path, capsys):
    import json

    from marlstone import cli

    rows = [{"run_id": "a", "step": 1, "phase": "synthesis", "prompt": "p", "response": "x = 1", "llm_calls": 1}, {"run_id": "a", "step": 2, "phase": "synthesis", "prompt": "p", "response": "x = 2", "llm_calls": 1, "result": "{}"}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["replay", str(tmp_path / "log.json"), "--fail-on-nonfinished"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "finished"
    assert cli.main(["replay", str(tmp_path / "log.json"), "--max-steps", "1", "--fail-on-nonfinished"]) == 1


def test_phase_errors(spark):
    shape = ["Expected finish(value) to receive a dict with 'summary' key."]
    cases = [
        ("no json", shape, shape),
        (None, shape, shape),
        ('{"other": 1}', shape, shape),
        ('{"summary": 1}', shape, shape),
        ('{"summary": ""}', ["Expected 'summary' to include '## Major directories'."], ["Expected 'summary' to include '## Relationships'."]),
        ('{"summary": "## Major directories\\n## Relationships"}', [], ["Expected 'summary' to include a Mermaid diagram (```mermaid)."]),
        ('{"summary": "## Relationships ```mermaid"}', ["Expected 'summary' to include '## Major directories'."], []),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    got = rows.select("i", validate.phase1_errors(F.col("r")).alias("a"), validate.phase2_errors(F.col("r")).alias("b")).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == [c[1:] for c in cases]


def test_nested_results(spark):
    long = "A thorough account of the project and all of its parts."
    rows = [
        json.dumps({"summary": {"summary": "child", "documents": [{"path": "c.md"}]}, "other": [1, {"a": None}]}),
        json.dumps({"summary": {"summary": "child", "documents": [{"path": "c.md"}]}, "documents": [1]}),
        json.dumps({"summary": {"summary": 3}, "documents": None}),
        json.dumps({"summary": {"summary": "child", "documents": "none"}}),
        json.dumps({"summary": long + "\n## Relationships"}),
        "[1, 2]",
        "not json",
        None,
    ]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, r string").select("i", validate.normalised_result(F.col("r")).alias("n"))
    got = {r["i"]: r["n"] for r in frame.collect()}
    assert json.loads(got[0]) == {"summary": "child", "documents": [{"path": "c.md"}], "other": [1, {"a": None}]}
    assert json.loads(got[1]) == {"summary": "child", "documents": [1]}
    assert json.loads(got[2]) == {"summary": {"summary": 3}, "documents": None} and json.loads(got[3]) == {"summary": "child"}
    filled = json.loads(got[4])["summary"]
    assert filled.startswith(long) and "## Uncertainties\n\n- This section was not separated" in filled and filled.count("## Relationships") == 1
    assert got[5] == "[1, 2]" and got[6] == "not json" and got[7] is None


def test_json_files(spark):
    big = 2 * 1024 * 1024 + 1
    rows = [("config.json", 30, '{"key": "value", "num": 42}'), ("big.json", big, '{"x": 1}'), ("edge.json", big - 1, "[1]"), ("../outside.json", 3, "{}"), ("bad.json", 3, "{x"), ("none.json", 0, None), ("a/../b.json", 4, "null")]
    got = {r["path"]: r for r in documents.read_json_files(spark.createDataFrame(rows, "path string, size long, content string")).select("path", "error", F.to_json("value").alias("v")).collect()}
    assert json.loads(got["config.json"]["v"]) == {"key": "value", "num": 42} and got["edge.json"]["v"] == "[1]" and got["config.json"]["error"] is None
    assert got["big.json"]["error"] == f"read_json: file too large ({big} bytes > {big - 1} bytes limit)" and got["big.json"]["v"] is None
    assert "escapes root" in got["../outside.json"]["error"] and "not JSON" in got["bad.json"]["error"] and "not JSON" in got["none.json"]["error"]
    assert got["a/../b.json"]["error"] is None


def test_deep_folds(spark):
    """Directories of any depth are folded, each into the one above it."""
    deep = "/".join(f"d{i}" for i in range(12))
    rows = [("r", f"{deep}/x.py", "X"), ("r", "d0/y.py", "Y"), ("r", "z.py", "Z")]
    got = runs.folded(spark.createDataFrame(rows, "repo_id string, path string, summary string"), lambda directory, parts: F.array_join(parts, ";")).collect()
    found = {r["directory"]: r["summary"] for r in got}
    assert len(found) == 13 and found[deep] == f"{deep}/x.py: X" and found[""].endswith("z.py: Z") and found[""].count("X") == 1
    assert {r["depth"] for r in got} == set(range(13))
