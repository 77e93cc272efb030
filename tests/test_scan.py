"""A small repository, scanned from disk, against what it is known to give."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, inventory
from marlstone.plans import render, scan, sections
from marlstone.sources import tree

FILES = {
    ".github/workflows/deploy.yml": "name: deploy",
    "Dockerfile": "FROM python:3.9",
    "pyproject.toml": "[project]\nname = 'a b'\n[project.scripts]\ntest-cli = 'src.runner:main'\n",
    "src/__init__.py": "",
    "src/config.py": "class Config:\n    value = 1\n    other = 2\n    # padding padding pad\n",
    "src/conftest.py": "# Test fixtures",
    "src/legacy.py": "\n".join(f"line_{i} = {i}" for i in range(350)),
    "src/runner.py": "import os\nimport sys\nfrom src.config import Config\n\nclass Runner:\n    def __init__(self):\n        pass\n\n    def run(self):\n        # TODO: finish this\n        pass\n\ndef main():\n    pass\n",
    "src/settings.yaml": "debug: false",
    "tests/test_runner.py": "import unittest\nfrom src.runner import Runner\n",
}


def lay(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    lay(root, FILES)
    (root / "link.py").symlink_to(root / "src/runner.py")
    lay(root, {"node_modules/x.js": "x", "pkg.egg-info/a": "b"})
    out = tmp_path_factory.mktemp("out")
    return scan.scan(spark, str(root), str(out)), root, out


def column(frame, name, order):
    return [r[name] for r in frame.orderBy(order).collect()]


def test_files_and_kinds(got):
    rows = {r["path"]: r["kind"] for r in got[0].files.collect()}
    assert list(FILES) == column(got[0].files, "path", "file_ord")
    config = {".github/workflows/deploy.yml", "Dockerfile", "pyproject.toml", "src/__init__.py", "src/conftest.py", "src/settings.yaml"}
    assert rows == {p: "config" if p in config else "test" if p.startswith("tests/") else "source" for p in FILES}


def test_symbols_imports_exports(got):
    r = got[0].symbols.filter("path = 'src/runner.py'").first()
    assert [(s["name"], s["kind"], s["line"]) for s in r["symbols"]] == [("Runner", "class", 5), ("Runner.__init__", "method", 6), ("Runner.run", "method", 9), ("main", "function", 13)]
    assert [(i["module"], i["internal"]) for i in r["imports"]] == [("os", False), ("sys", False), ("src.config", True)]
    assert r["exports"] == ["Runner", "main"]


def test_directories_entrypoints_attention(got):
    dirs = {r["directory"]: (r["files"], r["languages"]) for r in got[0].directories.collect()}
    assert dirs == {".github/workflows": (1, []), "./": (2, []), "src": (6, ["python"]), "tests": (1, ["python"])}
    assert column(got[0].entrypoints, "entrypoint", "ord") == ["pyproject.toml: test-cli -> src.runner:main"]
    points = [r["message"] for r in got[0].attention.orderBy("rule_ord", "file_ord").collect()]
    assert points == ["file is large: src/legacy.py, 350 lines", "no tests found for src/config.py", "no tests found for src/legacy.py", "TODO/FIXME count increased in src/runner.py: 1 items"]


def test_graph_and_coverage(got):
    assert [(r["src"], r["dst"]) for r in got[0].edges.collect()] == [("src/runner.py", "src/config.py")]
    assert column(got[0].order, "path", "pos") == ["src/config.py", "src/legacy.py", "src/runner.py"]
    assert {r["doc_state"] for r in got[0].doc_states.collect()} == {"missing"}


def test_reports(got):
    out = got[2]
    data = json.loads((out / "machine_analysis.json").read_text())
    assert data["dependency_order"] == ["src/config.py", "src/legacy.py", "src/runner.py"] and len(data["files"]) == 10
    assert 'node_1["src/runner.py"]' in (out / "machine_report.md").read_text()
    assert "- Coverage: 0.0%" in (out / "analysis_report.md").read_text()
    assert "- [ ] `src/config.py` (missing doc, source added)" in (out / "index.md").read_text()
    assert "  - src/config.py" in (out / "machine_analysis.yaml").read_text()


def plain(data):
    """Nested sections as plain data."""
    return {k: plain(v) for k, v in data.items()} if isinstance(data, dict) else dict(data) if data.key else list(data.items())


def test_reports_are_the_sections_item_by_item(got):
    made, out = got[0], got[2]
    found, targets = sections.read(out)
    data = plain(render.nested(found))
    assert (out / "machine_analysis.json").read_text() == json.dumps(data, ensure_ascii=False, indent=2)
    assert (out / "machine_analysis.yaml").read_text() == render.yaml(data)
    assert [f["path"] for f in data["files"]] == [s["path"] for s in data["symbols"]] == list(FILES)
    assert list(data["dependency_graph"]) == [p for p in FILES if p in data["dependency_graph"]]
    assert list(data["repo_map"]["directories"]) == [".github/workflows", "./", "src", "tests"] and data["repo_map"]["entrypoints"][0] == "pyproject.toml: test-cli -> src.runner:main"
    assert data["attention"] == [r["message"] for r in made.attention.orderBy("rule_ord", "file_ord", "path").collect()]
    assert data["dependency_graph"]["src/runner.py"] == ["src/config.py"] and targets == found["missing_docs"].rows == made.doc_states.count()
    # Rows in number, parts and lines agree.
    assert all(s.rows == sum(1 for _ in s) for s in found.values())


def test_sections_of_several_parts_stay_in_order(tmp_path):
    some = [{"message": f"m{i} \u2028 ü \n"} for i in range(7)]
    for name, rows in (("part-00000.json", some[:3]), ("part-00001.json", []), ("part-00002.json", some[3:])):
        (tmp_path / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    parts = sorted(p.name for p in tmp_path.glob("part-*"))
    listed = sections.Section(tmp_path, 7, parts, lambda r: r["message"])
    none = sections.Section(tmp_path, 0, [], dict, "path")
    data = {"a": listed, "b": {"c": none, "d": sections.Section(tmp_path, 0, [])}}
    assert list(listed.items()) == [r["message"] for r in some]
    assert json.loads("".join(render.json_pieces(data))) == plain(data)
    assert "".join(render.json_pieces(data)) == json.dumps(plain(data), ensure_ascii=False, indent=2)
    assert "\n".join(render.yaml_lines(data)) == render.yaml(plain(data))


def test_second_scan_and_stale_documents(spark, got):
    _, root, out = got
    now = os.stat(root / "src/config.py").st_mtime
    for name, shift in (("src/runner.py.md", 10), ("src/config.md", -10)):
        lay(out, {name: "text"})
        os.utime(out / name, (now + shift, now + shift))
    (root / "src/config.py").write_text(FILES["src/config.py"] + "# more\n")
    again = scan.scan(spark, str(root), str(out))
    status = {r["path"]: r["status"] for r in again.files.collect()}
    assert status["src/config.py"] == "changed" and status["src/runner.py"] == "unchanged"
    assert {r["path"]: r["doc_state"] for r in again.doc_states.collect()} == {"src/config.py": "stale", "src/legacy.py": "missing", "src/runner.py": "valid"}
    assert "TODO" not in " ".join(r["message"] for r in again.attention.collect())


def test_ignore_file(spark):
    rows = [("r", p) for p in ("src/keep_me.py", "a.pyc", "tmp/x", "x/tmp/y", ".pytest_cache/v", "root.txt", "sub/root.txt")]
    files = spark.createDataFrame(rows, "repo_id string, path string")
    left = inventory.scanned(files, ["*.pyc", "tmp/", "!a.pyc", "# no", "/root.txt"])
    assert {r["path"] for r in left.collect()} == {"src/keep_me.py", "sub/root.txt"}


def test_cycle_comes_last(spark):
    nodes = spark.createDataFrame([("r", x) for x in ("a", "b", "c", "d", "e")], "repo_id string, path string")
    edges = spark.createDataFrame([("r", "b", "a"), ("r", "c", "d"), ("r", "d", "c"), ("r", "e", "c")], "repo_id string, src string, dst string")
    assert column(graph.dependency_order(edges, nodes), "path", "pos") == ["a", "b", "c", "d", "e"]
    assert {r["path"] for r in graph.cycles(edges, nodes).collect()} == {"c", "d"}


@pytest.mark.parametrize("seed", range(1))
def test_random_graphs(spark, seed):
    """Order, connected parts, cycles and ways around of random graphs of two repositories against plain Python."""
    draw = random.Random(seed)
    nodes, pairs = [], []
    for r, (n, m) in (("r", (40, 34)), ("s", (25, 40))):
        names = [f"{draw.choice('abc')}/{i:02d}" for i in range(n)]
        nodes += [(r, x) for x in names]
        pairs += sorted({(r, *draw.sample(names, 2)) for _ in range(m)})
    edges = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "repo_id string, src string, dst string, first_ord int")
    frame = spark.createDataFrame(nodes, "repo_id string, path string")
    ordered, ringed = graph.dependency_order(edges, frame).collect(), graph.cycles(edges, frame).collect()
    ways = graph.cycle_paths(edges).collect()
    for r in "rs":
        own = [(a, b) for x, a, b in pairs if x == r]
        want = graph.order_of([p for x, p in nodes if x == r], [(b, a) for a, b in own])
        assert [x["path"] for x in sorted((x for x in ordered if x["repo_id"] == r), key=lambda x: x["pos"])] == want
        reach = {p: set() for x, p in nodes if x == r}
        for _ in reach:
            for a, b in own:
                reach[a] |= {b} | reach[b]
        groups = {p: min(q for q in reach[p] if p in reach[q]) for p in reach if p in reach[p]}
        assert {x["path"]: x["cycle"] for x in ringed if x["repo_id"] == r} == groups
        found = [x["cycle"] for x in ways if x["repo_id"] == r]
        assert all(c[0] == c[-1] and len(set(c)) == len(c) - 1 and set(zip(c, c[1:])) <= set(own) for c in found)
        assert {groups[c[0]] for c in found} == set(groups.values()) and len(set(map(tuple, found))) == len(found)


def test_counts(got):
    """What the scan has met and left out, counted by the pass that reads the files."""
    counts = got[0].counts.get
    assert counts["total"] - counts["ignored"] == len(FILES) and counts["ignored"] >= 0


def test_no_edges(spark):
    nodes = spark.createDataFrame([("r", "b"), ("r", "a")], "repo_id string, path string")
    none = spark.createDataFrame([], "repo_id string, src string, dst string, first_ord int")
    assert column(graph.dependency_order(none, nodes), "path", "pos") == ["a", "b"]
    assert graph.cycles(none, nodes).count() == graph.cycle_paths(none).count() == 0


def test_large_graph_is_a_notice():
    assert graph.diagram([str(i) for i in range(58)], []).startswith("```text") and "Total files: 58" in graph.diagram([str(i) for i in range(58)], [])


def test_order_respects_every_edge(spark):
    nodes = [f"n{i:02d}" for i in range(40)]
    pairs = [(nodes[i // 2], nodes[i]) for i in range(1, 40)] + [(nodes[i // 3], nodes[i]) for i in range(3, 40)]
    order = {n: i for i, n in enumerate(graph.order_of(nodes, sorted(set(pairs))))}
    assert all(order[a] < order[b] for a, b in pairs) and len(order) == 40


def test_tree_is_capped_and_skips(spark):
    rows = [("r", p) for p in ("src/pkg/deep.py", "node_modules/x.js", "build/y", "uv.lock", "README.md", "src/a.py")]
    files = spark.createDataFrame(rows, "repo_id string, path string")
    assert column(inventory.tree(files, 2, 500), "path", "node_ord") == ["README.md", "src", "src/a.py", "src/pkg"]
    capped = inventory.tree(files, 1, 1).collect()
    assert len(capped) == 1 and capped[0]["truncated"]


def test_reader_gives_hidden_files_and_no_links(spark, got):
    rows = tree.read_tree(spark, str(got[1]))
    names = {r["path"] for r in rows.select("path").collect()}
    assert ".github/workflows/deploy.yml" in names and "link.py" not in names
    assert rows.filter(F.col("path") == "Dockerfile").first()["content"] == b"FROM python:3.9"


def wide_tree(root):
    """A tree of many depths and its files, as a plain walk meets them."""
    rng = random.Random(3)
    folders = [""]
    for i in range(60):
        folders.append(f"{rng.choice(folders)}/d{i}".lstrip("/"))
    files = {f"{rng.choice(folders)}/f{i}.{rng.choice(['py', 'png', 'txt'])}".lstrip("/"): "x" * rng.randrange(200) for i in range(150)}
    lay(root, files)
    lay(root, {"a/node_modules/x.py": "x", "b/c.egg-info/y": "y"})
    (root / "empty").mkdir()
    (root / "loop").symlink_to(root)
    return files


@pytest.mark.parametrize("dirs_each", [1, 4, 500])
def test_listing_in_rounds_is_the_walk(spark, tmp_path, dirs_each):
    files = wide_tree(tmp_path)
    rows = tree.listing(spark, str(tmp_path), str(tmp_path / "nowhere"), dirs_each=dirs_each).collect()
    assert {r["path"]: r["size"] for r in rows} == {p: len(c) for p, c in files.items()} and len(rows) == len(files)
    assert {r["repo_id"] for r in rows} == {tmp_path.name}


def test_contents_of_wanted_files_alone(spark, tmp_path):
    files = wide_tree(tmp_path)
    (tmp_path / "bad.txt").write_text("never opened")
    (tmp_path / "bad.txt").chmod(0)
    rows = {r["path"]: r["content"] for r in tree.read_tree(spark, str(tmp_path), content=F.col("size") < 100).collect()}
    assert rows == {p: c.encode() if len(c) < 100 and not p.endswith(".png") else None for p, c in files.items()} | {"bad.txt": rows["bad.txt"]}
    assert all(r["content"] is None for r in tree.read_tree(spark, str(tmp_path), content=False).collect())


@pytest.mark.parametrize("splits", [1, 8, 1000])
def test_source_tests_pushed_filters_before_it_reads(spark, tmp_path, splits):
    files = wide_tree(tmp_path)
    tree.register(spark)
    all_rows = spark.read.format("repo_files").option("splits", splits).load(str(tmp_path))
    assert {r["path"] for r in all_rows.collect()} == set(files)
    some = all_rows.filter("path like '%.py' and size < 100 and length(content) > 10")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "length(content" in plan.split("BatchScan")[0] and "EndsWith" not in plan.split("BatchScan")[0] and "(size" not in plan.split("BatchScan")[0]
    assert {r["path"] for r in some.collect()} == {p for p, c in files.items() if p.endswith(".py") and 10 < len(c) < 100}
    # A file that the filter leaves out isn't opened.
    reader = tree.TreeReader({"path": str(tmp_path), "content": "true"})
    opened, old = [], tree.contents
    list(reader.pushFilters([tree.LessThan(("size",), 100), tree.StringEndsWith(("path",), ".py")]))
    try:
        tree.contents = lambda root, path: opened.append(path)
        for part in reader.partitions():
            list(reader.read(part))
    finally:
        tree.contents = old
    assert sorted(opened) == sorted(p for p, c in files.items() if p.endswith(".py") and len(c) < 100)
