"""Inventory of files and what is read from it: metadata, change status, directories, entrypoints, attention points, trees.

Frames of files have at least repo_id and path; the order of a scan is that of the path's parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import fixed, paths, text


def scan_order(path: Column) -> Column:
    """Sorts as a walk of the tree does: by parts, so that ``a/b`` comes before ``a-b``."""
    return paths.parts(path)


def with_order(files: DataFrame) -> DataFrame:
    """Add file_ord, which sorts a repository's files as the scan meets them. It is a key, not a rank: no row needs the others."""
    return files.withColumn("file_ord", scan_order(F.col("path")))


def scanned(files: DataFrame, patterns: list[str] = []) -> DataFrame:  # noqa: B006
    """Files that no built-in rule and no pattern leaves out."""
    path = F.col("path")
    return files.filter(~paths.ignored(path) & ~paths.matches_ignore_file(path, patterns))


def metadata(files: DataFrame) -> DataFrame:
    """Add language (unknown if none), kind, hash, todo_count from path and content."""
    path, content = F.col("path"), F.col("content")
    out = files.withColumns({"language": F.coalesce(paths.language(path), F.lit("unknown")), "kind": paths.kind(path), "hash": text.file_hash(content.cast("binary"), paths.is_binary(path))})
    counted = (F.col("kind") == "source") & ~paths.is_binary(path)
    return out.withColumn("todo_count", F.when(counted, F.coalesce(text.markers(content.cast("string")), F.lit(0))).otherwise(0))


def change_status(files: DataFrame, previous: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """Add status: unchanged or changed against ``previous`` (repo_id, path, hash), else what ``git`` (repo_id, path, status) says, else added.

    All hash sentinels compare equal, so a file that isn't read never changes.
    """
    spark = files.sparkSession
    previous = spark.createDataFrame([], "repo_id string, path string, hash string") if previous is None else previous
    git = spark.createDataFrame([], "repo_id string, path string, status string") if git is None else git
    before = previous.select("repo_id", "path", F.col("hash").alias("previous_hash"), F.lit(True).alias("known"))
    states = git.select("repo_id", "path", F.col("status").alias("git_status"))
    joined = files.join(before, ["repo_id", "path"], "left").join(states, ["repo_id", "path"], "left")
    status = F.when(F.col("known") & F.col("previous_hash").eqNullSafe(F.col("hash")), "unchanged").when(F.col("known"), "changed").otherwise(F.coalesce("git_status", F.lit("added")))
    return joined.withColumn("status", status).drop("previous_hash", "known", "git_status")


def directories(files: DataFrame) -> DataFrame:
    """repo_id, directory, files, languages (known ones, sorted)."""
    known = F.when(F.col("language") != "unknown", F.col("language"))
    return files.groupBy("repo_id", paths.directory(F.col("path")).alias("directory")).agg(F.count("*").alias("files"), F.array_sort(F.collect_set(known)).alias("languages"))


def tests(files: DataFrame) -> DataFrame:
    return files.filter("kind = 'test'").select("repo_id", "path").orderBy("repo_id", "path")


def entrypoints(files: DataFrame) -> DataFrame:
    """repo_id, file_ord, ord, entrypoint: assignments of pyproject.toml, bin and scripts of package.json (both at the root), and main files."""
    path, content = F.col("path"), F.col("content").cast("string")
    # Fixed value: an assignment of a name to a quoted target.
    pattern = r"([a-zA-Z0-9_\-]+)\s*=\s*['\"]([a-zA-Z0-9_\.\:]+)['\"]"
    names, wanted = F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    of_toml = F.zip_with(names, wanted, lambda n, t: F.concat(F.lit("pyproject.toml: "), n, F.lit(" -> "), t))
    pairs = lambda p: F.map_entries(F.from_json(F.get_json_object(content, p), "map<string,string>"))
    none = F.array().cast("array<string>")
    shown = lambda p, tag: F.coalesce(F.transform(pairs(p), lambda e: F.concat(F.lit(f"package.json: {tag}."), e["key"], F.lit(" -> "), e["value"])), none)
    single = F.get_json_object(content, "$.bin")
    of_bin = F.when(single.isNotNull() & ~single.startswith("{") & ~single.startswith("["), F.array(F.concat(F.lit("package.json: bin -> "), single))).otherwise(shown("$.bin", "bin"))
    of_json = F.concat(of_bin, shown("$.scripts", "script"))
    of_main = F.when(paths.name(path).isin(*fixed.MAIN_FILES), F.array(F.concat(F.lit("Detected main file: "), path))).otherwise(none)
    found = F.when(path == "pyproject.toml", of_toml).when(path == "package.json", of_json).otherwise(of_main)
    return files.select("repo_id", "file_ord", F.posexplode(found).alias("ord", "entrypoint"))


def internal_imports(symbols: DataFrame) -> DataFrame:
    """repo_id, path, module of each import that counts as internal, from rows (repo_id, path, imports)."""
    return symbols.select("repo_id", "path", F.explode("imports").alias("i")).filter("i.internal").select("repo_id", "path", F.col("i.module").alias("module"))


def fan_out(symbols: DataFrame) -> DataFrame:
    """repo_id, path, fan_out: internal import statements of each file, 0 if none."""
    counts = internal_imports(symbols).groupBy("repo_id", "path").agg(F.count("*").alias("fan_out"))
    return symbols.select("repo_id", "path").join(counts, ["repo_id", "path"], "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))


def fan_in(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, path, fan_in: internal import statements whose last part is the file's stem; files with none are left out."""
    wanted = internal_imports(symbols).groupBy("repo_id", F.element_at(F.split("module", r"\.", -1), -1).alias("stem")).agg(F.count("*").alias("fan_in"))
    named = files.select("repo_id", "path", paths.stem(F.col("path")).alias("stem"))
    return named.join(wanted, ["repo_id", "stem"]).select("repo_id", "path", "fan_in")


def untested(files: DataFrame) -> DataFrame:
    """Python sources of 50 bytes or more for which no file is called ``test_<stem>`` or ``<stem>_test``."""
    path = F.col("path")
    sources = files.filter((F.col("kind") == "source") & (F.col("language") == "python") & (paths.name(path) != "__init__.py") & (F.col("size") >= fixed.SMALL_BYTES)).withColumn("stem", paths.stem(path))
    base = paths.stem(path)
    covered = F.array_compact(F.array(F.when(base.startswith("test_"), F.right(base, F.length(base) - 5)), F.when(base.endswith("_test"), F.left(base, F.length(base) - 5))))
    tested = files.select("repo_id", F.explode(covered).alias("stem")).distinct()
    return sources.join(tested, ["repo_id", "stem"], "left_anti").drop("stem")


def marker_increase(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Sources with more marks than in ``previous`` (repo_id, path, todo_count), or with any if that has none to compare."""
    marked = files.filter((F.col("kind") == "source") & (F.col("todo_count") > 0))
    if previous is None:
        return marked
    before = previous.select("repo_id", "path", F.col("todo_count").alias("previous_count"))
    return marked.join(before, ["repo_id", "path"], "left").filter(F.col("todo_count") > F.coalesce("previous_count", F.lit(0))).drop("previous_count")


def attention(files: DataFrame, symbols: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """repo_id, rule_ord, file_ord, path, metric, message: large, untested, marks, fan-in, fan-out.

    ``files`` has file_ord, size, kind, language, todo_count and content. Many files may be imported alike, so the order of
    fan-in points is by the first import in the scan.
    """
    placed = files.select("repo_id", "path", "file_ord")

    def rule(at: int, rows: DataFrame, metric: Column, message: Column, order: str = "file_ord") -> DataFrame:
        return rows.select("repo_id", F.lit(at).alias("rule_ord"), F.col(order).alias("file_ord"), "path", metric.cast("long").alias("metric"), message.alias("message"))

    path, many = F.col("path"), F.col("metric")
    sources = files.filter((F.col("kind") == "source") & F.col("content").isNotNull()).withColumn("metric", text.lines_split(F.col("content").cast("string")))
    large = rule(1, sources.filter(many > fixed.LARGE_LINES), many, F.concat(F.lit("file is large: "), path, F.lit(", "), many.cast("string"), F.lit(" lines")))
    alone = rule(2, untested(files), F.lit(None), F.concat(F.lit("no tests found for "), path))
    todo = rule(3, marker_increase(files.filter(~paths.is_binary(path)), previous), F.col("todo_count"), F.concat(F.lit("TODO/FIXME count increased in "), path, F.lit(": "), F.col("todo_count").cast("string"), F.lit(" items")))
    first = symbols.join(placed, ["repo_id", "path"]).select("repo_id", "file_ord", F.posexplode("imports").alias("n", "i")).filter("i.internal")
    first = first.groupBy("repo_id", F.element_at(F.split("i.module", r"\.", -1), -1).alias("stem")).agg(F.min(F.struct("file_ord", "n")).alias("first"))
    heavy = fan_in(symbols, files).filter(F.col("fan_in") >= fixed.HIGH_FAN_IN).withColumn("stem", paths.stem(path)).join(first, ["repo_id", "stem"])
    # The place of an import follows its file's, so that points sort by file and import.
    heavy = heavy.withColumn("first", F.concat("first.file_ord", F.array(F.lpad(F.col("first.n").cast("string"), 9, "0"))))
    into = rule(4, heavy, F.col("fan_in"), F.concat(F.lit("high fan-in: "), path, F.lit(" imported by "), F.col("fan_in").cast("string"), F.lit(" files")), "first")
    outer = fan_out(symbols).filter(F.col("fan_out") >= fixed.HIGH_FAN_OUT).join(placed, ["repo_id", "path"])
    out = rule(5, outer, F.col("fan_out"), F.concat(F.lit("high fan-out: "), path, F.lit(" imports "), F.col("fan_out").cast("string"), F.lit(" internal modules")))
    return large.unionByName(alone).unionByName(todo).unionByName(into).unionByName(out)


def tree(files: DataFrame, max_depth: int = fixed.TREE_DEPTH, max_nodes: int = fixed.TREE_NODES) -> DataFrame:
    """repo_id, node_ord, path, node_type, category, truncated: files and directories down to a depth, in the order of a walk, capped.

    Directories are those above files; truncated tells whether the cap left nodes out.
    """
    kept = files.filter(~paths.ignored_in_tree(F.col("path")))
    steps = kept.select("repo_id", F.col("path").alias("file"), F.explode(F.slice(paths.prefixes(F.col("path")), 1, max_depth)).alias("path"))
    nodes = steps.groupBy("repo_id", "path").agg(F.bool_or(F.col("path") != F.col("file")).alias("is_directory"))
    order = Window.partitionBy("repo_id").orderBy(scan_order(F.col("path")))
    # Only the first rows of each task go on to the window.
    first = nodes.withColumn("node_ord", F.row_number().over(order)).filter(F.col("node_ord") <= max_nodes)
    whole = nodes.groupBy("repo_id").agg((F.count("*") > max_nodes).alias("truncated"))
    kind = F.when(F.col("is_directory"), "dir").otherwise("file").alias("node_type")
    return first.join(whole, "repo_id").select("repo_id", "node_ord", "path", kind, paths.category(F.col("path"), F.col("is_directory")).alias("category"), "truncated")


def worklist(files: DataFrame, max_files: int = fixed.WORKLIST_FILES) -> DataFrame:
    """repo_id, work_ord, path, truncated: the first sources in the order of a walk. truncated if any path follows the last, source or not."""
    path = F.col("path")
    wanted = ~paths.ignored_in_tree(path) & ~paths.is_binary(path) & paths.language(path).isNotNull()
    order = Window.partitionBy("repo_id").orderBy(scan_order(path))
    # Only the first rows of each task go on to the window.
    first = files.filter(wanted).select("repo_id", "path").withColumn("work_ord", F.row_number().over(order).cast("long")).filter(F.col("work_ord") <= max_files)
    end = files.groupBy("repo_id").agg(F.max(scan_order(path)).alias("end"))
    stop = first.filter(F.col("work_ord") == max_files).select("repo_id", scan_order(path).alias("stop"))
    ends = end.join(stop, "repo_id", "left").select("repo_id", F.coalesce(F.col("stop") < F.col("end"), F.lit(False)).alias("truncated"))
    return first.join(ends, "repo_id")


def children(files: DataFrame, at: str = "") -> DataFrame:
    """repo_id, name: distinct names directly below a directory (or artifact prefix), in order."""
    prefix = at.strip("/")
    prefix = "" if prefix in ("", ".") else prefix + "/"
    below = F.col("path").startswith(prefix) if prefix else F.lit(True)
    rest = F.right(F.col("path"), F.length("path") - len(prefix))
    return files.filter(below & (F.length("path") > len(prefix))).select("repo_id", F.substring_index(rest, "/", 1).alias("name")).distinct().orderBy("repo_id", "name")


def existing(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Add is_file, is_dir and exists to rows (repo_id, path)."""
    nodes = files.select("repo_id", F.explode(paths.prefixes(F.col("path"))).alias("path"), F.col("path").alias("file")).groupBy("repo_id", "path").agg(F.bool_or(F.col("path") == F.col("file")).alias("f"), F.bool_or(F.col("path") != F.col("file")).alias("d"))
    got = asked.join(nodes, ["repo_id", "path"], "left")
    root = F.col("path") == "."
    return got.withColumns({"is_file": F.coalesce("f", F.lit(False)), "is_dir": F.coalesce("d", F.lit(False)) | root}).withColumn("exists", F.col("is_file") | F.col("is_dir")).drop("f", "d")


def file_info(files: DataFrame) -> DataFrame:
    """Add exists, is_file, is_dir, size_bytes, line_count, char_count, approx_tokens, language, binary from path, size and content (text).

    Lines and characters are null for binary files and those over 2 MiB; tokens then come from the size.
    """
    path, content = F.col("path"), F.col("content")
    read = ~paths.is_binary(path) & (F.col("size") <= fixed.READ_BYTES)
    chars = F.when(read, F.length(content).cast("long"))
    return files.withColumns({"exists": F.lit(True), "is_file": F.lit(True), "is_dir": F.lit(False), "size_bytes": F.col("size"), "line_count": F.when(read, text.lines_by_break(content)), "char_count": chars, "approx_tokens": text.tokens_of_file(chars, F.col("size")), "language": paths.language(path), "binary": paths.is_binary(path)})
