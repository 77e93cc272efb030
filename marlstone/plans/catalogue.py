"""The queries over the driver's tables, each beside the same in DuckDB's SQL.

The tables hold no repository, so one is made of ``documents`` in both engines: a document's id gives directory, stem and
suffix, its text the content, its id the time. These repositories are synthetic; fixtures of real trees are in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import fixed, paths, text, validate
from marlstone.operators import budget, coverage, documents, graph, inventory
from marlstone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from marlstone.plans.scratch import cut
from marlstone.sources.tables import table

DIRS = ("src", "tests", "docs", ".github", "lib", "node_modules", "app")
SUFFIXES = (".py", ".js", ".ts", ".go", ".rs", ".java", ".md", ".txt", ".yaml", ".json", ".png")


def pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, doc_id, path, out_path, content, mtime, size, from documents."""
    d = table(spark, sf_dir, "documents")
    n, name = F.col("doc_id"), F.col("doc_id").cast("string")
    folder, ext = pick(DIRS, n % 7), pick(SUFFIXES, n % 11)
    # Files called main lie in a folder of their own, so that no two paths are alike.
    stem = (
        F.when(n % 5 == 0, F.concat(F.lit("test_m"), name))
        .when(n % 5 == 1, F.concat(F.lit("m"), name, F.lit("_test")))
        .when(n % 5 == 2, F.concat(F.lit("helper_m"), name))
        .when(n % 5 == 3, F.concat(F.lit("m"), name, F.lit("/main")))
        .otherwise(F.concat(F.lit("m"), name))
    )
    return d.select(
        F.lit("corpus").alias("repo_id"),
        "doc_id",
        F.concat(folder, F.lit("/"), "source", F.lit("/"), stem, ext).alias("path"),
        F.concat(folder, F.lit("/main"), ext).alias("out_path"),
        F.col("text").alias("content"),
        n.alias("mtime"),
        F.octet_length("text").cast("long").alias("size"),
    )


def sql_list(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LANGUAGE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in fixed.LANGUAGES.items())
#: files(doc_id, path, out_path, content, mtime, size, name, stem, suffix, dir, language, kind, binary)
FILES = f"""
    base AS (
        SELECT doc_id, text AS content, doc_id AS mtime, CAST(strlen(text) AS BIGINT) AS size,
            list_extract([{sql_list(DIRS)}], CAST(doc_id % 7 + 1 AS INTEGER)) AS folder, source,
            list_extract([{sql_list(SUFFIXES)}], CAST(doc_id % 11 + 1 AS INTEGER)) AS ext,
            CASE doc_id % 5 WHEN 0 THEN 'test_m' || doc_id WHEN 1 THEN 'm' || doc_id || '_test' WHEN 2 THEN 'helper_m' || doc_id
                WHEN 3 THEN 'main' ELSE 'm' || doc_id END AS stem, CASE doc_id % 5 WHEN 3 THEN '/m' || doc_id ELSE '' END AS inner_dir
        FROM documents),
    known(suffix, language) AS (VALUES {LANGUAGE_ROWS}),
    files AS (
        SELECT 'corpus' AS repo_id, doc_id, folder || '/' || source || inner_dir || '/' || stem || ext AS path, folder || '/main' || ext AS out_path,
            content, mtime, size, stem || ext AS name, stem, ext AS suffix, folder, source, inner_dir, folder || '/' || source || inner_dir AS dir, coalesce(known.language, 'unknown') AS language,
            ext = '.png' AS bin,
            CASE WHEN folder IN ('tests', 'test') OR folder LIKE 'test\\_%' ESCAPE '\\' OR source LIKE 'test\\_%' ESCAPE '\\'
                    OR ((starts_with(stem, 'test_') OR ends_with(stem, '_test')) AND NOT regexp_matches(stem, 'helper|util|fixture|mock|stub')) THEN 'test'
                WHEN folder = '.github' OR ext IN ('.yaml', '.json') THEN 'config'
                WHEN folder = 'docs' OR ext IN ('.md', '.txt') THEN 'doc'
                WHEN ext = '.png' THEN 'other' ELSE 'source' END AS kind
        FROM base LEFT JOIN known ON base.ext = known.suffix)"""


@query(f"""WITH {FILES}
    SELECT dir AS directory, count(*) AS files, coalesce(string_agg(DISTINCT CASE WHEN language <> 'unknown' THEN language END, ',' ORDER BY CASE WHEN language <> 'unknown' THEN language END), '') AS languages
    FROM files WHERE folder <> 'node_modules' GROUP BY dir""")
def q_dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory.metadata(inventory.scanned(corpus_files(spark, sf_dir)))
    return inventory.directories(files).select("directory", "files", F.array_join("languages", ",").alias("languages"))


@query(f"WITH {FILES} SELECT kind, count(*) AS files FROM files GROUP BY kind")
def q_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(spark, sf_dir).groupBy(paths.kind(F.col("path")).alias("kind")).agg(F.count("*").alias("files"))


@query(f'WITH {FILES} SELECT path, language, bin AS "binary" FROM files')
def q_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus_files(spark, sf_dir).select("path", F.coalesce(paths.language(p), F.lit("unknown")).alias("language"), paths.is_binary(p).alias("binary"))


PATTERNS = ["docs/", "*.txt", "/lib/src1/*", "# a comment", "!kept.txt", "main.?s"]


@query(f"""WITH {FILES}
    SELECT path FROM files WHERE folder <> 'node_modules' AND folder <> 'docs' AND NOT ends_with(path, '.txt')
      AND NOT starts_with(path, 'lib/src1/') AND NOT regexp_matches(name, '^main\\..s$')""")
def q_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.scanned(corpus_files(spark, sf_dir), PATTERNS).select("path")


@query(f"""WITH {FILES},
    nodes AS (SELECT DISTINCT path, true AS leaf, name FROM files UNION SELECT DISTINCT folder || '/' || source, false, source FROM files
        UNION SELECT DISTINCT dir, false, substr(inner_dir, 2) FROM files WHERE inner_dir <> '' UNION SELECT DISTINCT folder, false, folder FROM files)
    SELECT path, CASE WHEN leaf THEN CASE
            WHEN regexp_matches(name, '\\.(py|js|ts|go|rs|java)$') THEN CASE WHEN contains(name, 'test') THEN 'test' ELSE 'code' END
            WHEN regexp_matches(name, '\\.(md|txt)$') THEN 'doc' WHEN regexp_matches(name, '\\.(yaml|json)$') THEN 'config' ELSE 'unknown' END
        ELSE CASE WHEN name IN ('src', 'lib', 'app') THEN 'code' WHEN name = 'tests' THEN 'test' WHEN name = 'docs' THEN 'doc' WHEN name = '.github' THEN 'config' ELSE 'unknown' END END AS category
    FROM nodes""")
def q_node_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = corpus_files(spark, sf_dir).select(F.col("path").alias("file"), F.explode(paths.prefixes(F.col("path"))).alias("path"))
    nodes = steps.groupBy("path").agg(F.bool_or(F.col("file") != F.col("path")).alias("is_directory"))
    return nodes.select("path", paths.category(F.col("path"), F.col("is_directory")).alias("category"))


@query(f"""WITH {FILES},
    nodes AS (SELECT DISTINCT folder AS path FROM files WHERE folder <> 'node_modules' UNION SELECT DISTINCT folder || '/' || source FROM files WHERE folder <> 'node_modules'),
    placed AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS n, count(*) OVER () AS total FROM nodes)
    SELECT CAST(n AS INTEGER) AS node_ord, path, 'dir' AS node_type,
        CASE path WHEN 'src' THEN 'code' WHEN 'lib' THEN 'code' WHEN 'app' THEN 'code' WHEN 'tests' THEN 'test' WHEN 'docs' THEN 'doc' WHEN '.github' THEN 'config' ELSE 'unknown' END AS category,
        total > {fixed.TREE_NODES} AS truncated
    FROM placed WHERE n <= {fixed.TREE_NODES}""")
def q_repo_tree_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.tree(corpus_files(spark, sf_dir), 2, fixed.TREE_NODES).drop("repo_id")


@query(f"WITH {FILES} SELECT DISTINCT source AS name FROM files WHERE folder = 'src'")
def q_list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.children(corpus_files(spark, sf_dir), "src").select("name")


@query(f"""WITH {FILES},
    wanted AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '/'), doc_id) AS n FROM files WHERE folder <> 'node_modules' AND language <> 'unknown' AND NOT bin)
    SELECT CAST(n AS BIGINT) AS work_ord, path FROM wanted WHERE n <= {fixed.WORKLIST_FILES}""")
def q_source_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.worklist(corpus_files(spark, sf_dir), fixed.WORKLIST_FILES).select("work_ord", "path")


@query(f"WITH {FILES} SELECT path, CASE WHEN bin THEN 'binary_skipped' ELSE sha256(content) END AS hash FROM files")
def q_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.metadata(corpus_files(spark, sf_dir)).select("path", "hash")


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(f"""WITH {FILES}
    SELECT path, size AS size_bytes, CAST(CASE WHEN bin THEN -1 WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS BIGINT) AS line_count,
        CASE WHEN bin THEN -1 ELSE CAST(length(content) AS BIGINT) END AS char_count,
        CAST(ceil((CASE WHEN bin THEN size ELSE length(content) END) / 4) AS BIGINT) AS approx_tokens,
        nullif(language, 'unknown') AS language, bin AS "binary" FROM files""")
def q_file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return inventory.file_info(corpus_files(spark, sf_dir)).select("path", "size_bytes", absent("line_count"), absent("char_count"), "approx_tokens", "language", "binary")


SEARCH = "licen"


@query(f"""WITH cuts AS (SELECT doc_id, text, generate_subscripts(string_split(lower(text), '{SEARCH}'), 1) AS n, unnest(string_split(lower(text), '{SEARCH}')) AS part FROM documents WHERE contains(lower(text), '{SEARCH}')),
    places AS (SELECT doc_id, text, n, count(*) OVER (PARTITION BY doc_id) AS parts, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n) + (n - 1) * {len(SEARCH)} AS o FROM cuts)
    SELECT doc_id, CAST(o AS INTEGER) AS "offset", CAST(o - length(replace(substr(text, 1, CAST(o AS BIGINT)), chr(10), '')) + 1 AS INTEGER) AS line,
        substr(text, CAST(o AS BIGINT) + 1, {len(SEARCH)}) AS match FROM places WHERE n < parts AND n <= 10""")
def q_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.lower("text").contains(SEARCH))
    return rows.select("doc_id", F.explode(text.hits(F.col("text"), SEARCH)).alias("h")).select("doc_id", "h.offset", "h.line", "h.match")


@query(f"""WITH {FILES}, cuts AS (SELECT path, content, generate_subscripts(string_split(lower(content), '{SEARCH}'), 1) AS n, unnest(string_split(lower(content), '{SEARCH}')) AS part FROM files WHERE contains(lower(content), '{SEARCH}')),
    places AS (SELECT path, content, n, count(*) OVER (PARTITION BY path, content) AS parts, sum(length(part)) OVER (PARTITION BY path, content ORDER BY n) + (n - 1) * {len(SEARCH)} AS o FROM cuts)
    SELECT path, CAST(o AS INTEGER) AS "offset", substr(content, CAST(o AS BIGINT) + 1, {len(SEARCH)}) AS match,
        substr(content, CAST(greatest(0, o - 40) AS BIGINT) + 1, CAST(o + {len(SEARCH)} + 40 - greatest(0, o - 40) AS BIGINT)) AS excerpt
    FROM places WHERE n < parts ORDER BY path, o LIMIT 20""")
def q_grep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.grep(corpus_files(spark, sf_dir), SEARCH, 20, 40)


@query(f"WITH {FILES} SELECT path, substr(content, 101, 50) AS slice, CASE WHEN bin THEN '{fixed.BINARY_NOTICE}' ELSE substr(content, 1, 200) END AS head FROM files")
def q_text_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = F.col("content"), F.col("path")
    return corpus_files(spark, sf_dir).select("path", text.piece(c, 100, 50).alias("slice"), text.excerpt(c, paths.is_binary(p), 200).alias("head"))


def previous_of(files: DataFrame) -> DataFrame:
    """An earlier state: every third file unknown, every fourth of the others with another hash and one mark more."""
    other = F.col("doc_id") % 4 == 1
    return files.filter("doc_id % 3 <> 0").withColumns({"hash": F.when(other, F.concat(F.lit("x"), F.substring("hash", 2, 63))).otherwise(F.col("hash")), "todo_count": F.when(other, F.col("todo_count") + 1).otherwise(F.greatest(F.col("todo_count") - 1, F.lit(0)))})


@query(f"""WITH {FILES}
    SELECT path, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'deleted' ELSE 'added' END WHEN doc_id % 4 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM files""")
def q_change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory.metadata(corpus_files(spark, sf_dir))
    git = files.filter("doc_id % 2 = 0").select("repo_id", "path", F.lit("deleted").alias("status"))
    return inventory.change_status(files, previous_of(files), git).select("path", "status")


@query(f"""WITH {FILES}, counted AS (SELECT path, doc_id, CAST(len(regexp_extract_all(content, '(?i)licen[sc]e')) AS INTEGER) AS n FROM files WHERE kind = 'source')
    SELECT path, n AS todo_count FROM counted WHERE n > 0 AND n > CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN n + 1 ELSE greatest(n - 1, 0) END""")
def q_marker_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).withColumns({"kind": paths.kind(F.col("path")), "hash": F.lit("x" * 64), "todo_count": F.regexp_count("content", F.lit("(?i)licen[sc]e")).cast("int")})
    return inventory.marker_increase(files, previous_of(files)).select("path", "todo_count")


@query(f"""WITH {FILES}, counted AS (SELECT path, kind, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS n FROM files)
    SELECT path, CAST(n AS BIGINT) AS lines FROM counted WHERE kind = 'source' AND n > 20""")
def q_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).filter(paths.kind(F.col("path")) == "source")
    return files.select("path", text.lines_by_break(F.col("content")).alias("lines")).filter("lines > 20")


@query(f"""WITH {FILES}, tested AS (SELECT DISTINCT substr(stem, 6) AS s FROM files WHERE starts_with(stem, 'test_') UNION SELECT DISTINCT substr(stem, 1, length(stem) - 5) FROM files WHERE ends_with(stem, '_test'))
    SELECT path FROM files WHERE kind = 'source' AND language = 'python' AND size >= 50 AND stem NOT IN (SELECT s FROM tested)""")
def q_untested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.untested(inventory.metadata(corpus_files(spark, sf_dir))).select("path")


#: docs: documents of the labelled sources, half by the one name and half by the other, and some of no source.
DOCS = """
    docs AS (
        SELECT CASE doc_id % 3 WHEN 0 THEN path || '.md' WHEN 1 THEN substr(path, 1, length(path) - length(suffix)) || '.md' ELSE 'notes/' || doc_id || '.md' END AS path,
            mtime + (doc_id % 9 - 4) AS mtime, content
        FROM files JOIN labels USING (doc_id))"""


def docs_of(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    n, p = F.col("doc_id"), F.col("path")
    where = F.when(n % 3 == 0, F.concat(p, F.lit(".md"))).when(n % 3 == 1, paths.with_suffix(p, ".md")).otherwise(F.concat(F.lit("notes/"), n.cast("string"), F.lit(".md")))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return files.join(labels, "doc_id").select("repo_id", where.alias("path"), (F.col("mtime") + (n % 9 - 4)).alias("mtime"), "content")


COVERED = f"""WITH {FILES}, {DOCS},
    sources AS (SELECT * FROM files WHERE folder <> 'node_modules' AND language <> 'unknown' AND NOT bin),
    clean AS (SELECT DISTINCT ltrim(path, './') AS path FROM docs),
    tried AS (SELECT path, path AS c FROM sources UNION ALL SELECT path, path || '.md' FROM sources UNION ALL SELECT path, substr(path, 1, length(path) - length(suffix)) || '.md' FROM sources),
    covered AS (SELECT DISTINCT path FROM tried WHERE c IN (SELECT path FROM clean)),
    extra AS (SELECT path FROM clean WHERE path NOT IN (SELECT c FROM tried))"""


@query(f"""{COVERED}
    SELECT s.n AS total, d.n AS documented, s.n - d.n AS missing, e.n AS extra, w.n AS weak, d.n / s.n * 100 AS percent
    FROM (SELECT count(*) AS n FROM sources) s, (SELECT count(*) AS n FROM sources WHERE path IN (SELECT path FROM covered)) d, (SELECT count(*) AS n FROM extra) e,
        (SELECT count(*) AS n FROM docs WHERE length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) < 40) w""")
def q_doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    return coverage.source_coverage(coverage.source_files(files), docs_of(spark, sf_dir, files)).drop("repo_id")


@query(f"{COVERED} SELECT path FROM sources WHERE path NOT IN (SELECT path FROM covered)")
def q_missing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    return coverage.missing(coverage.source_files(files), docs_of(spark, sf_dir, files)).select("path")


@query(f"{COVERED} SELECT path AS doc_path FROM extra")
def q_extra_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    return coverage.extra(coverage.source_files(files), docs_of(spark, sf_dir, files)).select("doc_path")


@query("SELECT doc_id FROM documents WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) < 40 OR regexp_matches(lower(text), 'analysis failed|failed to analyze|model_error|budget_exceeded|invalid analysis result')")
def q_weak_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(validate.weak(F.col("text"))).select("doc_id")


STATES = f"""WITH {FILES}, {DOCS},
    targets AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' ELSE 'added' END AS status FROM files WHERE kind = 'source' AND language <> 'unknown' AND NOT bin),
    tried AS (SELECT path, path || '.md' AS c, 0 AS place FROM targets UNION ALL SELECT path, substr(path, 1, length(path) - length(suffix)) || '.md', 1 FROM targets),
    best AS (SELECT tried.path, arg_min(docs.mtime, place) AS doc_mtime FROM tried JOIN docs ON tried.c = docs.path GROUP BY tried.path),
    states AS (
        SELECT targets.*, CASE WHEN doc_mtime IS NULL THEN 'missing' WHEN targets.mtime > doc_mtime + 2.0 AND status <> 'unchanged' THEN 'stale' ELSE 'valid' END AS doc_state
        FROM targets LEFT JOIN best USING (path))"""


def states_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = inventory.metadata(corpus_files(spark, sf_dir))
    n = F.col("doc_id") % 4
    files = files.withColumn("status", F.when(n == 0, "unchanged").when(n == 1, "changed").otherwise("added"))
    return files, coverage.doc_state(files, docs_of(spark, sf_dir, corpus_files(spark, sf_dir)))


@query(f"{STATES} SELECT path, doc_state FROM states")
def q_stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states_of(spark, sf_dir)[1].select("path", "doc_state")


@query(f"""{STATES}
    SELECT path, concat_ws(', ', CASE doc_state WHEN 'missing' THEN 'missing doc' WHEN 'stale' THEN 'stale doc' END, CASE WHEN status <> 'unchanged' THEN 'source ' || status END) AS reason
    FROM states WHERE status <> 'unchanged' OR doc_state <> 'valid'""")
def q_needs_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.needs_explanation(*states_of(spark, sf_dir)).select("path", "reason")


def symbols_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their imports, all of them internal."""
    imports, nodes = imports_of(spark, sf_dir)
    found = imports.groupBy("repo_id", "path").agg(F.collect_list(F.struct("module", F.lit(True).alias("internal"))).alias("imports"))
    none = F.array().cast("array<struct<module:string,internal:boolean>>")
    return nodes.select("repo_id", "path").join(found, ["repo_id", "path"], "left").withColumn("imports", F.coalesce("imports", none))


@query("""WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
    SELECT target, count(*) AS fan_in FROM links GROUP BY target HAVING count(*) >= 10""")
def q_link_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("fan_in")).filter(F.col("fan_in") >= fixed.HIGH_FAN_IN)


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]+)\"')) AS INTEGER) AS fan_out FROM pages")
def q_link_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit('href="([^"]+)"')).cast("int").alias("fan_out"))


#: nodes and imports: sources with ids from 1; u imports the modules of u / 2 and u / 3, by name or by a name below it.
IMPORTS = f"""
    nodes AS (SELECT path, doc_id, replace(substr(path, 1, length(path) - length(suffix)), '/', '.') AS dotted FROM files WHERE kind = 'source' AND language <> 'unknown'),
    everyone AS (SELECT doc_id, replace(substr(path, 1, length(path) - length(suffix)), '/', '.') AS dotted FROM files),
    imports AS (
        SELECT f.path, 0 AS import_ord, e.dotted AS module FROM nodes f JOIN everyone e ON e.doc_id = f.doc_id // 2 WHERE f.doc_id > 0 AND NOT starts_with(e.dotted, '.')
        UNION ALL
        SELECT f.path, 1, e.dotted || '.part' FROM nodes f JOIN everyone e ON e.doc_id = f.doc_id // 3 WHERE f.doc_id > 2 AND NOT starts_with(e.dotted, '.'))"""
RESOLVED = f"""WITH {FILES}, {IMPORTS},
    placed AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS file_ord FROM nodes),
    resolved AS (
        SELECT i.path, i.import_ord, i.module, arg_min(n.path, n.file_ord) AS target
        FROM imports i JOIN placed n ON n.dotted = i.module OR starts_with(i.module, n.dotted || '.') GROUP BY ALL)"""


def imports_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = inventory.metadata(corpus_files(spark, sf_dir))
    nodes = graph.graph_nodes(files)
    names = files.select(F.col("doc_id").alias("to_id"), paths.dotted(F.col("path")).alias("name")).filter("name not like '.%'")

    def of(least: int, place: int, divisor: int, tail: str) -> DataFrame:
        """Imports of the files from an id on: the module of the id divided by a number."""
        asked = nodes.filter(F.col("doc_id") >= least).select("repo_id", "path", F.lit(place).alias("import_ord"), F.expr(f"doc_id div {divisor}").alias("to_id"))
        return asked.join(names, "to_id").select("repo_id", "path", "import_ord", F.concat("name", F.lit(tail)).alias("module"))

    return of(1, 0, 2, "").unionByName(of(3, 1, 3, ".part")), nodes


@query(f"WITH {FILES}, {IMPORTS} SELECT nodes.path, count(imports.path) AS fan_out FROM nodes LEFT JOIN imports ON nodes.path = imports.path GROUP BY nodes.path")
def q_import_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.fan_out(symbols_of(spark, sf_dir)).select("path", "fan_out")


@query(f"""WITH {FILES}, {IMPORTS}, wanted AS (SELECT regexp_extract(module, '[^.]+$') AS stem, count(*) AS fan_in FROM imports GROUP BY 1)
    SELECT path, fan_in FROM files JOIN wanted ON files.stem = wanted.stem""")
def q_import_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.fan_in(symbols_of(spark, sf_dir), corpus_files(spark, sf_dir)).select("path", "fan_in")


@query(f"{RESOLVED} SELECT i.path, i.import_ord, i.module, r.target FROM imports i LEFT JOIN resolved r ON i.path = r.path AND i.import_ord = r.import_ord")
def q_resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(*imports_of(spark, sf_dir)).select("path", "import_ord", "module", "target")


EDGES = f"""{RESOLVED},
    edges AS (SELECT path AS src, target AS dst, min(import_ord) AS first_ord FROM resolved WHERE target <> path GROUP BY path, target)"""


@query(f"{EDGES} SELECT src, dst, first_ord FROM edges")
def q_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(*imports_of(spark, sf_dir)).select("src", "dst", "first_ord")


@query(f"{EDGES} SELECT dst AS path, count(*) AS in_degree FROM edges GROUP BY dst")
def q_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(graph.edges(*imports_of(spark, sf_dir))).select("path", "in_degree")


@query(f"""{EDGES.replace("WITH", "WITH RECURSIVE", 1)},
    hops AS (
        SELECT src AS start, src AS path, 0 AS hops FROM (SELECT DISTINCT src FROM edges)
        UNION
        SELECT start, dst, hops + 1 FROM hops JOIN edges ON hops.path = edges.src WHERE hops < 4)
    SELECT start, path, CAST(min(hops) AS INTEGER) AS hops FROM hops GROUP BY start, path""")
def q_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(graph.edges(*imports_of(spark, sf_dir)), "edges")
    return graph.reachable(edges, edges.select("repo_id", F.col("src").alias("path")).distinct(), 4).select("start", "path", "hops")


@query(None)
def q_topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports, nodes = imports_of(spark, sf_dir)
    return graph.dependency_order(graph.edges(imports, nodes), nodes).select("pos", "path")


#: Turns as steps: those of a conversation are a run, the text is the prompt and an eighth of it the answer.
TURNS = """
    turns AS (
        SELECT conv_id AS run_id, turn AS step, CASE role WHEN 'system' THEN 'worker' ELSE 'synthesis' END AS phase,
            greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS prompt_tokens, greatest(1, CAST(ceil((length(text) // 8) / 4) AS BIGINT)) AS response_tokens
        FROM conversations),
    summed AS (
        SELECT *, prompt_tokens + response_tokens AS tokens,
            CAST(sum(CASE WHEN phase = 'worker' THEN 0 ELSE prompt_tokens + response_tokens END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS local_total,
            CAST(sum(prompt_tokens + response_tokens) OVER (PARTITION BY run_id, phase ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS phase_total
        FROM turns)"""


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.when(F.col("role") == "system", "worker").otherwise("synthesis").alias("phase"), t.alias("prompt"), F.left(t, F.floor(F.length(t) / 8).cast("int")).alias("response"), F.lit(1).alias("llm_calls"))


@query(f"WITH {TURNS} SELECT run_id, step, prompt_tokens, response_tokens, local_total, phase_total FROM summed")
def q_budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.running(steps_of(spark, sf_dir)).select("run_id", "step", "prompt_tokens", "response_tokens", "local_total", "phase_total")


LIMITS = budget.Limits(max_steps=6, max_local_tokens=400, max_synthesis_tokens=500, max_worker_tokens=60, max_total_tokens=600)


@query(f"""WITH {TURNS},
    judged AS (
        SELECT *, CASE WHEN phase <> 'worker' AND local_total - tokens + prompt_tokens > 400 THEN 'Local' WHEN phase <> 'worker' AND phase_total - tokens + prompt_tokens > 500 THEN 'Synthesis'
            WHEN phase <> 'worker' AND local_total - tokens + prompt_tokens > 600 THEN 'Global' WHEN phase <> 'worker' AND local_total > 400 THEN 'Local'
            WHEN phase = 'worker' AND phase_total > 60 THEN 'Worker' WHEN phase <> 'worker' AND phase_total > 500 THEN 'Synthesis' WHEN local_total > 600 THEN 'Global' END AS broken
        FROM summed),
    placed AS (
        SELECT *, min(CASE WHEN broken IS NOT NULL THEN step END) OVER (PARTITION BY run_id) AS first_broken, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n, count(*) OVER (PARTITION BY run_id) AS total
        FROM judged)
    SELECT run_id, step, broken AS scope, CASE WHEN broken IS NOT NULL THEN 'model_error' ELSE 'ok' END AS kind,
        CASE WHEN first_broken IS NOT NULL OR total > 6 THEN 'budget_exceeded' ELSE 'finished' END AS run_status
    FROM placed WHERE n <= 6 AND (first_broken IS NULL OR step <= first_broken)""")
def q_budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = budget.cut_off(budget.violations(budget.running(steps_of(spark, sf_dir)), LIMITS), LIMITS)
    return got.select("run_id", "step", F.when(F.col("violation").isNotNull(), F.regexp_extract("violation", r"^\[(\w+) ", 1)).alias("scope"), "kind", "run_status")


@query(f"""WITH {TURNS}
    SELECT run_id, CAST(coalesce(sum(tokens) FILTER (phase <> 'worker'), 0) AS BIGINT) AS local_tokens, CAST(coalesce(sum(tokens) FILTER (phase = 'worker'), 0) AS BIGINT) AS worker_tokens,
        count(*) FILTER (phase = 'worker') AS worker_llm_calls, count(*) AS global_llm_calls FROM summed GROUP BY run_id""")
def q_budget_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.totals(steps_of(spark, sf_dir)).select("run_id", "local_tokens", "worker_tokens", "worker_llm_calls", "global_llm_calls")


@query(f"""WITH {FILES}, kept AS (SELECT out_path AS path, arg_max(content, doc_id) AS content, min(doc_id) AS first FROM files GROUP BY out_path)
    SELECT path, md5(content) AS content_md5, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM kept""")
def q_doc_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_files(spark, sf_dir).select("repo_id", F.col("out_path").alias("path"), F.lit("t").alias("title"), "content", "doc_id")
    return documents.merged(rows, ["doc_id"]).select("path", F.md5(F.col("content").cast("binary")).alias("content_md5"), "place")


@query(f"""WITH {FILES}, n AS (SELECT doc_id, out_path, suffix, row_number() OVER (PARTITION BY out_path ORDER BY doc_id) - 1 AS k FROM files)
    SELECT doc_id, CASE WHEN k = 0 THEN out_path ELSE substr(out_path, 1, length(out_path) - length(suffix)) || '_' || k || suffix END AS out_path FROM n""")
def q_collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_files(spark, sf_dir).select("repo_id", "doc_id", F.col("out_path").alias("path"))
    return documents.numbered_names(rows, "doc_id").select("doc_id", "out_path")


@query(f"""WITH {FILES}, n AS (SELECT doc_id, CASE suffix WHEN '.md' THEN out_path ELSE out_path || '.md' END AS p, row_number() OVER (PARTITION BY out_path ORDER BY doc_id) - 1 AS k FROM files)
    SELECT doc_id, CASE WHEN k = 0 THEN p ELSE substr(p, 1, length(p) - 3) || '_' || k || '.md' END AS out_path FROM n""")
def q_collision_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_files(spark, sf_dir).select("repo_id", F.col("doc_id").alias("ord"), F.col("out_path").alias("path"))
    return documents.distinct_names(rows).select(F.col("ord").alias("doc_id"), "out_path")


@query("""SELECT user_id AS run_id, event_id AS step, '| ' || event_id || ' | ' || event_type || ' | ' || CASE event_type WHEN 'error' THEN 'ERR' ELSE 'OK' END || ' | '
        || substr(replace(props, '|', '&#124;'), 1, 100) || ' |' AS line FROM events""")
def q_step_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    steps = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("kind"), F.when(~bad, F.col("props")).alias("stdout"), F.when(bad, F.col("props")).alias("error"), F.lit(None).cast("string").alias("result"))
    return documents.step_history(steps)


@query(f"WITH {FILES} SELECT path FROM files WHERE kind = 'test'")
def q_test_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.tests(inventory.metadata(corpus_files(spark, sf_dir))).select("path")


@query(f"WITH {FILES} SELECT 'Detected main file: ' || path AS entrypoint FROM files WHERE name IN ('main.py', 'main.go')")
def q_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.entrypoints(inventory.with_order(corpus_files(spark, sf_dir))).select("entrypoint")


@query(f"""WITH {FILES} SELECT path || '.md' AS path, CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' THEN 0 ELSE 1 END AS BIGINT) AS lines, substr(content, 1, 1200) AS excerpt
    FROM files WHERE kind = 'source' AND language NOT IN ('unknown')""")
def q_worker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = graph.graph_nodes(inventory.metadata(corpus_files(spark, sf_dir)))
    docs = documents.worker_documents(files)
    excerpt = F.regexp_extract("content", r"(?s)\n## Excerpt\n\n```\n(.*)\n```\n$", 1)
    return docs.select("path", F.regexp_extract("content", r"with (\d+) lines\.", 1).cast("long").alias("lines"), excerpt.alias("excerpt"))
