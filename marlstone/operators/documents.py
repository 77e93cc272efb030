"""Generated documents: merging, names, relationships, artifacts, search, worker and fallback documents."""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import code, fixed, paths, reprs, text
from marlstone.operators.ordering import numbered
from marlstone.plans.scratch import cut


def merged(docs: DataFrame, order: list[str]) -> DataFrame:
    """Of rows (repo_id, path, title, content) with one path the last by ``order`` stands, at the place of the first. Adds place.

    Rows without a path, title or content are left out.
    """
    whole = docs.filter("path is not null and title is not null and content is not null")
    key = F.struct(*order)
    out = whole.groupBy("repo_id", "path").agg(F.max_by("title", key).alias("title"), F.max_by("content", key).alias("content"), F.min(key).alias("first"))
    return numbered(out, ["repo_id"], [F.col("first"), F.col("path")], "place", "merged").withColumn("place", (F.col("place") + 1).cast("int")).drop("first")


def overlaid(worker: DataFrame, result: DataFrame) -> DataFrame:
    """Worker documents with those of a result on top; rows have repo_id, path, title, content, ord."""
    both = worker.withColumn("layer", F.lit(0)).unionByName(result.withColumn("layer", F.lit(1)))
    return merged(both, ["layer", "ord"])


#: A stem up to this length keeps all of itself in every numbered name.
SHORT = 200
FAMILY = ["repo_id", "folder", "ext", "root"]


def distinct_names(docs: DataFrame) -> DataFrame:
    """repo_id, ord, path, out_path of rows (repo_id, ord, path): the safe path, with ``_1``, ``_2``... where an earlier row has the name.

    Names meet only where their stems are alike but for numbers at the end. Rows of a stem that meets no other get the number of
    their place, which takes no window. Where ``a`` and ``a_7`` both occur, the name ``a_7`` goes to whoever comes first; that is
    settled on the distinct names alone, each with the count of earlier rows of the other, and the rows then skip the numbers that were
    taken. Stems of over 200 characters lose some to their number, so such rows of one stem go to one task. ord isn't null; rows of one ord stand by path.
    """
    safe, base, stem = paths.safe_path(F.col("path")), F.col("base"), F.col("stem")
    split = lambda rows: (
        rows.withColumn("base", F.regexp_extract("safe", r"([^/]*)\z", 1))
        .withColumn("folder", F.left("safe", F.length("safe") - F.length(base)))
        .withColumn("ext", F.regexp_extract(base, r"(?s).(\.[^.]*)\z", 1))
        .withColumn("stem", F.left(base, F.length(base) - F.length("ext")))
        .withColumn("root", F.regexp_replace(F.left(stem, F.lit(SHORT)), r"(_[0-9]*)+\z", ""))
    )
    named = split(docs.select("repo_id", "ord", "path", safe.alias("safe")))
    # The report's own name is taken before the first row.
    report = named.filter("folder = '' and root = 'analysis_report'").select("repo_id").distinct()
    none = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in ("ord", "path")]
    rows = cut(named.unionByName(split(report.select("repo_id", *none, F.lit("analysis_report.md").alias("safe")))), "names")
    met = cut(rows.groupBy(*FAMILY).agg((F.min("safe") != F.max("safe")).alias("tied"), (F.max(F.length("stem")) > SHORT).alias("long")).filter("tied or long"), "names-met")
    order = [F.col("ord"), F.col("path")]
    ranked = numbered(rows.join(met.filter("long"), FAMILY, "left_anti"), ["repo_id", "safe"], order, "k", "names-ranked")
    if met.filter("not long").isEmpty():
        placed = ranked.withColumn("at", F.col("k"))
    else:
        tied = cut(ranked.join(met.filter("not long"), FAMILY, "left_semi"), "names-tied")
        placed = ranked.join(met, FAMILY, "left_anti").withColumn("at", F.col("k")).unionByName(_skipping(tied, _taken(tied, order)))
    number = F.when(F.col("at") > 0, F.concat(F.lit("_"), F.col("at").cast("string"))).otherwise("")
    short = placed.filter("ord is not null").select("repo_id", "ord", "path", F.concat("folder", "stem", number, "ext").alias("out_path"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    cramped = rows.join(met.filter("long"), FAMILY, "left_semi").select("repo_id", "ord", "path", "folder", "stem", "ext", "root")
    long = cramped.groupBy(*FAMILY).applyInPandas(_cramped, f"repo_id {kinds['repo_id']}, ord {kinds['ord']}, path string, out_path string")
    return short.unionByName(long)


def _taken(tied: DataFrame, order: list[Column]) -> DataFrame:
    """repo_id, safe, taken: the sorted numbers (0: the bare name) that another stem has when the rows of ``safe`` come to them."""
    first = F.min(F.struct("ord", "path")).alias("first")
    own = tied.groupBy(*FAMILY, "safe", "stem").agg(first).select("*", "first.ord", "first.path").drop("first")
    shape = r"(?s)\A(.*)_([1-9][0-9]{0,17})\z"
    parent = F.when(F.col("stem").rlike(shape), F.concat("folder", F.regexp_extract("stem", shape, 1), "ext"))
    own = cut(own.withColumns({"parent": parent, "number": F.try_to_number(F.regexp_extract("stem", shape, 2), F.lit("9" * 18)).cast("long")}), "names-own")
    asks = own.filter("parent is not null").select("repo_id", F.col("parent").alias("safe"), "ord", "path", F.col("safe").alias("child"))
    # Of rows and questions in one order, a question's place less the questions before it is the count of rows before it.
    asks = numbered(asks, ["repo_id", "safe"], [*order, F.col("child")], "turn", "names-asks")
    both = tied.select("repo_id", "safe", "ord", "path", F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("turn")).unionByName(asks)
    found = numbered(both, ["repo_id", "safe"], [*order, F.col("child")], "place", "names-asked").filter("child is not null")
    before = found.select("repo_id", F.col("child").alias("safe"), "turn", (F.col("place") - F.col("turn")).alias("rows_before"))
    kind = tied.schema["repo_id"].dataType.simpleString()
    return own.join(before, ["repo_id", "safe"], "left").groupBy(*FAMILY).applyInPandas(_settled, f"repo_id {kind}, safe string, taken array<bigint>")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Who has the names that two stems may take; a row for each distinct name, the shorter stem settled first."""
    asking: dict[str, list[tuple[int, int, int, str]]] = {}
    for r in pdf[pdf["turn"].notna()].itertuples():
        asking.setdefault(r.parent, []).append((int(r.turn), int(r.rows_before), int(r.number), r.safe))
    late: set[str] = set()
    out = []
    for safe in sorted(pdf["safe"], key=len):
        taken = [0] if safe in late else []
        ahead, up_to, rows = taken[:], 0, 0
        for _, before, number, child in sorted(asking.get(safe, [])):
            left, rows = before - rows, before
            while ahead and ahead[0] < up_to + left:
                left -= ahead[0] - up_to
                up_to = heapq.heappop(ahead) + 1
            up_to += left
            if number < up_to:
                late.add(child)
            else:
                taken.append(number)
                heapq.heappush(ahead, number)
        out.append((safe, sorted(taken)))
    return pd.DataFrame(out, columns=["safe", "taken"]).assign(repo_id=pdf["repo_id"].iloc[0])[["repo_id", "safe", "taken"]]


def _skipping(tied: DataFrame, taken: DataFrame) -> DataFrame:
    """``tied`` with ``at``, the k-th number that isn't taken: k and the taken numbers that come before it."""
    skipped = taken.select("repo_id", "safe", F.posexplode("taken").alias("m", "number")).select("repo_id", "safe", (F.col("number") - F.col("m")).alias("k"))
    both = tied.withColumn("own", F.lit(1)).unionByName(skipped.withColumn("own", F.lit(0)), allowMissingColumns=True)
    return numbered(both, ["repo_id", "safe"], [F.col("k"), F.col("own")], "at", "names-skipping").filter("own = 1").drop("own")


def _cramped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Names one after the other, where stems are cut so that a name has 255 characters at most."""
    taken: set[str] = set()
    out, pdf = [], pdf.sort_values(["ord", "path"])
    for folder, stem, ext in zip(pdf["folder"], pdf["stem"], pdf["ext"], strict=True):
        fit = lambda tail, s=stem, e=ext: s[: max(1, fixed.NAME_CHARS - len(e) - len(tail))] + tail + e
        names = (folder + (fit(f"_{n}") if n else fit("")) for n in itertools.count())
        out.append(next(n for n in names if n not in taken))
        taken.add(out[-1])
    return pdf.assign(out_path=out)[["repo_id", "ord", "path", "out_path"]]


def numbered_names(docs: DataFrame, order: str) -> DataFrame:
    """The same where no name looks like one with a number: the n-th row of a path gets ``_n-1``, in any number of tasks."""
    n = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(order)) - 1
    path, tail = F.col("path"), paths.suffix(F.col("path"))
    return docs.withColumn("n", n).withColumn("out_path", F.when(F.col("n") == 0, path).otherwise(F.concat(F.left(path, F.length(path) - F.length(tail)), F.lit("_"), F.col("n").cast("string"), tail))).drop("n")


def relationships(docs: DataFrame) -> DataFrame:
    """repo_id, source, ord, target, statement of each bullet below ``## Dependencies`` in rows (repo_id, path, content)."""
    source = F.regexp_replace("path", r"\.md\z", "")
    rows = docs.select("repo_id", source.alias("source"), F.posexplode(text.dependency_statements(F.col("content"))).alias("ord", "statement"))
    return rows.withColumn("target", text.dependency_target(F.col("statement"))).select("repo_id", "source", "ord", "target", "statement")


def artifacts(docs: DataFrame) -> DataFrame:
    """repo_id, path, content: a file for each document, manifest.json and relationships.json.

    ``docs``: repo_id, ord, path, title, content. The two JSON files hold a line for each document and statement of a
    repository, without contents.
    """
    own = docs.select("repo_id", F.concat(F.lit("source-docs/"), "path").alias("path"), "content")
    entry = F.struct(F.concat(F.lit("source-docs/"), "path").alias("artifact_path"), F.col("path").alias("document_path"), "title", F.length("content").alias("content_chars"))
    ordered = lambda item, *keys: F.transform(F.array_sort(F.collect_list(F.struct(*keys, item.alias("x")))), lambda e: e["x"])
    manifest = docs.groupBy("repo_id").agg(F.to_json(F.struct(ordered(entry, "ord").alias("documents"), F.lit("relationships.json").alias("relationships_artifact"))).alias("content"))
    links = relationships(docs).join(docs.select("repo_id", F.regexp_replace("path", r"\.md\z", "").alias("source"), F.col("ord").alias("doc_ord")), ["repo_id", "source"])
    all_links = docs.select("repo_id").distinct().join(links.groupBy("repo_id").agg(ordered(F.struct("source", "target", "statement"), "doc_ord", "ord").alias("relationships")), "repo_id", "left")
    related = all_links.select("repo_id", F.to_json(F.struct(F.coalesce("relationships", F.array()).alias("relationships"))).alias("content"))
    named = lambda x, name: x.select("repo_id", F.lit(name).alias("path"), "content")
    return own.unionByName(named(manifest, "manifest.json")).unionByName(named(related, "relationships.json"))


def grep(artifacts_: DataFrame, pattern: str, most: int = 10, context: int = 160) -> DataFrame:
    """The first ``most`` (50 at most) hits of a literal in any case over all rows (path, content), by path and offset."""
    most = max(0, min(most, fixed.MOST_HITS))
    hits = artifacts_.filter(F.contains(F.lower("content"), F.lit(pattern.lower()))).select("path", F.explode(text.hits(F.col("content"), pattern, most, context)).alias("h"))
    return hits.select("path", F.col("h.offset").alias("offset"), F.col("h.match").alias("match"), F.col("h.excerpt").alias("excerpt")).orderBy("path", "offset").limit(most)


def read_slice(artifacts_: DataFrame, path: str, offset: int = 0, limit: int = fixed.READ_CHARS) -> DataFrame:
    """path and a slice of its content."""
    return artifacts_.filter(F.col("path") == paths.artifact_path(F.lit(path))).select("path", text.piece(F.col("content"), offset, limit).alias("slice"))


def read_json(artifacts_: DataFrame, path: str) -> DataFrame:
    """path and its content as a variant."""
    return artifacts_.filter(F.col("path") == paths.artifact_path(F.lit(path))).select("path", F.parse_json("content").alias("value"))


def read_json_files(files: DataFrame, helper: str = "read_json", root_name: str = "") -> DataFrame:
    """Add value (a variant) and error to rows (path, size, content as text): one of both is null.

    Files over 2 MiB aren't parsed, and paths that lead out of the root aren't read. Null content is no JSON.
    """
    size = F.col("size")
    limit = f" bytes > {fixed.READ_BYTES} bytes limit)"
    outside = F.when(paths.within_root(F.col("path"), root_name).isNull(), F.concat(F.lit("path escapes root: "), F.col("path")))
    large = F.when(size > fixed.READ_BYTES, F.concat(F.lit(f"{helper}: file too large ("), size.cast("string"), F.lit(limit)))
    value = F.when(F.coalesce(outside, large).isNull(), F.try_parse_json("content"))
    error = F.coalesce(outside, large, F.when(value.isNull(), F.concat(F.lit(f"{helper}: not JSON: "), F.col("path"))))
    return files.withColumns({"value": value, "error": error})


def _block(lines: list[Column | str]) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _or(lines: Column, otherwise: str) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(otherwise)


def worker_documents(files: DataFrame) -> DataFrame:
    """repo_id, path, title, content: a document for each source from its symbols, imports and first 1,200 characters.

    ``files``: repo_id, path, content (text). Fixed values: headings and sentences of the document.
    """
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    rows = files.select("repo_id", "path", content.alias("content"), F.coalesce(paths.language(path), F.lit("unknown")).alias("language"))
    rows = rows.withColumn("symbols", text.symbol_lines(code.snippets_of(12)("content", "language"))).withColumn("needs", text.dependency_lines(F.col("content"), F.col("language")))
    body = _block([
        F.concat(F.lit("# Analysis of "), path), "", "## Responsibility", "",
        F.concat(F.lit("`"), path, F.lit("` is a `"), F.col("language"), F.lit("` source file with "), text.lines_by_break(F.col("content")).cast("string"), F.lit(" lines. This deterministic worker document summarizes the file from static metadata, detected symbols, and a bounded source excerpt.")),
        "", "## Main Functions / Classes", "", _or(F.col("symbols"), "- No functions or classes were detected by the static symbol extractor."), "", "## Inputs and Outputs", "",
        "- Inputs: values accepted by the detected functions/classes or module-level configuration visible in the source excerpt.",
        "- Outputs: return values, side effects, CLI behavior, tests, or exported definitions implied by the detected symbols.",
        "", "## Dependencies", "", _or(F.col("needs"), "- No import/include dependency lines were detected in the bounded scan."), "", "## Caveats", "",
        "- This file-level document is generated by a deterministic worker, not by the RLM controller.",
        "- Nuanced behavior beyond the static symbols and excerpt should be verified against the source when this file is critical.",
        "", "## Excerpt", "", "```", F.left("content", F.lit(1200)), "```", "",
    ])
    return rows.select("repo_id", F.concat(path, F.lit(".md")).alias("path"), F.concat(F.lit("Analysis of "), path).alias("title"), body.alias("content"))


def fallback_documents(files: DataFrame) -> DataFrame:
    """The same for sources that no document covers, with fewer symbols and no imports. Headings and sentences."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    rows = files.select("repo_id", "path", content.alias("content"), F.coalesce(paths.language(path), F.lit("unknown")).alias("language"))
    rows = rows.withColumn("symbols", text.symbol_lines(code.snippets_of(8)("content", "language")))
    body = _block([
        F.concat(F.lit("# Source: "), path), "", "## File Summary", "", F.concat(F.lit("- Path: `"), path, F.lit("`")), F.concat(F.lit("- Language: `"), F.col("language"), F.lit("`")),
        F.concat(F.lit("- Lines: "), text.lines_split(F.col("content")).cast("string")), "",
        "This fallback document was generated because the controller did not return a document mapped to this source file.",
        "", "## Detected Symbols", "", _or(F.col("symbols"), "- (none detected)"), "", "## Excerpt", "", "```", F.left("content", F.lit(1200)), "```", "",
    ])
    return rows.select("repo_id", F.concat(path, F.lit(".md")).alias("path"), F.concat(F.lit("Source: "), path).alias("title"), body.alias("content"))


def child_fallback(goal: Column, status: Column, error: Column, context: Column | None = None) -> Column:
    """The text that stands for a child query that failed. Its sentences.

    ``context``: what the child was given, as JSON. An object under ``file``, else the context itself if it is an object, is a
    card of a file: path, info, symbols, reasons and excerpt. Malformed JSON, null and other values are no card.
    """
    detail = F.concat(status, F.lit(": "), text.last_line(error))
    head = F.lit("## Child Query Fallback")
    bare = _block([head, "", F.concat(F.lit("The child query could not complete ("), detail, F.lit("). No file card was provided, so only the parent-visible context is available.")), "", "## Focus", "", text.capped(F.coalesce(goal, F.lit("")), 500)])
    if context is None:
        return bare
    whole = F.try_parse_json(context)
    at = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    is_ = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))
    card = F.when(is_(at(whole, "$.file"), "OBJECT"), at(whole, "$.file")).when(is_(whole, "OBJECT"), whole)
    said = lambda path: F.when(is_(at(card, path), "STRING"), at(card, path, "string"))
    some = lambda path: F.nullif(at(card, path, "string"), F.lit(""))
    shown = lambda path: F.coalesce(at(card, path, "string"), F.lit("None"))
    path = F.coalesce(some("$.path"), some("$.info.path"), F.lit("unknown"))
    reasons = F.coalesce(F.nullif(F.array_join(at(card, "$.reasons", "array<string>"), ", "), F.lit("")), F.lit("not recorded"))
    symbols = F.coalesce(reprs.literals()(F.to_json(at(card, "$.symbols.symbols"))), F.lit("None"))
    excerpt = F.coalesce(said("$.excerpt"), said("$.symbols.fallback_excerpt"), F.lit(""))
    full = _block([
        head, "", F.concat(F.lit("The deep-dive child query for `"), path, F.lit("` could not complete ("), detail, F.lit("). This document is a mechanical fallback built from the file card so the parent can continue.")),
        "", "## Responsibility", "", F.concat(F.lit("File-card-only responsibility estimate for `"), path, F.lit("` based on language, size, symbols, and excerpt.")),
        "", "## Main Elements", "", F.concat(F.lit("- Language: "), shown("$.info.language")), F.concat(F.lit("- Lines: "), shown("$.info.line_count")),
        F.concat(F.lit("- Selection reasons: "), reasons), F.concat(F.lit("- Symbols: "), text.capped(symbols, 800)),
        "", "## Inputs and Outputs", "", "Inputs and outputs were not model-expanded because the child query failed; infer them from the listed symbols and excerpt.",
        "", "## Dependencies and Caveats", "", "This fallback is less reliable than a completed deep dive and should be reviewed if the file is critical.",
        "", "## Excerpt", "", "```", text.capped(excerpt, 1200), "```",
    ])
    return F.when(card.isNull(), bare).otherwise(full)


def step_history(steps: DataFrame) -> DataFrame:
    """run_id, step, line: a row of the history table for each step (run_id, step, kind, stdout, error, result)."""
    said = text.cell(F.left(text.observation(F.col("error"), F.col("stdout"), F.col("result")), F.lit(100)))
    ok = F.when(F.coalesce(F.col("error"), F.lit("")) == "", "OK").otherwise("ERR")
    return steps.select("run_id", "step", F.concat(F.lit("| "), F.col("step").cast("string"), F.lit(" | "), "kind", F.lit(" | "), ok, F.lit(" | "), said, F.lit(" |")).alias("line"))
