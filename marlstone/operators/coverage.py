"""Sources against documents: coverage, missing, stale, extra and weak ones, and what needs an explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fixed, paths, validate


def targets(files: DataFrame) -> DataFrame:
    """Sources in a known language whose content was read."""
    return files.filter("kind = 'source' and language <> 'unknown' and hash not in ('binary_skipped', 'error')")


def source_files(files: DataFrame, output_dir: str | None = None) -> DataFrame:
    """Files that a document may be wanted for: known language, not binary, not ignored, not below the output folder."""
    path = F.col("path")
    kept = files.filter(~paths.ignored_source(path) & ~paths.is_binary(path) & paths.language(path).isNotNull())
    return kept.filter(~path.startswith(output_dir.strip("/") + "/")) if output_dir else kept


def _tried(sources: DataFrame, bare: bool) -> DataFrame:
    return sources.select("repo_id", "path", F.posexplode(paths.doc_candidates(F.col("path"), bare)).alias("place", "doc_path"))


def matched(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources with doc_path and doc_mtime of the first candidate that ``docs`` (repo_id, path, mtime in seconds) holds, or nulls."""
    have = docs.select("repo_id", F.col("path").alias("doc_path"), F.col("mtime").alias("doc_mtime"))
    best = _tried(sources, False).join(have, ["repo_id", "doc_path"]).groupBy("repo_id", "path").agg(F.min_by(F.struct("doc_path", "doc_mtime"), "place").alias("d"))
    return sources.join(best.select("repo_id", "path", "d.doc_path", "d.doc_mtime"), ["repo_id", "path"], "left")


def doc_state(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Targets with doc_state: missing, stale or valid.

    Stale: the source (mtime in whole seconds) is more than 2 seconds newer than its document, and isn't unchanged.
    """
    stale = (F.col("mtime") > F.col("doc_mtime") + fixed.STALE_SECONDS) & (F.col("status") != "unchanged")
    state = F.when(F.col("doc_path").isNull(), "missing").when(stale, "stale").otherwise("valid")
    return matched(targets(files), docs).withColumn("doc_state", state)


def summary(states: DataFrame) -> DataFrame:
    """repo_id, total, documented, missing, stale, percent, from rows with doc_state."""
    total, lacking = F.count("*"), F.count_if(F.col("doc_state") == "missing")
    return states.groupBy("repo_id").agg(total.alias("total"), (total - lacking).alias("documented"), lacking.alias("missing"), F.count_if(F.col("doc_state") == "stale").alias("stale"), ((total - lacking) / total * 100).alias("percent"))


def documented_paths(docs: DataFrame) -> DataFrame:
    """Distinct clean paths of documents, without the index."""
    clean = paths.without_dots(F.col("path"))
    return docs.select("repo_id", clean.alias("doc_path")).filter("doc_path not in ('', 'index.md')").distinct()


def documented(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources that one of their three candidates documents."""
    covered = _tried(sources, True).join(documented_paths(docs), ["repo_id", "doc_path"], "left_semi").select("repo_id", "path").distinct()
    return sources.join(covered, ["repo_id", "path"], "left_semi")


def missing(sources: DataFrame, docs: DataFrame) -> DataFrame:
    covered = _tried(sources, True).join(documented_paths(docs), ["repo_id", "doc_path"], "left_semi").select("repo_id", "path").distinct()
    return sources.join(covered, ["repo_id", "path"], "left_anti")


def extra(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that are no candidate of any source."""
    return documented_paths(docs).join(_tried(sources, True).select("repo_id", "doc_path"), ["repo_id", "doc_path"], "left_anti")


def weak(docs: DataFrame) -> DataFrame:
    """Documents other than the index that are short or tell of a failure."""
    clean = docs.withColumn("doc_path", paths.without_dots(F.col("path"))).filter("doc_path not in ('', 'index.md')")
    return clean.filter(validate.weak(F.col("content"))).select("repo_id", "doc_path")


def source_coverage(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each repository of ``sources``: total, documented, missing, extra, weak, percent (100.0 without sources)."""
    count = lambda x, name: x.groupBy("repo_id").agg(F.count("*").alias(name))
    repos = sources.select("repo_id").union(docs.select("repo_id")).distinct()
    out = repos
    for frame, name in ((sources, "total"), (documented(sources, docs), "documented"), (extra(sources, docs), "extra"), (weak(docs), "weak")):
        out = out.join(count(frame, name), "repo_id", "left")
    out = out.fillna(0, ["total", "documented", "extra", "weak"]).withColumn("missing", F.col("total") - F.col("documented"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.col("documented") / F.nullif("total", F.lit(0)) * 100)).select("repo_id", "total", "documented", "missing", "extra", "weak", "percent")


def needs_explanation(files: DataFrame, states: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """repo_id, pos, path, reason: sources that are changed, added, missing a document or stale; pos by the order of imports, others null.

    ``order``: repo_id, path, pos. Read it by pos, nulls last, then path.
    """
    changed = files.filter("status in ('changed', 'added') and kind = 'source' and language <> 'unknown'").select("repo_id", "path")
    lacking = states.filter("doc_state in ('missing', 'stale')").select("repo_id", "path")
    wanted = changed.union(lacking).distinct()
    rows = wanted.join(files.select("repo_id", "path", "status"), ["repo_id", "path"], "left").join(states.select("repo_id", "path", "doc_state"), ["repo_id", "path"], "left")
    reason = F.concat_ws(", ", F.when(F.col("doc_state") == "missing", "missing doc").when(F.col("doc_state") == "stale", "stale doc"), F.when(F.col("status").isin("changed", "added"), F.concat(F.lit("source "), F.col("status"))))
    rows = rows.withColumn("reason", reason).select("repo_id", "path", "reason")
    if order is None:
        return rows.withColumn("pos", F.lit(None).cast("long")).select("repo_id", "pos", "path", "reason")
    return rows.join(order.select("repo_id", "path", "pos"), ["repo_id", "path"], "left").select("repo_id", "pos", "path", "reason")
