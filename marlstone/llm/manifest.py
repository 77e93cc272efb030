"""Merkle manifest of a dataset: a tree of digests over the rows of each part, and one over the parts.

Nodes live in tables outside of memory: sorted runs of leaves make level 0, and each level is written by reading the one before once,
every node with the digests of its up to eight children. Proofs come from the top down: a level's paths, joined by coordinate
to its nodes, give those of the level below, so a join moves an eighth of the rows below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.words import must_be_free
from marlstone.plans.scratch import cut, free

FAN = 8
#: A step of a proof: digests of the siblings before and after a node, each in one text.
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of some texts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value that can't run into its neighbours: ``-`` for null, else its bytes in UTF-8, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, part: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 on within their part in ``order``, and ``n``, how many rows the part has.

    A range exchange by part and order makes sorted runs, so that a part of any size is spread over tasks; rows that are alike
    in all of it are spread by a hash of their place. The run's own counts, added up, give each its first place.
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    runs = rows.withColumn("_salt", salt).repartitionByRange(F.col(part), *order, F.col("_salt"))
    runs = cut(runs.sortWithinPartitions(F.col(part), *order, "_salt").drop("_salt").withColumn("_mark", F.monotonically_increasing_id()), name)
    run = F.shiftright("_mark", 33).alias("_run")
    counts = runs.groupBy(part, run).agg(F.min("_mark").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(part)
    before = F.sum("_rows").over(whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = counts.select(F.col(part).alias("_part"), "_run", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = F.col(part).eqNullSafe(F.col("_part")) & (F.shiftright("_mark", 33) == F.col("_run"))
    out = cut(runs.join(starts, same).withColumn("at", F.col("_mark") + F.col("_shift")).drop("_part", "_run", "_shift", "_mark"), name)
    free(runs)
    return out


def tree(leaves: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (part, hash) of all parts of (part, at, n, hash), and the levels above the leaves: (part, at, n, hash, kids).

    Eight consecutive nodes, or what is left at the end, become one while a part has more than one.
    """
    largest, level, levels = leaves.agg(F.max("n")).first()[0] or 0, leaves, []
    lone = [leaves.filter("n = 1").select("part", "hash")]
    while largest > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda k: k["hash"])
        grouped = level.filter("n > 1").select("part", F.expr(f"at div {FAN}").alias("up"), "n", "at", "hash").groupBy("part", "up", "n").agg(kids.alias("kids"))
        level = cut(grouped.select("part", F.col("up").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), digest(F.array_join("kids", "")).alias("hash"), "kids"), f"{name}-level-{len(levels) + 1}")
        levels.append(level)
        lone.append(level.filter("n = 1").select("part", "hash"))
        largest = -(-largest // FAN)
    return reduce(DataFrame.unionByName, lone), levels


def joined(nodes: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """``nodes`` with the other columns of ``other`` where all keys are equal, null to null."""
    right = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return nodes.join(right, same).drop(*[f"_{k}" for k in keys])


def step(kids: Column, i: Column) -> Column:
    before, after = F.array_join(F.slice(kids, F.lit(1), i), ""), F.array_join(F.slice(kids, i + 2, F.size(kids)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def proven(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``leaves`` (part, at, n and others) with the columns of ``roots``: the part, ``path``, and others that all its leaves get.

    The path of a root's row holds the steps that follow that root; those from the leaf to it are put before them. A part's tree ends
    where it has one node, so each level takes up the parts that begin there.
    """
    carried = [c for c in roots.columns if c not in ("part", "path")]
    above = None
    for nodes in reversed(levels):
        found = joined(nodes.filter("n = 1").select("part", "at", "kids"), roots, "part")
        if above is not None:
            found = found.unionByName(joined(nodes.filter("n > 1").select("part", "at", "kids"), above, "part", "at"))
        kid = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)))
        path = F.concat(F.array(step(F.col("kids"), F.col("i"))), F.col("path"))
        above, nodes_above = kid.select("part", (F.col("at") * FAN + F.col("i")).alias("at"), path.alias("path"), *carried), found
    lone = joined(leaves.filter("n = 1"), roots, "part")
    if above is None:
        return lone
    # The lowest nodes aren't unfolded: each leaf takes its own step from its parent's row.
    parents = nodes_above.withColumnRenamed("at", "up")
    own = joined(leaves.filter("n > 1").withColumn("up", F.expr(f"at div {FAN}")), parents, "part", "up")
    path = F.concat(F.array(step(F.col("kids"), (F.col("at") % FAN).cast("int"))), F.col("path"))
    return own.withColumn("path", path).drop("up", "kids").unionByName(lone)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["before"], own, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, leaf: Column, part: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """Digest tree over the rows of ``docs``: a subtree for each ``part``, its leaves by ``order``, and one over the parts.

    Returns the columns of ``keep`` with leaf, subroot, root and path, the siblings at each step up to the root. In a part the
    leaves ascend by ``order``, nulls first, rows of equal order by their leaf (equal leaves are alike in any place); parts
    ascend by their UTF-8 bytes, null first. Eight consecutive nodes become one, the last run of a level may be shorter, even a
    single node, until one is left; a lone leaf is its part's root. Nulls in the columns that ``leaf`` looks at are its own
    to tell apart (:func:`field` does). An empty table gives no rows. A text of any length is read once, by the leaf. A path has
    a step for each of the log8(rows) levels, of at most seven digests. Names in ``keep`` that this adds are refused (ValueError).
    """
    keep = {} if keep is None else keep
    must_be_free(["leaf", "subroot", "root", "path", "part", "at", "n", "hash", "up", "kids", "i"], list(keep), "manifest.manifest")
    rows = cut(docs.select(F.col(part).cast("string").alias("part"), F.col(order).alias("_order"), leaf.alias("hash"), *[c.alias(k) for k, c in keep.items()]), "leaf-rows")
    leaves = numbered(rows, "part", [F.col("_order"), F.col("hash")], "leaves").drop("_order")
    subroots, levels = tree(leaves.select("part", "at", "n", "hash"), "parts")
    tops = numbered(subroots.select(F.lit(0).alias("part"), F.col("part").alias("name"), "hash"), "part", [F.col("name")], "tops")
    root, top_levels = tree(tops.select("part", "at", "n", "hash"), "tops")
    whole = root.select("part", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    roots = proven(tops, top_levels, whole).select(F.col("name").alias("part"), "path", F.col("hash").alias("subroot"), "root")
    out = proven(leaves, levels, cut(roots, "roots"))
    free(rows)
    return out.select(*keep, F.col("hash").alias("leaf"), "subroot", "root", "path")
