"""The graph of imports: resolution, edges, order, reachability, cycles."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sized

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fixed, paths
from marlstone.operators.ordering import numbered
from marlstone.plans.scratch import cut, free

#: Steps along edges between two tables that are written.
STEPS = 3


def graph_nodes(files: DataFrame) -> DataFrame:
    """The files that take part: sources in a known language."""
    return files.filter("kind = 'source' and language <> 'unknown'")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add target, the file that an import names, or null.

    ``imports``: repo_id, path, import_ord, module; ``files``: repo_id, path. A module is looked up by its name and
    each dotted prefix of it (a class or submodule of a file), a package by its ``__init__``; the first file in the order of
    the scan wins. Modules that begin with dots count those up from the importing file. Every prefix becomes a row and an
    equi-join, so the work is the length of names, not imports times files.
    """
    path, module = F.col("path"), F.col("module")
    name = paths.dotted(path)
    package = F.when(name.endswith(".__init__"), F.left(name, F.length(name) - 9))
    known = files.select("repo_id", F.col("path").alias("target"), F.explode(F.array_compact(F.array(
        F.struct(name.alias("name"), F.lit(True).alias("whole")), F.when(package.isNotNull(), F.struct(package.alias("name"), F.lit(False).alias("whole"))),
    ))).alias("k"))
    known = known.select("repo_id", "target", F.col("k.name").alias("name"), F.col("k.whole").alias("covers"))
    labels = F.split(module, r"\.", -1)
    plain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    absolute = imports.filter(~module.startswith(".")).withColumn("name", F.explode(plain))
    found = absolute.join(known, ["repo_id", "name"]).filter(F.col("covers") | (F.col("name") == module))
    dots = F.length(F.regexp_extract(module, r"^\.+", 0))
    rest = F.right(module, F.length(module) - dots)
    base = F.slice(paths.parts(path), 1, F.greatest(F.size(paths.parts(path)) - dots, F.lit(0)))
    joined = F.array_join(F.concat(base, F.when(rest != "", F.split(rest, r"\.", -1)).otherwise(F.array().cast("array<string>"))), "/")
    relative = imports.filter(module.startswith(".")).filter(F.size(paths.parts(path)) > dots).withColumn("bare", joined)
    bare = F.when(F.instr(path, ".") > 0, F.regexp_extract(path, r"^(?s:(.*))\.[^.]*$", 1)).otherwise(path)
    beside = files.select("repo_id", F.col("path").alias("target"), F.explode(F.array(bare, F.concat(bare, F.lit("/__init__")))).alias("bare"))
    keys = ["repo_id", "path", "import_ord"]
    hits = found.select(*keys, "target").unionByName(relative.join(beside, ["repo_id", "bare"]).select(*keys, "target"))
    first = hits.groupBy(*keys).agg(F.min_by("target", paths.parts(F.col("target"))).alias("target"))
    return imports.join(first, keys, "left")


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, src, dst, first_ord: a file and one that it imports, once each, no file itself; first_ord is the first such import."""
    nodes = graph_nodes(files)
    own = imports.join(nodes.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    pairs = resolve(own, nodes).filter("target is not null and target <> path")
    return pairs.groupBy("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.min("import_ord").alias("first_ord"))


def adjacency(edges_: DataFrame, nodes: DataFrame, forward: bool = True) -> DataFrame:
    """repo_id, path, neighbours: lists in the order of imports (forward), or of the importing file's path."""
    a, b, order = ("src", "dst", "first_ord") if forward else ("dst", "src", "src")
    lists = edges_.groupBy("repo_id", F.col(a).alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(b).alias("p")))), lambda x: x["p"]).alias("neighbours"))
    return nodes.select("repo_id", "path").join(lists, ["repo_id", "path"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def order_of(nodes: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """The least order in which both ends of each pair (before, after) stand so; what is in or behind a cycle comes last, sorted."""
    waiting, after = dict.fromkeys(nodes, 0), defaultdict(list)
    for a, b in pairs:
        waiting[b] += 1
        after[a].append(b)
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for b in after[out[-1]]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    return out + sorted(n for n, k in waiting.items() if k > 0)


def weak_parts(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, path, part: the least path that a file is connected with, whatever the direction of imports.

    Large and small stars by turns: every file's greater neighbours are tied to its least one, then its lesser ones are. Each
    turn is an aggregate and a join on files, and halves what is left of long chains; it ends when nothing moves.
    """
    pairs = edges_.select("repo_id", F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    ties = cut(pairs.select("repo_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "ties")
    keys = ["repo_id", "u"]
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("repo_id", "u", "v").cast("decimal(38,0)"))).first()
    seen = mark(ties)
    while seen[0]:
        both = ties.unionByName(ties.select("repo_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, keys).select("repo_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy(*keys).agg(F.min("v").alias("m"))
        small = large.join(least, keys).select("repo_id", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, ties = ties, cut(small, "ties")
        now = mark(ties)
        free(before)
        if now == seen:
            break
        seen = now
    roots = ties.groupBy("repo_id", F.col("u").alias("path")).agg(F.min("v").alias("part"))
    return nodes.select("repo_id", "path").join(roots, ["repo_id", "path"], "left").withColumn("part", F.coalesce("part", "path"))


def dependency_order(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, pos, path: what is imported comes before what imports it, the least path first among those that may come; what is in or
    behind a cycle comes last, sorted.

    Files that no import connects don't hang on each other: each connected part is ordered in its own task, which holds paths alone.
    Of several such sequences, the one with the least head goes on, and that is their rows sorted by the greatest path so far.
    """
    parts = cut(weak_parts(edges_, nodes), "weak-parts")
    lists = edges_.groupBy("repo_id", F.col("src").alias("path")).agg(F.collect_set("dst").alias("needs"))
    rows = parts.join(lists, ["repo_id", "path"], "left")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        needs = [list(x) if x is not None else [] for x in pdf["needs"]]
        pairs = [(a, b) for b, some in zip(pdf["path"], needs, strict=True) for a in some]
        got = order_of(pdf["path"].tolist(), pairs)
        place = {p: i for i, p in enumerate(got)}
        # Behind the last file that could be ordered all are in or behind a cycle.
        stuck = min((place[b] for a, b in pairs if place[a] >= place[b]), default=len(got))
        top, out = "", []
        for i, p in enumerate(got):
            top = max(top, p)
            out.append((key[0], p, i >= stuck, p if i >= stuck else top, i))
        return pd.DataFrame(out, columns=["repo_id", "path", "stuck", "top", "place"])

    lone = rows.join(parts.groupBy("repo_id", "part").count().filter("count = 1").drop("count"), ["repo_id", "part"], "left_semi")
    alone = lone.select("repo_id", "path", F.lit(False).alias("stuck"), F.col("path").alias("top"), F.lit(0).cast("long").alias("place"))
    tied = rows.join(lone.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    placed = tied.groupBy("repo_id", "part").applyInPandas(one, "repo_id string, path string, stuck boolean, top string, place long").unionByName(alone)
    out = numbered(placed, ["repo_id"], [F.col("stuck"), F.col("top"), F.col("place")], "pos", "dependency-order")
    free(parts)
    return out.select("repo_id", "pos", "path")


def in_degree(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))


def reachable(edges_: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """repo_id, start, path, hops: files within ``max_hops`` imports of a start, with the fewest; the start itself has 0.

    The frontier is joined once a hop, without the files that were reached before; each hop is cut.
    """
    found = starts.select("repo_id", F.col("path").alias("start"), "path", F.lit(0).alias("hops"))
    front = found
    for hop in range(1, max_hops + 1):
        step = front.join(edges_.select("repo_id", F.col("src").alias("path"), "dst"), ["repo_id", "path"]).select("repo_id", "start", F.col("dst").alias("path")).distinct()
        front = cut(step.join(found, ["repo_id", "start", "path"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def strong_parts(edges_: DataFrame) -> DataFrame:
    """repo_id, path, part: files of strongly connected parts of more than one file, with the least path of the part.

    Rounds: edges from files that nothing imports, or to files that import nothing, lie on no cycle and go; then every file takes the least
    path that leads to it as its colour, and of each colour the files that lead back to that path are a part. What is left
    within the colours goes on. Each step is a join on what is left; no task holds a repository.
    """
    keys = ["repo_id"]
    left = cut(edges_.select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct(), "strong")
    n, parts = left.count(), []
    while n:
        trimmed = left
        for _ in range(STEPS):
            begins, ends = trimmed.select("repo_id", F.col("a").alias("b")).distinct(), trimmed.select("repo_id", F.col("b").alias("a")).distinct()
            trimmed = trimmed.join(begins, [*keys, "b"], "left_semi").join(ends, [*keys, "a"], "left_semi").select("repo_id", "a", "b")
        trimmed = cut(trimmed, "strong")
        before, n, left = n, trimmed.count(), trimmed
        if n < before:
            continue
        if not n:
            break
        colour = cut(left.select("repo_id", F.col("a").alias("path")).distinct().withColumn("c", F.col("path")), "colours")
        while True:
            step = colour.withColumn("old", F.col("c"))
            for _ in range(STEPS):
                sent = left.join(step.select("repo_id", F.col("path").alias("a"), "c"), [*keys, "a"]).groupBy("repo_id", F.col("b").alias("path")).agg(F.min("c").alias("m"))
                step = step.join(sent, [*keys, "path"], "left").select("repo_id", "path", F.least("c", "m").alias("c"), "old")
            step = cut(step, "colours")
            free(colour)
            colour = step
            if step.filter("c <> old").isEmpty():
                break
        colour = colour.drop("old")
        inside = left.join(colour.select("repo_id", F.col("path").alias("a"), "c"), [*keys, "a"]).join(colour.select("repo_id", F.col("path").alias("b"), F.col("c").alias("d")), [*keys, "b"])
        inside = cut(inside.filter("c = d").select("repo_id", "a", "b", "c"), "inside")
        found, size = cut(colour.filter("path = c").select("repo_id", "path", F.col("c").alias("part")), "parts"), -1
        while size != (size := found.count()):
            grown = found
            for _ in range(STEPS):
                back = inside.join(grown.select("repo_id", F.col("path").alias("b")), [*keys, "b"]).select("repo_id", F.col("a").alias("path"), F.col("c").alias("part"))
                grown = grown.unionByName(back).distinct()
            before_, found = found, cut(grown, "parts")
            free(before_)
        parts.append(found)
        gone = found.select("repo_id", "path")
        rest = inside.join(gone.withColumnRenamed("path", "a"), [*keys, "a"], "left_anti").join(gone.withColumnRenamed("path", "b"), [*keys, "b"], "left_anti")
        left = cut(rest.select("repo_id", "a", "b"), "strong")
        n = left.count()
    out = edges_.sparkSession.createDataFrame([], "repo_id string, path string, part string")
    for found in parts:
        out = out.unionByName(found)
    # The part's name is its least path already, as colours are least paths; parts of one file are none.
    many = out.groupBy("repo_id", "part").count().filter("count > 1").drop("count")
    return out.join(many, ["repo_id", "part"], "left_semi").select("repo_id", "path", "part")


def cycles(edges_: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """repo_id, path, cycle: the files on a cycle of imports, with the least path of their strongly connected part."""
    return strong_parts(edges_).withColumnRenamed("part", "cycle")


def cycle_paths(edges_: DataFrame) -> DataFrame:
    """repo_id, part, cycle: a way around for each edge that leads back to a file on the way to it, first and last file alike.

    Every strongly connected part is walked in a task of its own, from its least path, neighbours in the order of imports, each file
    once; so a part has at most as many as it has edges, and one at least. ``edges_`` has first_ord.
    """
    parts = cut(strong_parts(edges_), "parts")
    ends = lambda name: parts.select("repo_id", F.col("path").alias(name), F.col("part").alias(f"{name}_part"))
    own = edges_.join(ends("src"), ["repo_id", "src"]).join(ends("dst"), ["repo_id", "dst"]).filter("src_part = dst_part")
    lists = own.groupBy("repo_id", F.col("src_part").alias("part"), "src").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "dst"))), lambda x: x["dst"]).alias("ahead"))

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ahead, done, out = dict(zip(pdf["src"], pdf["ahead"], strict=True)), set(), []
        way, place, todo = [key[1]], {key[1]: 0}, [iter(ahead[key[1]])]
        while way:
            step = next(todo[-1], None)
            if step is None:
                done.add(way[-1])
                del place[way.pop()]
                todo.pop()
            elif step in place:
                out.append([*way[place[step] :], step])
            elif step not in done:
                place[step] = len(way)
                way.append(step)
                todo.append(iter(ahead[step]))
        return pd.DataFrame({"repo_id": key[0], "part": key[1], "cycle": out})

    return lists.groupBy("repo_id", "part").applyInPandas(walk, "repo_id string, part string, cycle array<string>")


def diagram(order: Sized, pairs: list[tuple[str, str]]) -> str:
    """A Mermaid graph of the files that import or are imported; a notice for over 50 files, or for none."""
    if len(order) > fixed.DIAGRAM_NODES:
        return f"```text\nDependency graph is too large to display as a Mermaid diagram.\nTotal files: {len(order)} (limit: {fixed.DIAGRAM_NODES})\n```"
    active = sorted({x for p in pairs for x in p})
    if not active:
        return "*(No internal module dependencies detected)*"
    ids = {n: f"node_{i}" for i, n in enumerate(active)}
    shown = [f'  {ids[n]}["{"/".join(n.split("/")[-2:])}"]' for n in active]
    return "\n".join(["```mermaid", "graph TD", *shown, *(f"  {ids[a]} --> {ids[b]}" for a, b in sorted(pairs)), "```"])
