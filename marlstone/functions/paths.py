"""Expressions over relative POSIX paths: parts, language, kind, category, ignore rules, safe names."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import fixed


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parents(path: Column) -> Column:
    """All parts but the last."""
    return F.slice(parts(path), 1, F.size(parts(path)) - 1)


def directory(path: Column) -> Column:
    """The directory of a path; ``./`` for the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(?s:(.*))/[^/]*$", 1)).otherwise("./")


def suffix(path: Column) -> Column:
    """From the last dot of the name, unless it begins or ends the name; else empty."""
    return F.regexp_extract(name(path), r"^(?s:.+)(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The name without its suffix."""
    return F.left(name(path), F.length(name(path)) - F.length(suffix(path)))


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.left(path, F.length(path) - F.length(suffix(path))), F.lit(new))


def language(path: Column) -> Column:
    """The language by the suffix in any case; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(suffix(path)))


def is_binary(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*fixed.BINARY_SUFFIXES)


def has_any(array: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values]))


def kind(path: Column) -> Column:
    """test, config, doc, other or source; the first that fits in this order, source if none."""
    above, base, low = parents(path), stem(path), F.lower(stem(path))
    in_tests = F.exists(above, lambda p: p.isin(*fixed.TEST_DIRECTORIES) | p.startswith("test_"))
    helper = low.rlike("|".join(fixed.HELPER_WORDS))
    tests = in_tests | ((base.startswith("test_") | base.endswith("_test")) & ~helper)
    ending = F.lower(suffix(path))
    config = name(path).isin(*fixed.CONFIG_NAMES) | F.array_contains(above, ".github") | ending.isin(*fixed.CONFIG_SUFFIXES)
    doc = has_any(above, fixed.DOC_DIRECTORIES) | ending.isin(*fixed.DOC_SUFFIXES) | (name(path) == "LICENSE")
    return F.when(tests, "test").when(config, "config").when(doc, "doc").when(is_binary(path), "other").otherwise("source")


def ends_with_any(text: Column, endings: tuple[str, ...]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(e) for e in endings) + r")\z")


def category(path: Column, is_directory: Column) -> Column:
    """code, test, doc, config, ci or unknown, by the lower-case name."""
    low = F.lower(name(path))
    of_directory = F.lit("unknown")
    for kind_, names in reversed(fixed.DIRECTORY_CATEGORIES.items()):
        of_directory = F.when(low.isin(*names), kind_).otherwise(of_directory)
    of_file = (
        F.when(ends_with_any(low, fixed.CODE_ENDINGS), F.when(low.contains("test"), "test").otherwise("code"))
        .when(ends_with_any(low, fixed.DOC_ENDINGS), "doc")
        .when(ends_with_any(low, fixed.CONFIG_ENDINGS), "config")
        .when(low.isin(*fixed.CI_NAMES), "ci")
        .otherwise("unknown")
    )
    return F.when(is_directory, of_directory).otherwise(of_file)


def ignored(path: Column) -> Column:
    """Whether any part, the file's name too, is out of every scan."""
    return F.exists(parts(path), lambda p: p.isin(*fixed.IGNORED_NAMES) | p.endswith(".egg-info"))


def ignored_source(path: Column) -> Column:
    return has_any(parts(path), fixed.IGNORED_SOURCE_NAMES)


def ignored_in_tree(path: Column) -> Column:
    return has_any(parts(path), fixed.TREE_IGNORED_NAMES) | F.lower(name(path)).isin(*fixed.TREE_IGNORED_FILES)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression that Java understands and that must match the whole."""
    inner = translate(pattern)
    # The standard library writes (?s:...)\z or \Z, and atomic groups, which Java reads alike but for the end anchor.
    return "^" + re.sub(r"\\[zZ]$", r"\\z", inner)


def matches_ignore_file(path: Column, patterns: list[str]) -> Column:
    """Whether a list of ignore patterns leaves the path out.

    Blank lines, comments and ``!`` lines are skipped. A pattern that ends in ``/`` is tried on each part; another one on the
    whole path and on each part, and if it begins with ``/`` also without that on the whole path. ``*`` crosses slashes.
    """
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip()
        if not p or p[0] in "#!":
            continue
        on_parts = lambda x: F.exists(parts(path), lambda part: part.rlike(glob_regex(x)))
        if p.endswith("/"):
            out = out | on_parts(p.rstrip("/"))
        else:
            out = out | path.rlike(glob_regex(p)) | on_parts(p)
            if p.startswith("/"):
                out = out | path.rlike(glob_regex(p.lstrip("/")))
    return out


def depth(path: Column) -> Column:
    return F.size(parts(path))


def prefixes(path: Column) -> Column:
    """The path and all directories above it, the shortest first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, 1, n), "/"))


def without_dots(path: Column) -> Column:
    """Leading dots and slashes off, as a set of characters; backslashes count as slashes and empty or ``.`` parts go."""
    clean = F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: (p != "") & (p != ".")), "/")
    rooted = F.when(F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), F.concat(F.lit("/"), clean)).otherwise(clean)
    return F.regexp_replace(rooted, r"^[./]+", "")


def artifact_path(path: Column) -> Column:
    """A clean relative path; an error for one that is absolute or goes up."""
    raw = F.replace(path, F.lit("\\"), F.lit("/"))
    own = F.filter(F.split(raw, "/", -1), lambda p: ~p.isin("", "."))
    bad = raw.startswith("/") | F.array_contains(own, "..")
    return F.when(bad, F.raise_error(F.concat(F.lit("artifact path escapes artifact root: "), path))).otherwise(F.array_join(own, "/"))


def within_root(path: Column, root_name: str) -> Column:
    """A requested path relative to the root: ``.`` parts go, ``..`` is resolved, a leading part like the root's name goes; null if it leaves the root."""
    own = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))
    own = F.when((F.size(own) > 0) & (F.get(own, F.lit(0)) == root_name), F.slice(own, 2, F.size(own))).otherwise(own)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(up, F.slice(state["kept"], 1, F.greatest(F.size(state["kept"]) - 1, F.lit(0)))).otherwise(F.array_append(state["kept"], part))
        return F.struct(kept.alias("kept"), (state["ok"] & ~(up & (F.size(state["kept"]) == 0))).alias("ok"))

    done = F.aggregate(own, start, step)
    return F.when(done["ok"] & ~path.startswith("/"), F.when(F.size(done["kept"]) == 0, ".").otherwise(F.array_join(done["kept"], "/")))


def as_markdown(path: Column) -> Column:
    """The path, with ``.md`` after it unless that is its suffix."""
    return F.when(suffix(path) == ".md", path).otherwise(F.concat(path, F.lit(".md")))


def safe_path(path: Column) -> Column:
    """A relative Markdown path from any text: no root, drive, ``.`` or ``..``, names of 255 characters at most; empty: index.md."""
    own = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: ~p.isin("", ".", "..") & ~p.endswith(":"))
    own = F.transform(own, lambda p: F.when(F.substring(p, 2, 1) == ":", F.right(p, F.length(p) - 2)).otherwise(p))
    own = F.transform(F.filter(own, lambda p: p != ""), lambda p: F.left(p, F.lit(fixed.NAME_CHARS)))
    return F.when(F.size(own) == 0, "index.md").otherwise(as_markdown(F.array_join(own, "/")))


def doc_candidates(path: Column, bare: bool) -> Column:
    """Where a document of a source may lie, in the order of preference: the path with ``.md``, with ``.md`` for its suffix, and if ``bare`` itself."""
    found = [F.concat(path, F.lit(".md")), with_suffix(path, ".md")]
    return F.array_distinct(F.array(*found, *([path] if bare else [])))


def dotted(path: Column) -> Column:
    """A module's name: the path up to its last dot, with dots for slashes."""
    bare = F.when(F.instr(path, ".") > 0, F.regexp_extract(path, r"^(?s:(.*))\.[^.]*$", 1)).otherwise(path)
    return F.replace(bare, F.lit("/"), F.lit("."))


def label(path: Column) -> Column:
    """The last two parts."""
    p = parts(path)
    return F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), F.lit(2)), "/")
