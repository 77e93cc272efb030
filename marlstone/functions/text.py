"""Expressions over texts: measures, slices, literal search, statements, cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import fixed


def tokens(text: Column) -> Column:
    """About a quarter of the characters, rounded up, 1 at least; as long."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def tokens_of_file(chars: Column, size: Column) -> Column:
    """A quarter of the characters (bytes if those aren't known), rounded up; may be 0."""
    return F.ceil(F.coalesce(chars, size) / 4).cast("long")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines_by_break(text: Column) -> Column:
    """Breaks and one, 0 for an empty text: ``a\\n`` has 2."""
    return F.when(F.length(text) > 0, newlines(text) + 1).otherwise(0).cast("long")


#: Where Python ends a line.
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def lines_split(text: Column) -> Column:
    """Lines as Python splits them, at all its line boundaries: ``a\\n`` has 1."""
    open_ = F.when((text == "") | text.rlike(rf"(?:{LINE_BREAK})\z"), 0).otherwise(1)
    return (F.regexp_count(text, F.lit(LINE_BREAK)) + open_).cast("long")


@F.pandas_udf(T.StringType())
def _without_bad_bytes(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in contents:
        yield x.map(lambda b: bytes(b).decode("utf-8", errors="ignore") if b is not None else None)


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8 text without the bytes that aren't; only such contents are sent to Python."""
    raw = F.col(content) if isinstance(content, str) else content
    whole = F.is_valid_utf8(raw.cast("string"))
    return F.when(whole, raw.cast("string")).otherwise(_without_bad_bytes(F.when(~whole, raw)))


def file_hash(content: Column, binary: Column) -> Column:
    """SHA-256 in hex; sentinels for files that aren't read and those that can't be."""
    return F.when(binary, "binary_skipped").otherwise(F.coalesce(F.sha2(content, 256), F.lit("error")))


def markers(text: Column) -> Column:
    """Occurrences of TODO or FIXME before a colon or space, in any case. As in the rest of a line, only the last of a line's run counts once."""
    return F.regexp_count(text, F.lit("(?iud)" + fixed.MARKER)).cast("int")


def capped(text: Column, limit: int) -> Column:
    """The text, cut to ``limit`` characters with three dots at the end if it is longer."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def piece(text: Column, offset: Column | int, limit: Column | int) -> Column:
    """Up to 2,000 characters from an offset; an error for a negative offset or limit."""
    offset, limit = (F.lit(x) if isinstance(x, int) else x for x in (offset, limit))
    bad = (offset < 0) | (limit < 0)
    return F.when(bad, F.raise_error(F.lit("offset and limit must be >= 0"))).otherwise(F.substr(text, offset + 1, F.least(limit, F.lit(fixed.READ_CHARS))))


def excerpt(text: Column, binary: Column, limit: int = 5000) -> Column:
    return F.when(binary, fixed.BINARY_NOTICE).otherwise(F.left(text, F.lit(limit)))


def guarded(value: Column, size: Column) -> Column:
    """``value``, or an error for files over 2 MiB."""
    return F.when(size > fixed.READ_BYTES, F.raise_error(F.concat(F.lit("file too large: "), size.cast("string"), F.lit(" bytes")))).otherwise(value)


def hits(text: Column, pattern: str, most: int = 10, context: int = 160) -> Column:
    """Up to ``most`` (50 at most) places of a literal pattern in any case, without overlaps, in order.

    Array of struct<offset, line, match, excerpt>; the excerpt has ``context`` (1,000 at most) characters on either side.
    The text is cut at the pattern; lengths of the cuts give the offsets.
    """
    if not pattern:
        raise ValueError("pattern must not be empty")
    most, context, n = max(0, min(most, fixed.MOST_HITS)), max(0, min(context, fixed.MOST_CONTEXT)), len(pattern)
    quoted = "\\Q" + pattern.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    gaps = F.transform(F.split(F.lower(text), quoted, -1), lambda x: F.length(x))
    ends = F.slice(gaps, 1, F.least(F.size(gaps) - 1, F.lit(most)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, g: F.struct((s["at"] + g + n).alias("at"), F.array_append(s["all"], s["at"] + g).alias("all"))
    offsets = F.aggregate(ends, start, step)["all"]

    def hit(o: Column) -> Column:
        first = F.greatest(F.lit(0), o - context)
        last = F.least(F.length(text), o + n + context)
        return F.struct(o.alias("offset"), (newlines(F.left(text, o)) + 1).alias("line"), F.substr(text, o + 1, F.lit(n)).alias("match"), F.substr(text, first + 1, last - first).alias("excerpt"))

    return F.transform(offsets, hit)


def cell(text: Column) -> Column:
    """A text for a cell of a Markdown table."""
    flat = F.regexp_replace(F.replace(text, F.lit("|"), F.lit("&#124;")), r"\r\n|\r|\n", " ")
    return F.when(flat.endswith("\\"), F.concat(flat, F.lit("\\"))).otherwise(flat)


def _stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def last_line(error: Column, limit: int = 200) -> Column:
    """The last line of an error that isn't blank, cut; a fixed phrase for none."""
    found = F.coalesce(F.try_element_at(_stripped_lines(error), F.lit(-1)), F.trim(error))
    return F.when(error.isNull() | (error == ""), "no detail provided").otherwise(capped(found, limit))


def observation(error: Column, stdout: Column, result: Column) -> Column:
    """One line on a step: the error's last line, else the output's first, else the result."""
    of_error = F.coalesce(F.try_element_at(_stripped_lines(error), F.lit(-1)), error)
    of_output = F.get(F.split(F.regexp_replace(stdout, r"^\s+|\s+$", ""), r"\r\n|\r|\n", -1), F.lit(0))
    return F.when(F.coalesce(error, F.lit("")) != "", of_error).when(F.coalesce(stdout, F.lit("")) != "", of_output).otherwise(F.concat(F.lit("Result: "), F.coalesce(result, F.lit("NoneType None"))))


def prompt_of_step(kind: Column, stdout: Column, error: Column, state: Column) -> Column:
    """A step as text for the next prompt: kind, output, error, and the state sorted by name."""
    entries = F.transform(F.array_sort(F.map_entries(state)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("kind: "), kind), F.when(stdout != "", F.concat(F.lit("stdout:\n"), stdout)), F.when(error != "", F.concat(F.lit("error: "), error)), F.when(F.size(state) > 0, F.concat(F.lit("state:\n"), F.array_join(entries, "\n"))))


def dependency_target(statement: Column) -> Column:
    """What an import, use or include statement names."""
    word = lambda n: F.get(F.split(F.trim(F.regexp_replace(statement, r"\s+", " ")), " "), F.lit(n))
    after = lambda p: F.right(statement, F.length(statement) - len(p))
    return (
        F.when(statement.startswith("from "), F.coalesce(word(1), statement))
        .when(statement.startswith("import "), F.regexp_replace(word(1), ",+$", ""))
        .when(statement.startswith("use "), F.regexp_replace(after("use "), ";+$", ""))
        .when(statement.startswith("extern crate "), F.regexp_replace(after("extern crate "), ";+$", ""))
        .when(statement.startswith("#include"), F.trim(after("#include")))
        .otherwise(statement)
    )


def dependency_lines(content: Column, language: Column) -> Column:
    """Up to 12 bullets of import lines among the first 200 lines, cut at 160 characters."""
    stripped = F.transform(F.slice(F.split(content, r"\r\n|\r|\n", -1), 1, fixed.DEPENDENCY_SCAN), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def starts(line: Column) -> Column:
        one_of = lambda ps: F.array_contains(F.array(*[line.startswith(p) for p in ps]), True)
        out = one_of(fixed.OTHER_DEPENDENCY_PREFIXES)
        for lang, ps in fixed.DEPENDENCY_PREFIXES.items():
            out = F.when(language == lang, one_of(ps)).otherwise(out)
        return out

    return F.transform(F.slice(F.filter(stripped, starts), 1, fixed.DEPENDENCY_LINES), lambda x: F.concat(F.lit("- `"), F.left(x, F.lit(fixed.STATEMENT_CHARS)), F.lit("`")))


def symbol_lines(snippets: Column) -> Column:
    """A bullet with the first line of each snippet that isn't blank."""
    first = lambda s: F.get(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\r\n|\r|\n", -1), F.lit(0))
    return F.transform(F.filter(snippets, lambda s: F.trim(s) != ""), lambda s: F.concat(F.lit("- `"), first(s), F.lit("`")))


def dependency_statements(content: Column) -> Column:
    """The statements of bullets between the heading ``## Dependencies`` and the next heading of its level."""
    section = F.regexp_extract(F.concat(F.lit("\n"), F.regexp_replace(content, r"\r\n|\r", "\n"), F.lit("\n## ")), r"(?s)\n## Dependencies\n(.*?\n)?(?=## )", 1)
    bullets = F.filter(F.split(section, "\n", -1), lambda x: x.startswith("- `") & x.endswith("`") & (F.length(x) > 3))
    inner = F.transform(bullets, lambda x: F.trim(F.substr(x, F.lit(4), F.length(x) - 4)))
    return F.filter(inner, lambda x: (x != "") & ~x.startswith("No import/include"))
