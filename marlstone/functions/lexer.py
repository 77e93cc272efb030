"""Definitions in languages without a parser here: strings and comments are blanked out, braces paired, and headers looked for.

A definition reaches from its header to the brace (in Ruby the ``end``) that closes it, to the end of its statement if it has no
body, or to the end of the text where nothing closes it.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import fixed

SPAN = T.StructType().add("name", "string").add("kind", "string").add("line", "integer").add("end_line", "integer")
EXTRACTED = T.StructType().add("symbols", T.ArrayType(T.StringType())).add("spans", T.ArrayType(SPAN)).add("fallback_excerpt", "string").add("error", "string")

SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
DOUBLE, SINGLE, BACK = (rf"{q}(?:\\.|[^{q}\\])*(?:{q}|\Z)" for q in ('"', "'", "`"))
LINE_DOUBLE, LINE_SINGLE = (rf"{q}(?:\\.|[^{q}\\\n])*{q}?" for q in ('"', "'"))
CHAR = r"'(?:\\[^\n']{1,10}|[^\\'\n])'"
TEXTS = r'"""' + r'.*?(?:"""|\Z)'
#: What isn't code, by language.
BLANKS = {
    "javascript": f"{SLASHES}|{LINE_DOUBLE}|{LINE_SINGLE}|{BACK}",
    "go": f"{SLASHES}|{LINE_DOUBLE}|{CHAR}|`[^`]*(?:`|\\Z)",
    "rust": rf'{SLASHES}|r(#*)".*?(?:"\1|\Z)|{DOUBLE}|{CHAR}',
    "java": f"{SLASHES}|{TEXTS}|{LINE_DOUBLE}|{CHAR}",
    "ruby": rf"\#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z)|{DOUBLE}|{SINGLE}",
    "c": rf"{SLASHES}|{LINE_DOUBLE}|{CHAR}|^[^\S\n]*\#(?:\\\n|[^\n])*",
    "c_sharp": rf'{SLASHES}|@"(?:""|[^"])*(?:"|\Z)|{LINE_DOUBLE}|{CHAR}|^[^\S\n]*\#[^\n]*',
}
BLANKS |= {"typescript": BLANKS["javascript"], "tsx": BLANKS["javascript"], "cpp": BLANKS["c"], "kotlin": BLANKS["java"], "swift": BLANKS["java"]}

NAME = r"(?P<name>[^\W\d]\w*)"
WORDS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|export|default|declare|partial|data|inline|suspend|unsafe|pub(?:\([^)]*\))?|const|extern|mutating|fileprivate|native|synchronized|readonly|inner|enum|annotation|value|operator|infix|tailrec)\s+)*"
START = rf"(?:(?<=[\n;{{}}])|\A)\s*(?P<head>{WORDS}"
#: A function of the C family: types and a name before parentheses, then a body; words that begin statements aren't types.
NO_TYPE = r"(?!(?:return|else|if|for|while|switch|do|case|goto|throw|new|using|namespace|typedef|await|yield|catch|lock|delete)\b)"
METHOD = rf"{NO_TYPE}(?:(?:[\w$@<>,.?\[\]*&~]|::)+\s+)*?{NO_TYPE}(?P<own>[\w:~$]+)\s*\([^;{{}}]*\)[^;{{}}()]*)(?=\{{)"
FUNCTION = rf"function\s*\*?\s*{NAME})"


def kinds(*words: str) -> str:
    return rf"(?P<kind>{'|'.join(words)})\s+{NAME})"


#: How the pattern of a header ends that only stands before a brace.
BRACED = r"(?=\{)"

#: Headers of definitions, by language.
HEADERS = {
    "javascript": (FUNCTION, kinds("class"), rf"(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>))"),
    "typescript": (FUNCTION, kinds("class", "interface", "type")),
    "tsx": (FUNCTION, kinds("class", "interface")),
    "go": (rf"(?P<kind>func)\s+(?:\([^)]*\)\s*)?{NAME})", kinds("type")),
    "rust": (kinds("fn", "struct", "enum", "trait"), r"(?P<kind>impl)\b(?:\s*<[^{;]*?>)?\s*(?P<name>[^\s{<]+))"),
    "java": (kinds("class", "interface"), METHOD),
    "ruby": (r"(?P<kind>def|class|module)\s+(?P<name>[\w.:?!=]+))",),
    "c": (rf"(?P<kind>struct)\s+{NAME}\s*)(?=\{{)", METHOD),
    "cpp": (rf"(?:template\s*<[^{{;]*>\s*)?(?P<kind>class|struct)\s+{NAME}[^;{{}}()]*)(?=\{{)", METHOD),
    "c_sharp": (kinds("class", "interface"), METHOD),
    "kotlin": (rf"(?P<kind>fun)\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{NAME})", kinds("class", "object")),
    "swift": (kinds("func", "class", "struct", "protocol"),),
}
FINDERS = {language: [re.compile(START + h) for h in found] for language, found in HEADERS.items()}
HIDDEN = {language: re.compile(blank, re.S | re.M) for language, blank in BLANKS.items()}
RUBY_WORDS = re.compile(r"(?:(?<=[\n;])|\A)[^\S\n]*(?:(?P<open>def|class|module|if|unless|while|until|case|begin|for)\b|end\b)|\bdo\b(?=[^\S\n]*(?:\|[^|\n]*\|)?[^\S\n]*(?:\n|;|\Z))|(?<=[\s;])end\b")


class Span(NamedTuple):
    """A definition's name, kind and lines, from 1 on."""

    name: str
    kind: str
    line: int
    end_line: int


def blanked(code: str, language: str) -> str:
    """Code with comments as blanks and strings as rows of quotes; lines and places stay."""
    return HIDDEN[language].sub(lambda m: re.sub(r"[^\n]", " " if m[0].lstrip()[0] in "/#=" else '"', m[0]), code)


def closings(code: str, language: str) -> dict[int, int]:
    """The place of what closes each opening brace (in Ruby: each opening word)."""
    out, open_ = {}, []
    for m in RUBY_WORDS.finditer(code) if language == "ruby" else re.finditer(r"[{}]", code):
        word = m[0].strip()
        if word in ("}", "end"):
            if open_:
                out[open_.pop()] = m.end() - 1
        else:
            open_.append(m.end() - len(word))
    return out


def spans(code: str, language: str) -> list[Span]:
    """Definitions in the order of the text, nested ones too; none for a language without headers here."""
    if language not in FINDERS:
        return []
    plain = blanked(code, language)
    pairs, breaks = closings(plain, language), [m.start() for m in re.finditer("\n", plain)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    found: dict[int, Span] = {}
    for finder in FINDERS[language]:
        at, braced = 0, finder.pattern.endswith(BRACED)
        # A header that ends at a brace isn't looked for where none follows: in prose the search would try every word.
        while (not braced or plain.find("{", at) >= 0) and (m := finder.search(plain, at)):
            start, head = m.start("head"), m.end("head")
            at = max(head, m.start() + 1)
            names = m.groupdict()
            kind = names.get("kind") or "function"
            if language == "ruby":
                end = pairs.get(start + plain[start:].find(kind), len(code) - 1)
            else:
                # The body's brace comes before the statement ends; parentheses of the header may lie between.
                body = re.compile(r"[{;]" if language in ("javascript", "typescript", "tsx", "java", "c", "cpp", "c_sharp", "rust") else r"\{|\n(?!\s*\{)").search(plain, head)
                if body is None:
                    end = len(code) - 1
                elif body[0] == "{":
                    end = pairs.get(body.start(), len(code) - 1)
                else:
                    end = body.start() - (body[0] != ";")
            found.setdefault(start, Span(names.get("name") or names.get("own") or "", kind, line(start), line(max(start, min(end, len(code.rstrip()) - 1)))))
    return [found[k] for k in sorted(found)]


def python_spans(code: str) -> list[Span]:
    """All classes and functions of Python code, nested ones too; SyntaxError if it is none."""
    named = [n for n in ast.walk(ast.parse(code)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    named.sort(key=lambda n: (n.lineno, n.col_offset))
    return [Span(n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno or n.lineno) for n in named]


def extracted(code: str | None, language: str | None, binary: bool, most: int, lines_each: int, excerpt: int) -> dict:
    """symbols (first lines of definitions), spans, fallback_excerpt (beginning of the text) and error of one file."""
    if code is None or binary:
        return {"symbols": [], "spans": [], "fallback_excerpt": fixed.BINARY_NOTICE if binary else "", "error": None}
    error, found = None, []
    try:
        found = python_spans(code) if language == "python" else spans(code, language or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = f"{type(e).__name__}: {e}"
    lines = code.splitlines()
    shown = ["\n".join(lines[s.line - 1 : min(s.end_line, s.line - 1 + lines_each)]) for s in found[:most]]
    return {"symbols": shown, "spans": [s._asdict() for s in found], "fallback_excerpt": code[:excerpt], "error": error}


def extracted_of(most: int = 10, lines_each: int = 16, excerpt: int = 1000):
    """A function (content, language, binary) -> struct<symbols, spans, fallback_excerpt, error>, see :func:`extracted`."""

    @F.pandas_udf(EXTRACTED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, language, binary in batches:
            rows = [extracted(c, l, bool(b), most, lines_each, excerpt) for c, l, b in zip(content, language, binary, strict=True)]
            yield pd.DataFrame(rows, columns=["symbols", "spans", "fallback_excerpt", "error"])

    return run
