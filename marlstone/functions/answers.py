"""Code that a model answers with: taken out of quotes, fences and string literals, and judged. It is parsed, never run."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import fixed

CHECKED = T.StructType().add("kind", "string").add("code", "string").add("error", "string")
#: A quoted line's mark, a line that isn't blank, and the first closed fence with what it holds.
QUOTE, FILLED = re.compile(r"^[^\S\n]*>[^\S\n]*", re.M), re.compile(r"^.*\S", re.M)
FENCED = re.compile(r"^[^\S\n]*```[^\n]*\n(.*?)^[^\S\n]*```[^\S\n]*$", re.M | re.S)


def parsed(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def reserved(message: str) -> Callable[[str], str | None]:
    return lambda name: message.format(name) if name in fixed.RESERVED_HELPERS else None


def import_(node: ast.AST) -> str:
    return fixed.IMPORTS_REFUSED


def subscript(node: ast.Subscript) -> str | None:
    name = getattr(node.value, "id", None)
    return fixed.SUBSCRIPT_REFUSED.format(name) if name in ("globals", "locals") else None


def name(node: ast.Name) -> str | None:
    return reserved(fixed.ASSIGNMENT_REFUSED)(node.id) if isinstance(node.ctx, ast.Store) else None


def definition(node: ast.FunctionDef | ast.ClassDef) -> str | None:
    return reserved(fixed.DEFINITION_REFUSED)(node.name)


#: What may be wrong with a node, by its kind.
OBJECTIONS: dict[type[ast.AST], Callable] = {
    **dict.fromkeys((ast.Import, ast.ImportFrom), import_),
    **dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), definition),
    ast.Subscript: subscript,
    ast.Name: name,
}


def objection(tree: ast.AST) -> str | None:
    """The first reason why parsed code may not run: imports, ``globals[...]``, or a name that a helper has."""
    found = (OBJECTIONS[type(node)](node) for node in ast.walk(tree) if type(node) in OBJECTIONS)
    return next(filter(None, found), None)


def bare(response: str) -> str:
    """An answer without the marks of a quote, if all its lines have them."""
    text, marks = QUOTE.subn("", response.strip())
    return text.strip() if marks and marks == len(FILLED.findall(response)) else response.strip()


def code_in(text: str) -> str:
    """What the first closed fence holds, else the whole; and of code that is one string literal, the code in it."""
    code = found[1].strip() if (found := FENCED.search(text)) else text
    body = tree.body if (tree := parsed(code)) else []
    literal = body[0].value if len(body) == 1 and isinstance(body[0], ast.Expr) else None
    inner = literal.value.strip() if isinstance(literal, ast.Constant) and isinstance(literal.value, str) else ""
    return inner if inner and parsed(inner) else code


def checked(response: str | None) -> dict[str, str | None]:
    """kind (code, invalid_code, model_error), code and error of a model's answer."""
    text = bare(response or "")
    code = code_in(text)
    kind, error = "invalid_code", None
    if not text:
        error = fixed.EMPTY_ANSWER
    elif text.startswith(fixed.MODEL_ERRORS):
        kind, error = "model_error", text
    elif not code:
        error = fixed.NO_CODE
    else:
        try:
            error = objection(ast.parse(code))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            error = f"{type(e).__name__}: {e}"
    return {"kind": kind, "code": None, "error": error} if error else {"kind": "code", "code": code, "error": None}


@F.pandas_udf(CHECKED)
def validated_code(responses: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for x in responses:
        yield pd.DataFrame([checked(r) for r in x], columns=["kind", "code", "error"])
