"""Short texts that stand for nested values: of a run's state, and of what a run is given. Also as columns over JSON texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRACKETS = {list: "[]", tuple: "()", set: "{}", dict: "{}"}


def cut(text: str, most: int | None) -> str:
    return text if most is None or len(text) <= most else text[: most - 3] + "..."


@dataclass(frozen=True)
class Style:
    """How much of a value is shown. levels: containers below are shown by their length; string: longer ones by length and
    beginning; crowds: containers of more items by length; items: how many of a container are shown; whole: characters of a
    container; scalars: whether a scalar of any level is cut to ``string``."""

    levels: int
    string: int
    crowds: dict[type, int] = field(default_factory=dict)
    items: int | None = None
    whole: int | None = None
    scalars: bool = False


# Sizes above which a state's containers are shown by their length; bounds of what a run is given.
CROWDS = {list: 100, set: 100, dict: 50}
CONTEXT_LEVELS, CONTEXT_ITEMS, CONTEXT_STRING, CONTEXT_CHARS, STATE_LEVELS, FIRST_CHARS = 6, 200, 1200, 16_000, 2, 20


class Shown:
    """One value's text; a container that was shown before, or holds itself, is three dots."""

    def __init__(self, style: Style) -> None:
        self.style, self.seen = style, set[int]()

    def crowd(self, value: Any, kind: type, inside: str) -> str:
        return f"{kind.__name__}(len={len(value)}) {BRACKETS[kind][0]}{inside}...{BRACKETS[kind][1]}"

    def of(self, value: Any, level: int = 0, string: int | None = None) -> str:
        style, string = self.style, self.style.string if string is None else string
        kind = next((k for k in BRACKETS if isinstance(value, k)), None)
        if kind is None:
            if isinstance(value, str) and len(value) > string:
                return f"str(len={len(value)}) {value[: string - 3]}..."
            return cut(repr(value), string if style.scalars or level >= style.levels else None)
        if id(value) in self.seen:
            return "..."
        self.seen.add(id(value))
        if level >= style.levels:
            return f"{type(value).__name__}(len={len(value)})"
        if len(value) > style.crowds.get(kind, len(value)):
            return self.crowd(value, kind, self.of(value[0], level + 1, FIRST_CHARS) + ", " if kind is list else "")
        rows = [tuple(x) if kind is dict else (x,) for x in islice(value.items() if kind is dict else value, style.items)]
        parts = [": ".join(self.of(x, level + 1, string) for x in row) for row in rows] + ["..."] * (len(rows) < len(value))
        lone = "," if kind is tuple and len(value) == 1 else ""
        text = cut(BRACKETS[kind][0] + ", ".join(parts) + BRACKETS[kind][1], style.whole)
        return text[:-1] + lone + text[-1] if lone else text


def summary_of(value: object, limit: int) -> str:
    """Type and short text of a value, as a step's state shows it; the type isn't told again where the text begins with it."""
    style = Style(STATE_LEVELS, limit, CROWDS)
    kind = type(value)
    if isinstance(value, list) and len(value) > CROWDS[list]:
        return Shown(style).crowd(value, list, Shown(style).of(value[0], 0, FIRST_CHARS) + ", ")
    text = Shown(style).of(value)
    by_length = isinstance(value, str) and len(value) > limit or isinstance(value, dict) and len(value) > CROWDS[dict]
    return text if by_length else f"{kind.__name__} {cut(text, limit)}"


def context_of(value: object, limit: int = CONTEXT_CHARS, scalars: bool = True) -> str:
    """Type and text of what a run is given: six levels, 200 items of each container, texts of 1,200 characters, ``limit`` in all.

    A text of up to 1,200 characters is cut with its quotes and escapes, so that these count too; without ``scalars`` it is whole.
    """
    style = Style(CONTEXT_LEVELS, min(CONTEXT_STRING, limit), items=CONTEXT_ITEMS, whole=limit, scalars=scalars)
    return f"{type(value).__name__} {cut(Shown(style).of(value), limit)}"


def over_json(shown: Callable[[Any], str]):
    """A function of a column of JSON texts; what isn't JSON is shown as the text that it is, null stays null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            value = text
        return shown(value)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one).astype(object)

    return run


def summaries(limit: int = 160):
    return over_json(lambda value: summary_of(value, limit))


def contexts(limit: int = CONTEXT_CHARS, scalars: bool = True):
    return over_json(lambda value: context_of(value, limit, scalars))


def literals():
    """Whole values as Python writes them; a text as it is."""
    return over_json(str)
