"""Rewrites older SQL text into what Spark parses: interval precision, quoted identifiers, views."""

from __future__ import annotations

import re

from fragsql.plans.script import tokens

_VIEW = re.compile(r"^(\s*)create\s+(?:or\s+replace\s+)?view\b", re.IGNORECASE)


def normalise(sql: str) -> str:
    """One statement for spark.sql.

    `interval '90' day (3)` loses its precision; "name" becomes `name`; CREATE VIEW becomes a temporary view that
    replaces an older one. Strings and comments stay as they are.
    """
    pieces = [(kind, _back(text) if kind == "quoted" and text[0] == '"' else text) for kind, text in tokens(sql)]
    out: list[str] = []
    units, i = {"day", "month", "year", "hour", "minute", "second"}, 0
    while i < len(pieces):
        kind, text = pieces[i]
        out.append(text)
        if kind == "word" and text.lower() in units and (end := _precision(pieces, i + 1)):
            i = end
        i += 1
    return _VIEW.sub(r"\1create or replace temporary view", "".join(out))


def _back(text: str) -> str:
    return "`" + text[1:].removesuffix('"').replace('""', '"').replace("`", "``") + "`"


def _precision(pieces: list[tuple[str, str]], i: int) -> int:
    """The place of the closing parenthesis if `( number )` begins at i, else 0."""
    want = iter(("(", None, ")"))
    expected = next(want)
    while i < len(pieces):
        kind, text = pieces[i]
        if kind != "space":
            if not (text == expected or (expected is None and text.isdigit())):
                return 0
            expected = next(want, "")
            if expected == "":
                return i
        i += 1
    return 0


def add_view_drop(statements: list[str]) -> list[str]:
    """DROP VIEW statements made harmless if the view is gone."""
    return [re.sub(r"^(\s*drop\s+view)\s+(?!if\b)", r"\1 if exists ", s, flags=re.IGNORECASE) for s in statements]
