"""SQL scripts: splitting into statements, checking their shape, finding the query."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SELECT = re.compile(r"\s*(?:\(\s*)*(?:select|with)\b", re.IGNORECASE)
_DDL = re.compile(r"\s*(?:create|drop)\b", re.IGNORECASE)


def tokens(sql: str) -> Iterator[tuple[str, str]]:
    """(kind, text) pieces that join to sql again; kind is quoted, comment, word, space or sign.

    Quoted text runs to its closing quote, a doubled quote inside belonging to it; an unclosed one runs to the end.
    """
    pattern = re.compile(
        r"""(?P<quoted>'(?:[^']|'')*(?:'|\Z)|"(?:[^"]|"")*(?:"|\Z)|`(?:[^`]|``)*(?:`|\Z))"""
        r"""|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_0-9.$]+)|(?P<space>\s+)|(?P<sign>.)""",
        re.DOTALL,
    )
    for m in pattern.finditer(sql):
        yield m.lastgroup or "sign", m.group()


def split_script(sql: str) -> list[str]:
    """The statements of a script, cut at semicolons outside quotes and comments; blank ones are left out.

    A script of a single statement comes back as it is written, with its semicolon, if any.
    """
    parts, part = [], ""
    for kind, text in tokens(sql):
        if kind == "sign" and text == ";":
            parts.append(part)
            part = ""
        else:
            part += text
    parts.append(part)
    blank = lambda p: all(kind in ("space", "comment") for kind, _ in tokens(p))
    parts = [p.strip() for p in parts if not blank(p)]
    return [sql] if len(parts) == 1 else parts


def without_comments(sql: str) -> str:
    return "".join(" " if kind == "comment" else text for kind, text in tokens(sql))


def is_select(statement: str) -> bool:
    return bool(_SELECT.match(without_comments(statement)))


def is_ddl(statement: str) -> bool:
    return bool(_DDL.match(without_comments(statement)))


def index_of_select(statements: list[str]) -> int:
    """The place of the first query, -1 if there is none."""
    return next((i for i, s in enumerate(statements) if is_select(s)), -1)


def first_select(statements: list[str]) -> str | None:
    i = index_of_select(statements)
    return None if i < 0 else statements[i]


def validate_script(sql: str) -> tuple[list[str], str, list[str]]:
    """(statements before, query, statements after) of a script of the shape DDL* SELECT DDL*, else ValueError."""
    statements = split_script(sql)
    i = index_of_select(statements)
    if i < 0:
        raise ValueError("a script needs a SELECT")
    before, after = statements[:i], statements[i + 1 :]
    wrong = [s for s in before + after if not is_ddl(s)]
    if wrong:
        raise ValueError(f"only CREATE and DROP may stand around the SELECT: {wrong[0][:60]}")
    return before, statements[i].strip().rstrip(";").rstrip(), after
