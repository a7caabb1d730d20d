"""Tokens of the SQLite-flavoured dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A statement that the dialect does not have, or that breaks its rules."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, text, blob, int, real, op, param, end
    value: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


_RULES = [
    ("space", r"(?:\s+|--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))+"),
    ("blob", r"[xX]'[0-9A-Fa-f]*'"),
    ("text", r"'(?:[^']|'')*'"),
    ("quoted", r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]'),
    ("int", r"0[xX][0-9A-Fa-f]+|[0-9]+(?![0-9.eE])|[0-9]+(?=[eE](?![0-9+-]))"),
    ("real", r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"),
    ("param", r"\?[0-9]*|[:@$][A-Za-z_][A-Za-z0-9_]*"),
    ("word", r"[^\W\d]\w*"),
    ("op", r"->>|->|\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;]"),
]
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _RULES))


def tokens(sql: str) -> list[Token]:
    """All tokens but white space and comments, then an end token."""
    found, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        at = m.end()
        if kind == "space":
            continue
        if kind == "text":
            raw = raw[1:-1].replace("''", "'")
        elif kind == "blob":
            raw = raw[2:-1]
        elif kind == "quoted":
            close = {"[": "]"}.get(raw[0], raw[0])
            raw = raw[1:-1].replace(close * 2, close)
        found.append(Token(kind, raw, m.start(), at))
    found.append(Token("end", "", len(sql), len(sql)))
    return found
