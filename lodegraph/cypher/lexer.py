"""Tokens of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuerySyntaxError

#: Words that can't be variables.
RESERVED = frozenset(
    "MATCH WHERE RETURN CREATE SET DELETE DETACH AS AND OR XOR NOT IN IS STARTS ENDS CONTAINS WITH CASE WHEN THEN ELSE END LIMIT SKIP ORDER BY "
    "ASC DESC DISTINCT MERGE UNWIND CALL YIELD REMOVE FOREACH UNION ALL OPTIONAL EXISTS EXPLAIN ON".split()
)

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<float>(?:\d+\.\d+|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>0[xX][0-9a-fA-F]+|0[oO][0-7]+|\d+)
      | (?P<param>\$[A-Za-z0-9_]+)
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<name>[^\W\d]\w*)
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      | (?P<op><=|>=|<>|!=|\.\.|\+=|[-+*/%^=<>()\[\]{},:;.|])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # int, float, string, param, name, quoted, op or end
    text: str
    value: object
    at: int

    @property
    def word(self) -> str:
        """The upper-case keyword, or nothing."""
        return self.text.upper() if self.kind == "name" else ""


def _string(raw: str) -> str:
    mark, body = raw[0], raw[1:-1]
    body = body.replace(mark * 2, mark)
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), body)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected character {text[at]!r} at {at}")
        kind, raw, at = m.lastgroup, m.group(), m.end()
        if kind == "skip":
            continue
        value: object = raw
        if kind == "int":
            value = int(raw, 0) if raw[:2].lower() in ("0x", "0o") else int(raw)
        elif kind == "float":
            value = float(raw)
        elif kind == "string":
            value = _string(raw)
        elif kind == "param":
            value = raw[1:]
        elif kind == "quoted":
            value = raw[1:-1].replace("``", "`")
        out.append(Token(kind, raw, value, m.start()))
        if raw == ";":  # what stands after the end of a statement is not read
            break
    return [*out, Token("end", "", None, len(text))]
