"""A lexer for the SQL dialects, and the tree of parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class DialectError(ValueError):
    """The statement can't be read, or can't be run faithfully."""


@dataclass
class Tok:
    kind: str  # word, ident, string, number, param, op
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


@dataclass
class Group:
    items: list = field(default_factory=list)
    kind: str = "group"
    up: str = ""


_TOKEN = {
    "common": r"""
    (?P<skip>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>0[xX][0-9A-Fa-f]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<op>::|<=>|->>|->|!~\*|!~|~\*|<>|!=|>=|<=|==|\|\||&&|:=|[-+*/%&|^~<>=.,;?:!])
  | (?P<open>\()
  | (?P<close>\))
    """,
    "tsql": r"""(?P<string>[nN]?'(?:[^']|'')*') | (?P<ident>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*") | (?P<param>@@?\w+) | (?P<word>[\#]{0,2}[^\W\d][\w$\#]*)""",
    "postgres": r"""(?P<string>[eE]?'(?:[^']|'')*') | (?P<ident>"(?:[^"]|"")*") | (?P<param>\$\d+) | (?P<word>[^\W\d][\w$]*) | (?P<bracket>[\[\]])""",
    "mysql": r"""(?P<string>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*") | (?P<ident>`(?:[^`]|``)*`) | (?P<param>@@?\w+) | (?P<word>[^\W\d][\w$]*)""",
}
_COMPILED = {d: re.compile(_TOKEN[d] + "|" + _TOKEN["common"], re.X | re.S) for d in ("tsql", "postgres", "mysql")}


def tokenize(sql: str, dialect: str) -> list[Tok]:
    """Tokens without white space and comments; strings and identifiers hold their values."""
    out, at, pattern = [], 0, _COMPILED[dialect]
    while at < len(sql):
        m = pattern.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character {sql[at]!r}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            continue
        if kind == "string":
            q = text[-1]
            body = text[text.index(q) + 1 : -1].replace(q * 2, q)
            text = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(x[1], x[1]), body) if dialect == "mysql" else body
        elif kind == "ident":
            text = text[1:-1].replace(text[-1] * 2, text[-1])
        elif kind == "bracket":
            kind = "op"
        out.append(Tok(kind, text))
    return out


def tree(tokens: list[Tok]) -> list:
    """Tokens with each pair of parentheses as a Group."""
    stack = [[]]
    for t in tokens:
        if t.kind == "open":
            stack.append([])
        elif t.kind == "close":
            if len(stack) == 1:
                raise DialectError("unbalanced parenthesis")
            items = stack.pop()
            stack[-1].append(Group(items))
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise DialectError("unbalanced parenthesis")
    return stack[0]


def split(items: list, at: str) -> list[list]:
    """Parts between the top-level operators ``at`` (an empty list for no items)."""
    parts = [[]]
    for x in items:
        if x.kind == "op" and x.text == at:
            parts.append([])
        else:
            parts[-1].append(x)
    return parts if items else []


def statements(sql: str, dialect: str) -> list[list]:
    """The statements of a text as trees; in T-SQL lines of GO part batches."""
    if dialect == "tsql":
        sql = re.sub(r"(?im)^\s*go\s*$", ";", sql)
    return [s for s in split(tree(tokenize(sql, dialect)), ";") if s]


def find(items: list, *words: str, start: int = 0) -> int:
    """Index of the first of a run of words, -1 if there is none."""
    for i in range(start, len(items) - len(words) + 1):
        if all(getattr(items[i + k], "up", "") == w for k, w in enumerate(words)):
            return i
    return -1
