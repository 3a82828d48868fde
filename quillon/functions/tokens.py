"""A small SQL lexer: enough to find names, calls and clauses in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      |(?P<name>(?:[A-Za-z_][\w$]*|"[^"]+"|`[^`]+`)(?:\.(?:[A-Za-z_][\w$]*|"[^"]+"|`[^`]+`))*(?:\.\*)?)|(?P<op>::|<=|>=|<>|!=|\|\||=>|->|[-+*/%(),;=<>.\[\]:?{}@!&|~^$])""",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str
    text: str

    def is_word(self, *words: str) -> bool:
        return self.kind == "name" and self.text.upper() in words


def lex(sql: str, spaces: bool = False) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = PATTERN.match(sql, at)
        if not m:
            raise ValueError(f"cannot read SQL at {sql[at : at + 30]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group()))
        elif spaces:
            out.append(Token("space", " "))
        at = m.end()
    return out


def text_of(tokens: Iterable[Token]) -> str:
    """SQL of tokens, a space between words and none inside calls."""
    out = ""
    for t in tokens:
        tight = t.text in (",", ")", ".", "::", "]", "[", ";") or out.endswith(("(", ".", "::", "[")) or not out
        call = t.text == "(" and re.search(r"\w$|[`\"]$", out) and not re.search(r"\b(AND|OR|NOT|IN|ON|WHEN|THEN|ELSE|BY|AS|OVER|BETWEEN|FROM|SELECT|WHERE|UNION|ALL|USING|EXISTS|LIKE|IS|VALUES|HAVING|CASE)$", out, re.I)
        out += t.text if tight or call else f" {t.text}"
    return out


def unquote(name: str) -> str:
    return ".".join(p.strip('"`') for p in re.findall(r'"[^"]+"|`[^`]+`|[^.]+', name))


def close_of(tokens: list[Token], at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}") if tokens[k].kind == "op" else 0
        if depth == 0:
            return k
    raise ValueError("unbalanced parentheses")


def split_top(tokens: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts between separators outside all parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "op":
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        if depth == 0 and t.kind == "op" and t.text == by:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def own_names(tokens: list[Token]) -> list[bool]:
    """Which tokens may name something of the statement around: outside subqueries all names, inside only "alias.name" of aliases that the subquery does not make."""
    out = [t.kind == "name" for t in tokens]
    at = 0
    while at < len(tokens):
        if tokens[at].text == "(" and tokens[at].kind == "op" and at + 1 < len(tokens) and tokens[at + 1].is_word("SELECT", "WITH", "FROM", "TABLE"):
            end = close_of(tokens, at)
            bare = {unquote(t.text).lower() for t in tokens[at:end] if t.kind == "name" and "." not in t.text}
            for k in range(at, end):
                out[k] = out[k] and "." in tokens[k].text and unquote(tokens[k].text).lower().split(".")[0] not in bare
            at = end
        at += 1
    return out
