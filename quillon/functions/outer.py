"""The SQL around semantic views: QUALIFY, and where NULLs sort."""

from __future__ import annotations

from quillon.functions.tokens import Token, close_of, split_top, unquote

SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
COMMA = Token("op", ",")


def top(tokens: list[Token], *words: str, start: int = 0) -> int | None:
    """Index of the first of the words outside parentheses."""
    depth = 0
    for k in range(start, len(tokens)):
        if tokens[k].kind == "op":
            depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}")
        if depth == 0 and tokens[k].is_word(*words):
            return k
    return None


def segments(tokens: list[Token]) -> list[list[Token]]:
    """SELECTs and the set words between them, in order."""
    out, at = [], 0
    while (k := top(tokens, *SETS, start=at)) is not None:
        end = k + 1 + tokens[k + 1].is_word("ALL", "DISTINCT")
        out += [tokens[at:k], tokens[k:end]]
        at = end
    return [*out, tokens[at:]]


def order_nulls(tokens: list[Token]) -> list[Token]:
    """ORDER BY with NULLs as the largest values wherever it does not say: last when ascending, first when descending."""
    out, at = [], 0
    while at < len(tokens):
        t = tokens[at]
        if t.text == "(" and t.kind == "op":
            end = close_of(tokens, at)
            out += [t, *order_nulls(tokens[at + 1 : end]), tokens[end]]
            at = end + 1
        elif t.is_word("ORDER") and at + 1 < len(tokens) and tokens[at + 1].is_word("BY"):
            end = top(tokens, "ROWS", "RANGE", "LIMIT", "OFFSET", "FETCH", *SETS, start=at + 2)
            end = len(tokens) if end is None else end
            items = []
            for item in split_top(order_nulls(tokens[at + 2 : end])):
                if not any(x.is_word("NULLS") for x in item):
                    item = [*item, Token("name", "NULLS"), Token("name", "FIRST" if item[-1].is_word("DESC") else "LAST")]
                items += [*item, COMMA]
            out += [*tokens[at : at + 2], *items[:-1]]
            at = end
        else:
            out.append(t)
            at += 1
    return out


def _shown(select: list[Token], source: int) -> set[str]:
    """Names of a SELECT's output."""
    out = set()
    for item in split_top(select[1:source]):
        if item[-1].kind == "name":
            out.add(unquote(item[-1].text).split(".")[-1].lower())
    return out


def qualify(select: list[Token]) -> list[Token]:
    """A SELECT with QUALIFY as a filter over its output; others as they are. What ORDER BY needs besides the output travels as hidden columns."""
    at, source = top(select, "QUALIFY"), top(select, "FROM")
    if at is None or source is None:
        return select
    order, end = top(select, "ORDER", start=at + 1), top(select, "ORDER", "LIMIT", start=at + 1)
    end = len(select) if end is None else end
    used = {unquote(t.text).lower() for t in select if t.kind == "name"}
    hide = "__kept"
    while any(u.startswith(hide) for u in used):
        hide += "_"
    name = lambda *words: [Token("name", w) for w in words]
    op = lambda s: Token("op", s)
    hidden = [op(","), op("("), *select[at + 1 : end], op(")"), *name("AS", hide)]
    names, tail = [hide], select[end:]
    if order == end and order is not None:
        stop = top(select, "LIMIT", "OFFSET", "FETCH", start=order)
        stop = len(select) if stop is None else stop
        shown, items = _shown(select, source), []
        for item in split_top(select[order + 2 : stop]):
            how = next((k for k, t in enumerate(item) if k and t.is_word("ASC", "DESC", "NULLS")), len(item))
            key = item[:how]
            if not (len(key) == 1 and (key[0].kind == "number" or unquote(key[0].text).lower() in shown)):
                names.append(f"{hide}{len(names)}")
                hidden += [op(","), *key, *name("AS", names[-1])]
                key = name(names[-1])
            items += [*key, *item[how:], COMMA]
        tail = [*select[order : order + 2], *items[:-1], *select[stop:]]
    inner = [*select[:source], *hidden, *select[source:at]]
    left = [t for n in names for t in (*name(n), COMMA)][:-1]
    return [*name("SELECT"), op("*"), *name("EXCEPT"), op("("), *left, op(")"), *name("FROM"), op("("), *inner, op(")"), *name("WHERE", hide), *tail]
