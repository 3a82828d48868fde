"""Rewrites of the warehouse dialect to Spark SQL, token by token.

Each function is named with what it becomes; what Spark runs as it stands is
left alone. A bare division becomes try_divide: a zero divisor gives NULL where
Spark would end the job.
"""

from __future__ import annotations

import re

from quillon.functions.tokens import Token, close_of, lex, split_top, text_of

UNITS = {"YEAR": ("add_months", 12), "QUARTER": ("add_months", 3), "MONTH": ("add_months", 1), "WEEK": ("date_add", 7), "DAY": ("date_add", 1)}
TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "NUMBER": "DECIMAL(38,0)", "FLOAT": "DOUBLE", "TIMESTAMP_LTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP_NTZ", "VARIANT": "VARIANT", "INTEGER": "INT"}
STOPS = {"SELECT", "WHEN", "THEN", "ELSE", "AND", "OR", "NOT", "CASE", "BETWEEN", "IN", "LIKE", "BY", "FROM", "WHERE", "ON", "AS", "HAVING", "IS", "RETURN", "DISTINCT"}


def _unit(arg: str) -> str:
    return arg.strip("'\" ").upper().rstrip("S")


def spark_type(name: str) -> str:
    m = re.fullmatch(r"(\w+)\s*(\(.*\))?", name.strip())
    base, args = m[1].upper(), m[2] or ""
    if base in ("NUMBER", "NUMERIC", "DECIMAL"):
        return f"DECIMAL{args.replace(' ', '') or '(38,0)'}"
    return TYPES.get(base, base) if base in TYPES else base + args


def _dateadd(unit: str, n: str, date: str) -> str:
    u = _unit(unit)
    if u in UNITS:
        f, k = UNITS[u]
        return f"{f}({date}, {n if k == 1 else f'{k} * ({n})'})"
    return f"timestampadd({u}, {n}, {date})"


def _trunc(unit: str, date: str) -> str:
    u = _unit(unit)
    return f"date_trunc('{u}', {date})" if u in ("HOUR", "MINUTE", "SECOND") else f"CAST(trunc({date}, '{u}') AS DATE)"


def _regexp_replace(*a: str) -> str:
    a = list(a) + ["''"] * (3 - len(a))
    return f"regexp_replace({', '.join([a[0], a[1], re.sub(r'[\\]{1,2}([0-9])', r'$\1', a[2]), *a[3:]])})"


CALLS = {
    "DIV0": lambda a, b: f"CASE WHEN ({b}) = 0 AND ({a}) IS NOT NULL THEN 0 ELSE try_divide({a}, {b}) END",
    "IFF": lambda c, a, b: f"if({c}, {a}, {b})",
    "DATEADD": _dateadd,
    "DATE_TRUNC": _trunc,
    "DATEDIFF": lambda u, a, b: f"datediff({b}, {a})" if _unit(u) == "DAY" else f"timestampdiff({_unit(u)}, {a}, {b})",
    "TO_VARCHAR": lambda a, *f: f"CAST({a} AS STRING)" if not f else f"to_varchar({a}, {f[0]})",
    "TRY_TO_BOOLEAN": lambda a: f"try_cast({a} AS BOOLEAN)",
    "SHA2": lambda a, n="256": f"sha2({a}, {n})",
    "REGEXP_REPLACE": _regexp_replace,
    "ARRAY_CONSTRUCT": lambda *a: f"array({', '.join(a)})",
    "ARRAY_CONTAINS": lambda x, arr: f"array_contains({arr}, {x})",
    "ARRAY_CAT": lambda a, b: f"concat({a}, {b})",
    "ARRAY_TO_STRING": lambda a, s: f"array_join({a}, {s})",
    "ARRAY_SIZE": lambda a: f"size({a})",
    "OBJECT_CONSTRUCT": lambda *a: f"to_json(struct({', '.join(a)}))" if a == ("*",) else f"to_json(map({', '.join(a)}))",
    "UUID_STRING": lambda: "uuid()",
    "BOOLOR_AGG": lambda a: f"bool_or({a})",
    "BOOLAND_AGG": lambda a: f"bool_and({a})",
    "COUNT_IF": lambda a: f"count_if({a})",
    "ANY_VALUE": lambda a: f"max({a})",  # any value will do, and this one is the same each time
    "CURRENT_DATE": lambda: "current_date()",
    "CURRENT_TIMESTAMP": lambda: "current_timestamp()",
    "REGR_SLOPE": lambda y, x: f"regr_slope({y}, {x})",
}
#: Names that a rewrite gives a VARIANT: the values of FLATTEN.
VARIANTS = {"VALUE", "THIS"}
#: Dates that quoted fields hold count as they are: no rewrite reaches into strings.


def _primary(tokens: list[Token], at: int) -> int:
    """End of the operand that starts at ``at``."""
    while tokens[at].text in ("-", "+"):
        at += 1
    if tokens[at].is_word("CASE"):
        depth = 0
        for k in range(at, len(tokens)):
            depth += tokens[k].is_word("CASE") - tokens[k].is_word("END")
            if not depth:
                return k + 1
    end = close_of(tokens, at) + 1 if tokens[at].text == "(" else at + 1
    if end < len(tokens) and tokens[at].kind == "name" and tokens[end].text == "(":
        end = close_of(tokens, end) + 1
        if end + 1 < len(tokens) and tokens[end].is_word("OVER") and tokens[end + 1].text == "(":
            end = close_of(tokens, end + 1) + 1
    while end + 1 < len(tokens) and tokens[end].text == "::":
        end += 2
        if end < len(tokens) and tokens[end].text == "(":
            end = close_of(tokens, end) + 1
    return end


def _divide(tokens: list[Token]) -> list[Token]:
    """a * b / c -> try_divide(a * b, c), leftmost first; parentheses are done already."""
    while True:
        at = next((k for k, t in enumerate(tokens) if t.kind == "op" and t.text == "/"), None)
        if at is None:
            return tokens
        start, depth = at, 0
        while start > 0:
            t = tokens[start - 1]
            if t.text == ")":
                depth += 1
            elif t.text == "(":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and ((t.kind == "op" and t.text not in ("*", "::", ".")) or (t.kind == "name" and t.text.upper() in STOPS)):
                break
            start -= 1
        end = _primary(tokens, at + 1)
        call = [Token("name", "try_divide"), Token("op", "("), *tokens[start:at], Token("op", ","), *tokens[at + 1 : end], Token("op", ")")]
        tokens = [*tokens[:start], *call, *tokens[end:]]


def _listagg(tokens: list[Token], at: int) -> tuple[list[Token], int]:
    """LISTAGG in the order said, else of its values; text of no rows is empty. A window's is an array of its rows."""
    end = close_of(tokens, at + 1)
    args = split_top(tokens[at + 2 : end])
    distinct = args[0][0].is_word("DISTINCT")
    value = f"CAST({text_of(rewrite_tokens(args[0][distinct:]))} AS STRING)"
    sep = text_of(rewrite_tokens(args[1])) if len(args) > 1 else "''"
    order, at = f"ORDER BY {value}", end + 1
    if at + 1 < len(tokens) and tokens[at].is_word("WITHIN") and tokens[at + 1].is_word("GROUP"):
        end = close_of(tokens, at + 2)
        order, at = text_of(rewrite_tokens(tokens[at + 3 : end])), end + 1
    if at < len(tokens) and tokens[at].is_word("OVER"):
        end = close_of(tokens, at + 1)
        held = f"collect_{'set' if distinct else 'list'}({value}) {text_of(rewrite_tokens(tokens[at : end + 1]))}"
        return lex(f"array_join(sort_array({held}), {sep})"), end + 1
    return lex(f"coalesce(listagg({'DISTINCT ' if distinct else ''}{value}, {sep}) WITHIN GROUP ({order}), '')"), at


def _operand(out: list[Token]) -> int:
    """Where the operand starts that ends ``out``."""
    start = len(out) - 1
    while out[start].text in (")", "]"):
        depth = 0
        while True:
            depth += (out[start].text in ")]") - (out[start].text in "([")
            if depth == 0:
                break
            start -= 1
        if start and (out[start].text == "[" or out[start - 1].kind == "name" and out[start - 1].text.upper() not in STOPS):
            start -= 1
    return start


def _variant(tokens: list[Token]) -> str:
    """An expression as a VARIANT: what is none yet is read as JSON text."""
    text = text_of(rewrite_tokens(tokens))
    last = tokens[-1].text.split(".")[-1].strip('"`').upper()
    known = len(tokens) == 1 and last in VARIANTS or tokens[0].is_word("PARSE_JSON", "TRY_PARSE_JSON", "VARIANT_GET", "TRY_VARIANT_GET") and close_of(tokens, 1) == len(tokens) - 1
    return text if known else f"try_parse_json(CAST({text} AS STRING))"


def _path(tokens: list[Token], at: int) -> tuple[str, int]:
    """A path after a colon as a JSON path, and where it ends."""
    out = "$"
    while True:
        for part in re.findall(r'"[^"]+"|[^."]+', tokens[at].text):
            out += f"['{part[1:-1]}']" if part[0] == '"' else f".{part}"
        at += 1
        while at < len(tokens) and tokens[at].text == "[":
            end = close_of(tokens, at)
            key = tokens[at + 1]
            out += f"[{key.text}]" if key.kind == "number" else f"['{key.text[1:-1]}']"
            at = end + 1
        if not (at + 1 < len(tokens) and tokens[at].text == "." and tokens[at + 1].kind == "name"):
            return out, at
        at += 1


def _flatten(tokens: list[Token], at: int) -> str:
    """FLATTEN(INPUT => x, OUTER => TRUE, PATH => 'a.b') as a subquery over variant_explode, with key, path, index, value and this."""
    named = {}
    for k, part in enumerate(split_top(tokens[at + 2 : close_of(tokens, at + 1)])):
        said = len(part) > 2 and part[1].text == "=>"
        named[part[0].text.upper() if said else ("INPUT", "PATH")[k]] = part[2:] if said else part
    this, prefix = _variant(named["INPUT"]), ""
    if "PATH" in named:
        prefix = named["PATH"][0].text[1:-1]
        this = f"try_variant_get({this}, '$.{prefix}', 'variant')"
    outer = named.get("OUTER", [Token("name", "FALSE")])[0].is_word("TRUE")
    step = f"CASE WHEN key IS NULL THEN '{prefix}[' || pos || ']' ELSE '{prefix + '.' if prefix else ''}' || key END"
    columns = f"key, CASE WHEN pos IS NOT NULL THEN {step} END AS path, CASE WHEN key IS NULL THEN pos END AS index, value"
    return f"(SELECT {columns}, {this} AS this FROM variant_explode{'_outer' if outer else ''}({this}))"


def rewrite_tokens(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(tokens):
        t = tokens[at]
        if t.kind == "name" and '"' in t.text:
            t = t._replace(text=t.text.replace('"', "`"))
        if t.is_word("LISTAGG") and at + 1 < len(tokens) and tokens[at + 1].text == "(":
            made, at = _listagg(tokens, at)
            out += made
        elif t.is_word("FLATTEN") and at + 1 < len(tokens) and tokens[at + 1].text == "(":
            end = close_of(tokens, at + 1) + 1
            if len(out) > 1 and out[-1].text == "(" and out[-2].is_word("TABLE"):  # TABLE(FLATTEN(...))
                out, end = out[:-2], end + 1
            out += [] if out and out[-1].is_word("LATERAL") else [Token("name", "LATERAL")]
            out += lex(_flatten(tokens, at))
            at = end
        elif t.is_word("TABLE") and at + 2 < len(tokens) and tokens[at + 1].text == "(" and tokens[at + 2].is_word("FLATTEN"):
            out += [t, tokens[at + 1]]
            at += 2
        elif t.text == ":" and out and at + 1 < len(tokens) and tokens[at + 1].kind == "name" and (out[-1].kind == "name" or out[-1].text in (")", "]")):
            path, end = _path(tokens, at + 1)
            start, kind = _operand(out), "variant"
            if end < len(tokens) and tokens[end].text == "::":
                stop = end + 2
                if stop < len(tokens) and tokens[stop].text == "(":
                    stop = close_of(tokens, stop) + 1
                kind, end = spark_type("".join(x.text for x in tokens[end + 1 : stop])), stop
            out = [*out[:start], *lex(f"try_variant_get({_variant(out[start:])}, '{path}', '{kind.lower()}')")]
            at = end
        elif t.kind == "name" and at + 1 < len(tokens) and tokens[at + 1].text == "(" and t.text.upper() in CALLS:
            end = close_of(tokens, at + 1)
            args = [text_of(rewrite_tokens(a)) for a in split_top(tokens[at + 2 : end])]
            out += lex(CALLS[t.text.upper()](*args))
            at = end + 1
        elif t.text == "(":
            end = close_of(tokens, at)
            out += [t, *rewrite_tokens(tokens[at + 1 : end]), tokens[end]]
            at = end + 1
        elif t.text == "::" and out:
            end = at + 2
            if end < len(tokens) and tokens[end].text == "(":
                end = close_of(tokens, end) + 1
            kind = spark_type("".join(x.text for x in tokens[at + 1 : end]))
            start = _operand(out)
            out = [*out[:start], *lex(f"CAST({text_of(out[start:])} AS {kind})")]
            at = end
        else:
            out.append(t)
            at += 1
    return _divide(out)


def to_spark(sql: str) -> str:
    """A warehouse expression as Spark SQL."""
    return text_of(rewrite_tokens(lex(sql)))

