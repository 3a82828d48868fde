"""Reader and writer of CREATE SEMANTIC VIEW text."""

from __future__ import annotations

from quillon.errors import DeployError
from quillon.functions.tokens import Token, close_of, lex, split_top, text_of, unquote
from quillon.model.schema import Extras, Item, Relationship, SemanticView, Table, Variable

SECTIONS = ("TABLES", "RELATIONSHIPS", "FACTS", "DIMENSIONS", "METRICS", "VARIABLES")


def _string(t: Token) -> str:
    return t.text[1:-1].replace("''", "'")


def _names(tokens: list[Token]) -> list[str]:
    return [unquote(p[0].text) for p in split_top(tokens)]


def _extras(tokens: list[Token]) -> tuple[list[Token], Extras]:
    """The tokens before WITH SYNONYMS, WITH TAG and COMMENT, and what those say."""
    x, cut, at = Extras(), len(tokens), 0
    depth = 0
    while at < len(tokens):
        t = tokens[at]
        depth += (t.text in ("(", "[")) - (t.text in (")", "]")) if t.kind == "op" else 0
        follows = tokens[at + 1] if at + 1 < len(tokens) else Token("op", "")
        if depth == 0 and t.is_word("WITH") and follows.is_word("SYNONYMS", "TAG"):
            cut = min(cut, at)
            start = next(k for k in range(at, len(tokens)) if tokens[k].text == "(")
            end = close_of(tokens, start)
            if follows.is_word("SYNONYMS"):
                x.synonyms = [_string(p[0]) for p in split_top(tokens[start + 1 : end])]
            else:
                x.tags = {unquote(p[0].text): _string(p[-1]) for p in split_top(tokens[start + 1 : end])}
            at = end
        elif depth == 0 and t.is_word("COMMENT") and follows.text == "=":
            cut = min(cut, at)
            x.comment = _string(tokens[at + 2])
            at += 2
        at += 1
    return tokens[:cut], x


def _table(tokens: list[Token]) -> Table:
    tokens, extras = _extras(tokens)
    first = tokens[0].text
    if tokens[0].text == "(":
        raise DeployError("a subquery table needs an alias")
    alias, source, at = unquote(first).split(".")[-1], unquote(first), 1
    if len(tokens) > 1 and tokens[1].is_word("AS"):
        if tokens[2].text == "(":
            end = close_of(tokens, 2)
            source, at = text_of(tokens[2 : end + 1]), end + 1
        else:
            source, at = unquote(tokens[2].text), 3
    t = Table(alias.lower(), source, extras=extras)
    while at < len(tokens):
        if tokens[at].is_word("PRIMARY"):
            end = close_of(tokens, at + 2)
            t.primary_key = _names(tokens[at + 3 : end])
        elif tokens[at].is_word("UNIQUE"):
            end = close_of(tokens, at + 1)
            t.unique.append(_names(tokens[at + 2 : end]))
        elif tokens[at].is_word("CONSTRAINT"):
            words = [x.text for x in tokens[at:]]
            low = next(k for k, w in enumerate(words) if w.upper() == "BETWEEN")
            t.distinct_range, end = (words[low + 1], words[low + 3]), at + low + 4
        else:
            raise DeployError(f"cannot read table '{alias}' at {tokens[at].text!r}")
        at = end + 1
    return t


def _relationship(tokens: list[Token]) -> Relationship:
    tokens, _ = _extras(tokens)
    name = None
    if len(tokens) > 1 and tokens[1].is_word("AS"):
        name, tokens = tokens[0].text, tokens[2:]
    end = close_of(tokens, 1)
    left, keys = unquote(tokens[0].text).lower(), _names(tokens[2:end])
    if not tokens[end + 1].is_word("REFERENCES"):
        raise DeployError("a relationship needs REFERENCES")
    right, rest = unquote(tokens[end + 2].text).lower(), tokens[end + 3 :]
    r = Relationship((name or f"{left}_to_{right}").lower(), left, keys, right, [])
    for part in split_top(rest[1:-1]) if rest else []:
        if part[0].is_word("BETWEEN"):
            r.range = (unquote(part[1].text), unquote(part[3].text))
        elif part[0].is_word("ASOF"):
            r.asof = unquote(part[1].text)
        else:
            r.right_keys.append(unquote(part[0].text))
    return r


def _item(tokens: list[Token]) -> Item:
    private = tokens[0].is_word("PRIVATE", "PUBLIC")
    is_private = tokens[0].is_word("PRIVATE")
    tokens = tokens[1:] if private else tokens
    tokens, extras = _extras(tokens)
    extras.private = is_private
    as_at = next((k for k, t in enumerate(tokens) if t.is_word("AS")), None)
    if as_at is None:
        raise DeployError(f"cannot read {text_of(tokens)!r}: no AS")
    head, body = tokens[1:as_at], tokens[as_at + 1 :]
    parts = unquote(tokens[0].text).split(".")
    i = Item(parts[-1], parts[-2].lower() if len(parts) > 1 else None, text_of(body), extras=extras)
    at = 0
    while at < len(head):
        start = next(k for k in range(at, len(head)) if head[k].text == "(")
        end = close_of(head, start)
        if head[at].is_word("USING"):
            i.using = [n.lower() for n in _names(head[start + 1 : end])]
        elif head[at].is_word("NON"):
            i.non_additive = [(unquote(p[0].text), p[1].text if len(p) > 1 else "ASC") for p in split_top(head[start + 1 : end])]
        else:
            raise DeployError(f"syntax error in '{i.name}' at {head[at].text!r}")
        at = end + 1
    depth = 0
    for k, t in enumerate(body):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.is_word("USING") and k + 1 < len(body) and body[k + 1].text == "(":
            raise DeployError(f"syntax error in '{i.name}': USING stands before AS")
    return i


def _variable(tokens: list[Token]) -> Variable:
    tokens, _ = _extras(tokens)
    at = next((k for k, t in enumerate(tokens) if t.is_word("DEFAULT")), len(tokens))
    return Variable(tokens[0].text, "".join(t.text for t in tokens[1:at]), text_of(tokens[at + 1 :]) or None)


def parse(sql: str) -> SemanticView:
    """A view from CREATE [OR REPLACE] SEMANTIC VIEW name TABLES (...) ... text."""
    tokens = lex(sql)
    tokens = tokens[:-1] if tokens and tokens[-1].text == ";" else tokens
    at = next((k for k, t in enumerate(tokens) if t.is_word("VIEW")), None)
    if at is None:
        raise DeployError("not a CREATE SEMANTIC VIEW")
    at += 1
    while tokens[at].is_word("IF", "NOT", "EXISTS"):
        at += 1
    view = SemanticView(unquote(tokens[at].text).split(".")[-1].lower(), [])
    at += 1
    readers = {"TABLES": (_table, view.tables), "RELATIONSHIPS": (_relationship, view.relationships), "FACTS": (_item, view.facts), "DIMENSIONS": (_item, view.dimensions), "METRICS": (_item, view.metrics), "VARIABLES": (_variable, view.variables)}
    while at < len(tokens):
        t = tokens[at]
        if t.is_word(*SECTIONS):
            end = close_of(tokens, at + 1)
            read, into = readers[t.text.upper()]
            into += [read(p) for p in split_top(tokens[at + 2 : end])]
            at = end + 1
        elif t.is_word("COMMENT"):
            view.extras.comment, at = _string(tokens[at + 2]), at + 3
        elif t.is_word("AI_SQL_GENERATION", "AI_QUESTION_CATEGORIZATION"):
            view.instructions[t.text.lower()], at = _string(tokens[at + 1]), at + 2
        elif t.is_word("AI_VERIFIED_QUERIES"):
            end = close_of(tokens, at + 1)
            view.verified_queries += [_verified(p) for p in split_top(tokens[at + 2 : end])]
            at = end + 1
        elif t.is_word("MAX_STALENESS"):
            view.max_staleness, at = _seconds(_string(tokens[at + 2])), at + 3
        elif t.is_word("WITH") and tokens[at + 1].is_word("TAG"):
            end = close_of(tokens, at + 2)
            view.extras.tags = {unquote(p[0].text): _string(p[-1]) for p in split_top(tokens[at + 3 : end])}
            at = end + 1
        elif t.is_word("COPY", "GRANTS"):
            at += 1
        else:
            raise DeployError(f"syntax error at {t.text!r}")
    return view


def _verified(tokens: list[Token]) -> dict:
    out, inside = {"name": unquote(tokens[0].text)}, tokens[tokens.index(Token("op", "(")) + 1 : -1]
    for k, t in enumerate(inside[:-1]):
        if t.is_word("QUESTION", "SQL", "VERIFIED_AT", "VERIFIED_BY", "ONBOARDING_QUESTION"):
            out[t.text.lower()] = _string(inside[k + 1]) if inside[k + 1].kind == "string" else inside[k + 1].text
    return out


def _seconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[unit.lower()[0]]


def _with(x: Extras) -> str:
    out = f" WITH SYNONYMS ({', '.join(_quoted(s) for s in x.synonyms)})" if x.synonyms else ""
    out += f" WITH TAG ({', '.join(f'{k} = {_quoted(v)}' for k, v in x.tags.items())})" if x.tags else ""
    return out + (f" COMMENT = {_quoted(x.comment)}" if x.comment else "")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def to_ddl(view: SemanticView) -> str:
    """Text that ``parse`` reads back to the same view."""
    tables = []
    for t in view.tables:
        tables.append(f"{t.alias} AS {t.source}" + (f" PRIMARY KEY ({', '.join(t.primary_key)})" if t.primary_key else "") + "".join(f" UNIQUE ({', '.join(u)})" for u in t.unique) + (f" CONSTRAINT {t.alias}_range DISTINCT RANGE BETWEEN {t.distinct_range[0]} AND {t.distinct_range[1]} EXCLUSIVE" if t.distinct_range else "") + _with(t.extras))
    joins = []
    for r in view.relationships:
        keys = [*r.right_keys, *([f"BETWEEN {r.range[0]} AND {r.range[1]} EXCLUSIVE"] if r.range else []), *([f"ASOF {r.asof}"] if r.asof else [])]
        joins.append(f"{r.name} AS {r.left}({', '.join(r.left_keys)}) REFERENCES {r.right}" + (f"({', '.join(keys)})" if keys else ""))

    def item(i: Item) -> str:
        using = f" USING ({', '.join(i.using)})" if i.using else ""
        non = f" NON ADDITIVE BY ({', '.join(f'{d} {o}' for d, o in i.non_additive)})" if i.non_additive else ""
        return f"{'PRIVATE ' if i.extras.private else ''}{i.label}{using}{non} AS {i.expr}{_with(i.extras)}"

    parts = [("TABLES", tables), ("RELATIONSHIPS", joins), ("FACTS", list(map(item, view.facts))), ("DIMENSIONS", list(map(item, view.dimensions))), ("METRICS", list(map(item, view.metrics))), ("VARIABLES", [f"{v.name} {v.type}" + (f" DEFAULT {v.default}" if v.default else "") for v in view.variables])]
    body = "\n".join(f"  {k} (\n    " + ",\n    ".join(v) + "\n  )" for k, v in parts if v)
    return f"CREATE OR REPLACE SEMANTIC VIEW {view.name}\n{body}" + (f"\n  COMMENT = {_quoted(view.extras.comment)}" if view.extras.comment else "")
