"""From names to Spark SQL.

A query's base metrics fall into branches by (entity, paths to the dimensions
asked for). Each branch joins only the tables it needs, filters, and
aggregates at its own grain; the branches meet in one union that a single
grouping folds, which is a null-safe full outer join with one shuffle. Derived
and window metrics are projections over that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from quillon.errors import AccessError, QueryError
from quillon.functions.dialect import spark_type, to_spark
from quillon.functions.tokens import close_of, lex, own_names, split_top, text_of, unquote, Token
from quillon.model.schema import AGGREGATES, Item, Relationship, SemanticView, has_aggregate, is_window
from quillon.plans.paths import Edge, JoinGraph


#: Whole digits that a constant of a decimal type has at least, if its type has them.
LEAST_WHOLE = 18


def quote(name: str) -> str:
    return f"`{name}`"


def constant_type(text: str, kind: str) -> str:
    """The type to write a constant in: a decimal one of its scale, with no more whole digits than LEAST_WHOLE or the value takes.

    Next to NUMBER's 38 whole digits a comparison has no room for fractions: Spark would round 250000.30 to 250000 before it compares.
    """
    m = re.fullmatch(r"DECIMAL\((\d+)(?:,(\d+))?\)", kind)
    if not m:
        return kind
    scale = int(m[2] or 0)
    try:
        value = Decimal("0" if text.upper() == "NULL" else text.strip("'").replace(" ", ""))
        digits = value.scaleb(scale).to_integral_value(ROUND_HALF_UP).adjusted() + 1 if value.is_finite() else int(m[1])
    except ArithmeticError:  # an expression, or no number of any such type
        digits = int(m[1])
    return f"DECIMAL({min(int(m[1]), max(LEAST_WHOLE + scale, digits))},{scale})"


@dataclass
class Query:
    dimensions: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)
    facts: list[str] = field(default_factory=list)
    where: str | None = None
    variables: dict[str, object] = field(default_factory=dict)


@dataclass
class Branch:
    entity: str
    paths: dict[str, tuple[Edge, ...]]
    metrics: list[Item]
    non_additive: list[tuple[str, str]]


class Compiler:
    """Compiles queries on one view, by alias: physical columns, secured sources, columns not to be projected, least group sizes."""

    def __init__(self, view: SemanticView, columns: dict[str, list[str]], sources: dict[str, str] | None = None, hidden: dict[str, set[str]] | None = None, least: dict[str, int] | None = None):
        self.view, self.columns = view, {k.lower(): [c.lower() for c in v] for k, v in columns.items()}
        self.graph, self.sources, self.hidden, self.least = JoinGraph(view), sources or {}, hidden or {}, least or {}
        self.variables: dict[str, str] = {}

    # names -----------------------------------------------------------------

    def one(self, kind: str, ref: str) -> Item:
        found = self.view.find(kind, ref)
        if not found:
            other = " (it is a fact)" if kind == "dimension" and self.view.find("fact", ref) else ""
            raise QueryError(f"no {kind} named {ref}{other}")
        if len(found) > 1:
            raise QueryError(f"ambiguous {kind} '{ref}': {', '.join(i.label for i in found)}")
        if found[0].extras.private:
            raise QueryError(f"no {kind} named {ref}")
        return found[0]

    def bind(self, given: dict[str, object]) -> None:
        known = {v.name.lower(): v for v in self.view.variables}
        for name in given:
            if name.lower() not in known:
                raise QueryError(f"unknown variable '{name}'")
        low = {k.lower(): v for k, v in given.items()}
        for name, v in known.items():
            if name in low:
                x = low[name]
                text = "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
            elif v.default is not None:
                text = to_spark(v.default)
            else:
                raise QueryError(f"variable '{v.name}' is required")
            self.variables[name] = f"CAST({text} AS {constant_type(text, spark_type(v.type))})"

    def entities(self, item: Item, seen: frozenset = frozenset()) -> set[str]:
        """Tables that an item's expression reads, its own among them."""
        out = {item.entity.lower()} if item.entity else set()
        for t in lex(item.expr):
            if t.kind == "name" and "." in t.text:
                alias, name = unquote(t.text).lower().split(".")[-2:]
                if self.view.has_table(alias):
                    out.add(alias)
                    for inner in self.view.find("fact", f"{alias}.{name}") or self.view.find("dimension", f"{alias}.{name}"):
                        if inner.label not in seen and inner is not item and not has_aggregate(inner.expr):
                            out |= self.entities(inner, seen | {item.label})
        return out

    # expressions ------------------------------------------------------------

    def expr(self, sql: str, entity: str | None, seen: frozenset = frozenset(), outer: frozenset = frozenset()) -> str:
        """An expression over joined aliases: facts and dimensions are written out, variables bound, the dialect rewritten."""
        tokens, out = lex(sql), []
        for k, (t, own) in enumerate(zip(tokens, own_names(tokens))):
            call = k + 1 < len(tokens) and tokens[k + 1].text == "("
            if not own or (call and "." not in t.text):
                out.append(t)
                continue
            out += lex(self._name(t.text, entity, seen, outer)) if t.text.upper() not in ("NULL", "TRUE", "FALSE") else [t]
        return to_spark(text_of(out))

    def _name(self, text: str, entity: str | None, seen: frozenset, outer: frozenset) -> str:
        parts = unquote(text).lower().split(".")
        if len(parts) > 1 and self.view.has_table(parts[-2]):
            return self._column(parts[-2], parts[-1], seen, text)
        if len(parts) > 1:
            return text
        if parts[0] in self.variables:
            return self.variables[parts[0]]
        if entity:
            own = self._column(entity.lower(), parts[0], seen, None)
            if own:
                return own
        for kind in ("dimension", "fact"):
            found = [i for i in self.view.find(kind, parts[0]) if i.label not in seen]
            if len(found) == 1 and found[0].entity:
                return f"({self.expr(found[0].expr, found[0].entity, seen | {found[0].label})})"
            if len(found) > 1 and not entity:
                raise QueryError(f"ambiguous {kind} '{text}'")
        return text

    def _column(self, alias: str, name: str, seen: frozenset, fallback: str | None) -> str | None:
        physical = name in self.columns.get(alias, [])
        for kind in ("fact", "dimension"):
            for i in self.view.find(kind, f"{alias}.{name}"):
                if i.label in seen:
                    continue
                if kind == "fact" and has_aggregate(i.expr):
                    return f"{quote(alias)}.{quote('__' + i.name.lower())}"
                # A name that is also a column means the column, unless the item says something else with another name.
                if physical and fallback is None:
                    break
                return f"({self.expr(i.expr, alias, seen | {i.label})})"
        if physical:
            return f"{quote(alias)}.{quote(name)}"
        return f"{quote(alias)}.{quote(name)}" if fallback else None

    # scans and joins ----------------------------------------------------------

    def scan(self, alias: str, entity_facts: list[Item]) -> str:
        source = self.sources.get(alias, self.view.table(alias).source).strip()
        if source.startswith("(") and close_of(tokens := lex(source), 0) < len(tokens) - 1:
            source = text_of(tokens[: close_of(tokens, 0) + 1])  # a secured table brings its own name along
        if not entity_facts:
            return f"{source} AS {quote(alias)}"
        joins, added = "", []
        for k, f in enumerate(entity_facts):
            child = next(iter(self.entities(f) - {alias}), None)
            if child is None:
                raise QueryError(f"fact '{f.label}' aggregates no other table")
            path = self.graph.choose(child, alias, f.using)
            if len(path) != 1:
                raise QueryError(f"fact '{f.label}' must aggregate a table that references '{alias}'")
            r = self.graph.relationship(path[0])
            keys = [f"{self.expr(x, child)} AS k{n}" for n, x in enumerate(r.left_keys)]
            made = self.expr(f.expr, child, frozenset({f.label}))
            groups = ", ".join(str(n + 1) for n in range(len(keys)))
            name = quote(f"__{f.name.lower()}")
            joins += f" LEFT JOIN (SELECT {', '.join(keys)}, {made} AS {name} FROM {self.scan(child, [])} GROUP BY {groups}) AS a{k} ON " + " AND ".join(f"{quote(alias)}.{quote(x)} = a{k}.k{n}" for n, x in enumerate(r.right_keys))
            added.append(f"a{k}.{name}")
        base = self.scan(alias, [])
        return f"(SELECT {quote(alias)}.*, {', '.join(added)} FROM {base}{joins}) AS {quote(alias)}"

    def _entity_facts(self, alias: str, texts: list[str]) -> list[Item]:
        mark = f"{quote(alias)}."
        return [f for f in self.view.facts if (f.entity or "").lower() == alias and has_aggregate(f.expr) and any(f"{mark}{quote('__' + f.name.lower())}" in x for x in texts)]

    def condition(self, r: Relationship, edge: Edge) -> tuple[str, str]:
        """(source of the joined side, ON condition)."""
        if edge.back:
            pairs = [f"{self._key(r.left, a)} = {self._key(r.right, b)}" for a, b in zip(r.left_keys, r.right_keys, strict=True)]
            return "", " AND ".join(pairs)
        pairs = [f"{self._key(r.left, a)} = {self._key(r.right, b)}" for a, b in zip(r.left_keys, r.right_keys, strict=False)]
        right, at = quote(r.right.lower()), self._key(r.left, r.left_keys[-1])
        if r.range:
            low, high = (f"{right}.{quote(x.lower())}" for x in r.range)
            return "", " AND ".join([*pairs, f"{at} >= {low}", f"{at} < {high}"])
        if r.asof:
            start = f"{right}.{quote(r.asof.lower())}"
            return "asof", " AND ".join([*pairs, f"{at} >= {start}", f"({right}.__until IS NULL OR {at} < {right}.__until)"])
        return "", " AND ".join(pairs)

    def _key(self, alias: str, key: str) -> str:
        return self.expr(f"{alias}.{key}", alias) if self.view.find("fact", f"{alias}.{key}") and key.lower() not in self.columns.get(alias.lower(), []) else (self._column(alias.lower(), key.lower(), frozenset(), None) or self.expr(key, alias))

    def joined(self, entity: str, paths: dict[str, tuple[Edge, ...]], texts: list[str]) -> str:
        """FROM clause of a branch: each table once; two ways to one table cannot share a branch."""
        came: dict[str, Edge] = {}
        order: list[Edge] = []
        for path in paths.values():
            for e in path:
                if e.end in came and came[e.end] != e:
                    raise QueryError(f"Multi-path relationship between the dimension entity '{e.end.upper()}' and the base metric or dimension entity '{entity.upper()}' is not supported.")
                if e.end not in came:
                    came[e.end] = e
                    order.append(e)
        conditions = {e: self.condition(self.graph.relationship(e), e) for e in order}
        texts = [*texts, *[c for _, c in conditions.values()]]
        out = self.scan(entity, self._entity_facts(entity, texts))
        for e in order:
            side, on = conditions[e]
            source = self.scan(e.end, self._entity_facts(e.end, texts))
            if side:
                r = self.graph.relationship(e)
                keys = ", ".join(quote(k.lower()) for k in r.right_keys)
                inner = source[: source.rindex(" AS ")]
                over = f"PARTITION BY {keys} ORDER BY {quote(r.asof.lower())}" if keys else f"ORDER BY {quote(r.asof.lower())}"
                inner = inner if inner.startswith("(") else f"(SELECT * FROM {inner})"
                source = f"(SELECT *, lead({quote(r.asof.lower())}) OVER ({over}) AS __until FROM {inner}) AS {quote(e.end)}"
            out += f" LEFT JOIN {source} ON {on}"
        return out

    # queries -------------------------------------------------------------------

    def _checked(self, text: str, alias: str | None = None) -> str:
        """An output expression, refused where a column that may not be projected reaches it otherwise than by COUNT."""
        tokens, at = lex(text) if self.hidden else [], 0
        while at < len(tokens):
            t = tokens[at]
            if t.is_word("COUNT") and at + 1 < len(tokens) and tokens[at + 1].text == "(":
                at = close_of(tokens, at + 1)
            elif t.kind == "name" and "." in t.text:
                home, column = unquote(t.text).lower().split(".")[-2:]
                if column in self.hidden.get(home, ()):
                    raise AccessError(f"column '{column}' of '{home}' may not be projected")
                for f in self.view.find("fact", f"{home}.{column[2:]}") if column.startswith("__") else []:
                    for child in self.entities(f):
                        self._checked(self.expr(f.expr, child, frozenset({f.label})))
            at += 1
        return text

    def compile(self, q: Query) -> str:
        if q.facts and q.metrics:
            raise QueryError("Cannot specify FACTS and METRICS in the same SEMANTIC_VIEW clause")
        if not (q.facts or q.metrics or q.dimensions):
            raise QueryError("a query names dimensions, metrics or facts")
        self.bind(q.variables)
        dims = [self.one("dimension", d) for d in q.dimensions]
        names = self._output_names(dims)
        if q.facts:
            return self._rows(dims, names, [self.one("fact", f) for f in q.facts], q.where)
        if not q.metrics:
            return self._distinct(dims, names, q.where)
        asked = [self.one("metric", m) for m in q.metrics]
        leaves: dict[str, Item] = {}
        for m in asked:
            self._leaves(m, leaves, frozenset())
        shown, extra = list(dims), []
        for m in asked:
            for w in self._windows(m):
                extra += [d for d in self._window_dims(w, dims) if d not in dims and d not in extra]
        dims, names = dims + extra, self._output_names(dims + extra)
        branches: dict[tuple, Branch] = {}
        for m in leaves.values():
            paths = self._paths(m.entity.lower(), [*dims, *self._filtered(q.where)], m)
            used = {k: v for k, v in paths.items() if v}
            key = (m.entity.lower(), tuple(sorted(used.items(), key=str)), tuple(m.non_additive))
            branches.setdefault(key, Branch(m.entity.lower(), used, [], m.non_additive)).metrics.append(m)
        ids = {m.label: f"__m{k}" for k, m in enumerate(leaves.values())}
        sql = self._stitch([self._branch(b, dims, names, q.where, ids) for b in branches.values()], list(branches.values()), names, ids)
        made = [f"{self._over(m, leaves, ids, shown, dims, names, frozenset())} AS {quote(m.name.lower())}" for m in asked]
        return f"SELECT {', '.join([*[quote(n) for n in names[: len(shown)]], *made])} FROM ({sql})"

    @staticmethod
    def _output_names(items: list[Item]) -> list[str]:
        low = [i.name.lower() for i in items]
        return [f"{i.entity.lower()}_{n}" if low.count(n) > 1 and low.index(n) != k else n for k, (i, n) in enumerate(zip(items, low, strict=True))]

    def _filtered(self, where: str | None) -> list[Item]:
        """Dimensions and facts that a filter names."""
        out = []
        tokens = lex(where or "")
        for t, own in zip(tokens, own_names(tokens)):
            if own:
                ref = unquote(t.text)
                found = [i for kind in ("dimension", "fact") for i in self.view.find(kind, ref)]
                out += [i for i in found[:1] if not (i.extras.private and "." not in ref)]
        return out

    def _same_source(self, a: str, b: str) -> bool:
        return self.view.table(a).source.lower() == self.view.table(b).source.lower()

    def _paths(self, entity: str, items: list[Item], m: Item | None) -> dict[str, tuple[Edge, ...]]:
        out: dict[str, tuple[Edge, ...]] = {}
        need = {e for i in items for e in self.entities(i)} | (self.entities(m) if m else set())
        for e in sorted(need - {entity}):
            if not self.graph.paths(entity, e) and self._same_source(entity, e):
                continue  # another alias of the metric's own table: read on the metric's row
            out[e] = self.graph.choose(entity, e, m.using if m else [])
        return out

    def _dim(self, d: Item, entity: str) -> str:
        home = d.entity.lower()
        if home != entity and not self.graph.paths(entity, home) and self._same_source(entity, home):
            return self.expr(d.expr, entity, frozenset({d.label}))
        return self.expr(d.expr, d.entity, frozenset({d.label}))

    def _where(self, where: str | None) -> str:
        return f" WHERE {self.expr(where, None)}" if where else ""

    def _rows(self, dims: list[Item], names: list[str], facts: list[Item], where: str | None) -> str:
        homes = {f.entity.lower() for f in facts}
        base = next((h for h in sorted(homes) if all(self.graph.paths(h, x) for x in homes)), None)
        if base is None:
            raise QueryError("facts of unrelated tables cannot be queried together")
        made = [(self._checked(self._dim(d, base)), n) for d, n in zip(dims, names, strict=True)] + [(self.expr(f"{f.entity}.{f.name}", f.entity) if not has_aggregate(f.expr) else self._column(f.entity.lower(), f.name.lower(), frozenset(), f.name), f.name.lower()) for f in facts]
        paths = self._paths(base, [*dims, *facts, *self._filtered(where)], None)
        texts = [self._checked(x) for x, _ in made] + [self._where(where)]
        return f"SELECT {', '.join(f'{x} AS {quote(n)}' for x, n in made)} FROM {self.joined(base, paths, texts)}{self._where(where)}"

    def _distinct(self, dims: list[Item], names: list[str], where: str | None) -> str:
        items = [*dims, *self._filtered(where)]
        need = sorted({e for i in items for e in self.entities(i)})
        base = next((e for e in need if all(self.graph.paths(e, x) for x in need)), None)
        if base is None:
            raise QueryError(f"The dimension entity '{need[-1].upper()}' must be related to and have an equal or lower level of granularity compared to the base metric or dimension entity '{need[0].upper()}'.")
        made = [self._checked(self._dim(d, base)) for d in dims]
        return f"SELECT DISTINCT {', '.join(f'{x} AS {quote(n)}' for x, n in zip(made, names, strict=True))} FROM {self.joined(base, self._paths(base, items, None), [*made, self._where(where)])}{self._where(where)}"

    def _branch(self, b: Branch, dims: list[Item], names: list[str], where: str | None, ids: dict[str, str]) -> str:
        made = [self._checked(self._dim(d, b.entity)) for d in dims]
        aggs = [self._checked(self.expr(m.expr, m.entity, frozenset())) for m in b.metrics]
        filters = self._where(where)
        rank = [(d, o) for d, o in b.non_additive if not any(x.name.lower() == d.lower().split(".")[-1] for x in dims)]
        ranked = [self._dim(self.one("dimension", d), b.entity) for d, _ in rank]
        paths = dict(b.paths) | self._paths(b.entity, [self.one("dimension", d) for d, _ in rank], None) if rank else b.paths
        source = self.joined(b.entity, paths, [*made, *aggs, *ranked, filters])
        columns = [f"{x} AS {quote(n)}" for x, n in zip(made, names, strict=True)]
        group = f" GROUP BY {', '.join(str(k + 1) for k in range(len(made) + len(rank)))}" if made or rank else ""
        values = [f"{x} AS {ids[m.label]}" for x, m in zip(aggs, b.metrics, strict=True)]
        met = {b.entity, *(e.end for path in paths.values() for e in path)}
        least = max((k for alias, k in self.least.items() if alias in met), default=0)
        if not rank:
            having = f" HAVING count(*) >= {least}" if least else ""
            return f"SELECT {', '.join([*columns, *values])} FROM {source}{filters}{group}{having}"
        # Each snapshot is aggregated by itself, then the last one in the order said is taken: partial sums, no ranking of
        # rows. Of several orders the last decides within equal values of those before it, so they are folded from the last on.
        snaps = [f"{x} AS __s{k}" for k, x in enumerate(ranked)]
        rows = ["count(*) AS __n"] if least else []
        out = f"SELECT {', '.join([*columns, *snaps, *values, *rows])} FROM {source}{filters}{group}"
        known = " AND ".join(f"__s{k} IS NOT NULL" for k in range(len(snaps)))
        for k in range(len(snaps) - 1, -1, -1):
            pick = "min_by" if rank[k][1].upper().startswith("DESC") else "max_by"
            left = [*[quote(n) for n in names], *[f"__s{j}" for j in range(k)]]
            last = [f"{pick}({ids[m.label]}, __s{k}) AS {ids[m.label]}" for m in b.metrics]
            by = f" GROUP BY {', '.join(str(j + 1) for j in range(len(left)))}" if left else ""
            having = f" HAVING sum(__n) >= {least}" if least and k == 0 else ""
            folded = ["sum(__n) AS __n"] if least and k else []
            out = f"SELECT {', '.join([*left, *last, *folded])} FROM ({out})" + (f" WHERE {known}" if k == len(snaps) - 1 else "") + by + having
        return out

    @staticmethod
    def _stitch(parts: list[str], branches: list[Branch], names: list[str], ids: dict[str, str]) -> str:
        if len(parts) == 1:
            return parts[0]
        keys = [quote(n) for n in names]
        rows = []
        for sql, b in zip(parts, branches, strict=True):
            own = {ids[m.label] for m in b.metrics}
            rows.append(f"SELECT {', '.join([*keys, *[i if i in own else f'NULL AS {i}' for i in ids.values()]])} FROM ({sql})")
        folded = [f"max({i}) AS {i}" for i in ids.values()]
        group = f" GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}" if keys else ""
        return f"SELECT {', '.join([*keys, *folded])} FROM ({' UNION ALL '.join(rows)}){group}"

    # derived and window metrics -----------------------------------------------

    def _is_base(self, m: Item) -> bool:
        return bool(m.entity) and has_aggregate(m.expr) and not is_window(m.expr)

    def _references(self, m: Item) -> list[tuple[Token, Item]]:
        out = []
        for t in lex(m.expr):
            if t.kind == "name":
                found = [x for x in self.view.find("metric", unquote(t.text)) if x is not m]
                if len(found) > 1 and m.entity:
                    found = [x for x in found if x.entity == m.entity] or found
                if len(found) == 1:
                    out.append((t, found[0]))
        return out

    def _leaves(self, m: Item, into: dict[str, Item], seen: frozenset) -> None:
        if m.label in seen:
            raise QueryError(f"metric '{m.label}' refers to itself")
        if self._is_base(m):
            into.setdefault(m.label, m)
            return
        refs = self._references(m)
        if not refs:
            raise QueryError(f"metric '{m.label}' refers to no metric")
        for _, x in refs:
            self._leaves(x, into, seen | {m.label})

    def _windows(self, m: Item) -> list[Item]:
        if self._is_base(m):
            return []
        return [m] * is_window(m.expr) + [w for _, x in self._references(m) for w in self._windows(x)]

    def _window_parts(self, m: Item) -> tuple[list[Token], list[list[Token]] | None, list[list[Token]], list[list[Token]], list[Token]]:
        """(call, excluded or None, partition, order, frame) of the first OVER."""
        tokens = lex(m.expr)
        at = next(k for k, t in enumerate(tokens) if t.is_word("OVER"))
        inside = tokens[at + 2 : close_of(tokens, at + 1)]
        marks = {w: next((k for k, t in enumerate(inside) if t.is_word(w)), None) for w in ("PARTITION", "ORDER", "ROWS", "RANGE")}
        frame_at = next((x for x in (marks["ROWS"], marks["RANGE"]) if x is not None), len(inside))
        order_at = marks["ORDER"] if marks["ORDER"] is not None else frame_at
        part = inside[marks["PARTITION"] + 2 : order_at] if marks["PARTITION"] is not None else []
        excluded = split_top(part[1:]) if part and part[0].is_word("EXCLUDING") else None
        order = split_top(inside[order_at + 2 : frame_at]) if marks["ORDER"] is not None else []
        return tokens[:at], excluded, [] if excluded is not None else split_top(part), order, inside[frame_at:]

    def _window_dims(self, m: Item, dims: list[Item]) -> list[Item]:
        _, _, part, order, _ = self._window_parts(m)
        for o in order:
            d = self.one("dimension", unquote(o[0].text))
            if d not in dims:
                raise QueryError(f"window metric '{m.label}' orders by '{d.name}', which must be queried")
        return [self.one("dimension", unquote(p[0].text)) for p in part]

    def _over(self, m: Item, leaves: dict[str, Item], ids: dict[str, str], shown: list[Item], dims: list[Item], names: list[str], seen: frozenset) -> str:
        if m.label in leaves:
            return ids[m.label]
        refs = {t.text: x for t, x in self._references(m)}

        def written(tokens: list[Token]) -> list[Token]:
            out: list[Token] = []
            for t in tokens:
                if t.kind == "name" and t.text in refs:
                    out += lex(f"({self._over(refs[t.text], leaves, ids, shown, dims, names, seen | {m.label})})")
                else:
                    out += lex(self.variables[t.text.lower()]) if t.kind == "name" and t.text.lower() in self.variables else [t]
            return out

        if not is_window(m.expr):
            return to_spark(text_of(written(lex(m.expr))))
        call, excluded, part, order, frame = self._window_parts(m)
        column = lambda t: quote(names[dims.index(self.one("dimension", unquote(t.text)))])
        if excluded is not None:
            out_of = [self.one("dimension", unquote(x[0].text)) for x in excluded]
            keys = [quote(names[dims.index(d)]) for d in shown if d not in out_of]
        else:
            keys = [column(p[0]) for p in part]
        sort = [" ".join([column(o[0]), *[t.text for t in o[1:]]]) for o in order]
        if frame and frame[0].is_word("ROWS") or not frame:  # ties would fall at random
            sort += [quote(n) for n in names[: len(shown)] if quote(n) not in " ".join([*sort, *keys])] if sort and frame else []
        over = (f"PARTITION BY {', '.join(keys)} " if keys else "") + (f"ORDER BY {', '.join(sort)} " if sort else "") + " ".join(t.text for t in frame)
        tokens = lex(m.expr)
        at = next(k for k, t in enumerate(tokens) if t.is_word("OVER"))
        rest = tokens[close_of(tokens, at + 1) + 1 :]
        return to_spark(f"{text_of(written(call))} OVER ({over.strip()}) {text_of(written(rest))}".strip())


__all__ = ["AGGREGATES", "Compiler", "Query"]
