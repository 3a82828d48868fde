"""The semantic view: logical tables, relationships, facts, dimensions, metrics, variables."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from quillon.errors import DeployError
from quillon.functions.tokens import lex

AGGREGATES = {"SUM", "COUNT", "AVG", "MIN", "MAX", "ANY_VALUE", "COUNT_IF", "BOOLOR_AGG", "BOOLAND_AGG", "LISTAGG", "REGR_SLOPE", "MEDIAN", "STDDEV", "APPROX_COUNT_DISTINCT", "PERCENTILE"}


def has_aggregate(expr: str) -> bool:
    t = lex(expr)
    return any(a.kind == "name" and a.text.upper() in AGGREGATES and b.text == "(" for a, b in zip(t, t[1:]))


def is_window(expr: str) -> bool:
    return any(t.is_word("OVER") for t in lex(expr))


@dataclass
class Extras:
    """What changes no result: names for people, tags, who may see it."""

    synonyms: list[str] = field(default_factory=list)
    comment: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    private: bool = False


@dataclass
class Table:
    alias: str
    source: str  # a table's name, or a parenthesised SELECT
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    distinct_range: tuple[str, str] | None = None
    extras: Extras = field(default_factory=Extras)

    @property
    def is_query(self) -> bool:
        return self.source.lstrip().startswith("(")

    def keys(self) -> list[list[str]]:
        return [k for k in [self.primary_key, *self.unique] if k]


@dataclass
class Relationship:
    name: str
    left: str
    left_keys: list[str]
    right: str
    right_keys: list[str]  # equal keys; the last left key belongs to range or asof where there is one
    range: tuple[str, str] | None = None
    asof: str | None = None


@dataclass
class Item:
    """A fact, dimension or metric; entity is None for derived metrics."""

    name: str
    entity: str | None
    expr: str
    using: list[str] = field(default_factory=list)
    non_additive: list[tuple[str, str]] = field(default_factory=list)  # (dimension, ASC or DESC)
    extras: Extras = field(default_factory=Extras)

    @property
    def label(self) -> str:
        return f"{self.entity}.{self.name}" if self.entity else self.name


@dataclass
class Variable:
    name: str
    type: str
    default: str | None = None


@dataclass
class SemanticView:
    name: str
    tables: list[Table]
    relationships: list[Relationship] = field(default_factory=list)
    facts: list[Item] = field(default_factory=list)
    dimensions: list[Item] = field(default_factory=list)
    metrics: list[Item] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    extras: Extras = field(default_factory=Extras)
    verified_queries: list[dict] = field(default_factory=list)
    instructions: dict[str, str] = field(default_factory=dict)
    max_staleness: int | None = None
    strict: bool = False

    def table(self, alias: str) -> Table:
        for t in self.tables:
            if t.alias.lower() == alias.lower():
                return t
        raise DeployError(f"unknown table '{alias}'")

    def has_table(self, alias: str) -> bool:
        return any(t.alias.lower() == alias.lower() for t in self.tables)

    @staticmethod
    def _find(items: list[Item], ref: str) -> list[Item]:
        parts = ref.lower().split(".")
        return [i for i in items if i.name.lower() == parts[-1] and (len(parts) == 1 or (i.entity or "").lower() == parts[-2])]

    def find(self, kind: str, ref: str) -> list[Item]:
        return self._find({"fact": self.facts, "dimension": self.dimensions, "metric": self.metrics}[kind], ref)

    def validate(self) -> None:
        """Everything that can be refused before a query is asked."""
        seen: set[tuple] = set()
        if len({t.alias.lower() for t in self.tables}) < len(self.tables):
            raise DeployError("invalid identifier: a table alias is used twice")
        for t in self.tables:
            if not t.alias:
                raise DeployError("a subquery table needs an alias")
        for i in [*self.dimensions, *self.metrics]:
            key = (None if self.strict else (i.entity or "").lower(), i.name.lower())
            if key in seen:
                raise DeployError(f"invalid identifier '{i.name}'")
            seen.add(key)
        for v in self.variables:
            for t in self.tables:
                if re.search(rf"\b{re.escape(v.name)}\b", t.source, re.I) and t.is_query:
                    raise DeployError(f"variable '{v.name}' cannot be used in TABLES")
            if any(v.name.lower() in [k.lower() for k in r.left_keys + r.right_keys] for r in self.relationships):
                raise DeployError(f"variable '{v.name}' cannot be used in RELATIONSHIPS")
        for i in [*self.facts, *self.dimensions, *self.metrics]:
            if i.entity and not self.has_table(i.entity):
                raise DeployError(f"unknown table '{i.entity}' of '{i.name}'")
        for r in self.relationships:
            self._check_relationship(r)
        for m in self.metrics:
            self._check_metric(m)

    def _check_relationship(self, r: Relationship) -> None:
        right, left = self.table(r.right), self.table(r.left)
        want = {k.lower() for k in r.right_keys}
        if r.range:
            ends = {x.lower() for x in r.range}
            ok = any(want | ends == {k.lower() for k in key} for key in right.keys()) or (right.distinct_range and ends == {x.lower() for x in right.distinct_range})
        elif r.asof:
            ok = any(want | {r.asof.lower()} == {k.lower() for k in key} or want <= {k.lower() for k in key} for key in right.keys())
        else:
            ok = any(want == {k.lower() for k in key} for key in right.keys())
        if not ok:
            raise DeployError(f"The referenced key in the relationship '{r.name}' must be the primary or unique key of the referenced entity '{r.right}'")
        for k in r.left_keys:
            for f in self.find("fact", f"{left.alias}.{k}"):
                if has_aggregate(f.expr):
                    raise DeployError(f"fact '{f.label}' aggregates and cannot be the key of relationship '{r.name}'")

    def _check_metric(self, m: Item) -> None:
        names = {x.name.lower() for x in self.metrics}
        tokens = lex(m.expr)
        if m.entity is None and has_aggregate(m.expr) and not is_window(m.expr):
            raise DeployError(f"derived metric '{m.name}' may only combine metrics")
        for u in m.using:
            if not any(r.name.lower() == u.lower() for r in self.relationships):
                raise DeployError(f"unknown relationship '{u}' in USING of '{m.label}'")
        if m.entity and not is_window(m.expr) and not has_aggregate(m.expr):
            if self.strict:
                raise DeployError(f"derived metric '{m.label}' must not have an entity prefix")
            warnings.warn(f"metric '{m.label}' aggregates nothing and is taken as derived", stacklevel=3)
        if is_window(m.expr):
            at = next(k for k, t in enumerate(tokens) if t.is_word("OVER"))
            inside = [t.text.upper() for t in tokens[at:]]
            if "PARTITION" not in inside:
                raise DeployError(f"window metric '{m.label}' needs PARTITION BY beside ORDER BY")
            if self.strict and "EXCLUDING" in inside and any(f.name.lower() in [t.text.lower().split(".")[-1] for t in tokens] for f in self.facts):
                raise DeployError(f"window metric '{m.label}' with EXCLUDING cannot rest on a fact")
        elif m.entity and has_aggregate(m.expr):
            own = {f.name.lower() for f in self.facts if (f.entity or "").lower() == m.entity.lower()}
            for t in tokens:
                n = t.text.lower().split(".")[-1]
                other = [x for x in self.metrics if x.name.lower() == n and x is not m]
                if t.kind == "name" and n in names and other and n not in own and t.text.lower() != m.name.lower() and not self._physical_hint(m.entity, n):
                    raise DeployError(f"nested metric reference '{t.text}' in '{m.label}' is not supported")

    def _physical_hint(self, entity: str, name: str) -> bool:
        """Columns known from the catalog count before metrics (filled in when a model is deployed)."""
        return name in getattr(self, "columns", {}).get(entity.lower(), set())
