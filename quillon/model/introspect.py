"""SHOW, DESCRIBE, lineage, tags, synonyms and verified queries of deployed views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quillon.engine import Engine
from quillon.errors import QueryError
from quillon.functions.tokens import lex, unquote
from quillon.model.schema import SemanticView
from quillon.plans.paths import JoinGraph


def _kinds(v: SemanticView):
    return (("FACT", v.facts), ("DIMENSION", v.dimensions), ("METRIC", v.metrics))


def show_views(e: Engine, like: str | None = None) -> DataFrame:
    rx = re.compile(re.escape(like or "%").replace("%", ".*").replace("_", "."), re.I)
    rows = [(v.name, v.extras.comment) for v in e.views.values() if rx.fullmatch(v.name)]
    return e.spark.createDataFrame(rows, "name string, comment string")


def describe(e: Engine, view: str) -> DataFrame:
    """object_kind, object_name, parent, property, property_value."""
    v, rows = e.view(view), []
    for t in v.tables:
        rows.append(("TABLE", t.alias, None, "DEFINITION" if t.is_query else "BASE_TABLE", t.source))
        rows += [("TABLE", t.alias, None, "PRIMARY_KEY", ",".join(t.primary_key))] * bool(t.primary_key)
    rows += [("RELATIONSHIP", r.name, r.left, "REFERENCES", r.right) for r in v.relationships]
    for kind, items in _kinds(v):
        for i in items:
            rows.append((kind, i.name, i.entity, "EXPRESSION", i.expr))
            rows += [(kind, i.name, i.entity, "SYNONYMS", ",".join(i.extras.synonyms))] * bool(i.extras.synonyms)
            rows += [(kind, i.name, i.entity, "ACCESS", "PRIVATE")] * i.extras.private
    return e.spark.createDataFrame(rows, "object_kind string, object_name string, parent string, property string, property_value string")


def show_metrics(e: Engine, view: str) -> DataFrame:
    return e.spark.createDataFrame([(m.entity, m.name) for m in e.view(view).metrics if not m.extras.private], "table_name string, name string")


def dimensions_for_metric(e: Engine, view: str, metric: str) -> DataFrame:
    """Dimensions that a metric can be asked by: one path leads there."""
    v = e.view(view)
    compiler = e.compiler(v, None)
    leaves: dict = {}
    compiler._leaves(compiler.one("metric", metric), leaves, frozenset())
    rows = []
    for d in v.dimensions:
        try:
            for m in leaves.values():
                compiler._paths(m.entity.lower(), [d], m)
            rows.append((d.entity, d.name))
        except QueryError:
            continue
    return e.spark.createDataFrame(rows, "table_name string, name string")


def lineage(e: Engine, view: str, name: str, up: bool = True, depth: int = 5) -> DataFrame:
    """source, target, distance along what expressions name, up to base tables or down to what depends on it."""
    v, edges = e.view(view), set()
    for _, items in _kinds(v):
        for i in items:
            for t in lex(i.expr):
                ref = unquote(t.text) if t.kind == "name" else ""
                for _, others in _kinds(v):
                    edges |= {(o.label, i.label) for o in SemanticView._find(others, ref) if o is not i} if ref else set()
            if i.entity:
                edges.add((v.table(i.entity).source, i.label))
    start = next((i.label for _, items in _kinds(v) for i in SemanticView._find(items, name)), name)
    seen, front, rows = {start}, {start}, []
    for distance in range(1, depth + 1):
        new = {(a, b) for a, b in edges if (b if up else a) in front}
        rows += [(a, b, distance) for a, b in sorted(new)]
        front = {a if up else b for a, b in new} - seen
        seen |= front
    return e.spark.createDataFrame(rows, "source string, target string, distance int")


def tag_references(e: Engine, view: str, name: str | None = None) -> DataFrame:
    v = e.view(view)
    rows = [("VIEW", v.name, k, x) for k, x in v.extras.tags.items()] + [("TABLE", t.alias, k, x) for t in v.tables for k, x in t.extras.tags.items()]
    rows += [(kind, i.label, k, x) for kind, items in _kinds(v) for i in items for k, x in i.extras.tags.items()]
    return e.spark.createDataFrame([r for r in rows if name is None or r[1].lower() == name.lower()], "object_kind string, object_name string, tag string, value string")


def by_synonym(e: Engine, view: str, word: str) -> str:
    """The object that a name or synonym means; refused where several claim it."""
    v = e.view(view)
    found = {i.label for _, items in _kinds(v) for i in items if not i.extras.private and word.lower() in [i.name.lower(), *[s.lower() for s in i.extras.synonyms]]}
    if len(found) != 1:
        raise QueryError(f"'{word}' is ambiguous: {', '.join(sorted(found))}" if found else f"nothing is called '{word}'")
    return found.pop()


def verified_answer(e: Engine, view: str, question: str) -> DataFrame:
    """The stored query of a question asked in the same words."""
    norm = lambda s: re.sub(r"\W+", " ", s.lower()).strip()
    for q in e.view(view).verified_queries:
        if norm(q.get("question", "")) == norm(question):
            return e.sql(q["sql"])
    raise QueryError("no verified query for this question")


__all__ = ["JoinGraph", "by_synonym", "describe", "dimensions_for_metric", "lineage", "show_metrics", "show_views", "tag_references", "verified_answer"]
