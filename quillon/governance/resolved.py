"""What a statement reads, from Spark's own parser and analyzer rather than from its words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

from quillon.errors import AccessError
from quillon.functions.tokens import PATTERN, unquote

SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"
COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
SETS = ("Union", "Intersect", "Except")


def seq(s: JavaObject) -> list[JavaObject]:
    return [s.apply(k) for k in range(s.size())]


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _option(o: JavaObject) -> JavaObject | None:
    return o.get() if o.isDefined() else None


def inner_plans(spark: SparkSession, expression: JavaObject) -> Iterator[JavaObject]:
    """Plans of the subqueries in an expression."""
    if is_instance_of(spark.sparkContext._gateway, expression, SUBQUERY):
        yield expression.plan()
    for e in seq(expression.children()):
        yield from inner_plans(spark, e)


def parsed(spark: SparkSession, sql: str) -> JavaObject:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def analyzed(spark: SparkSession, sql: str) -> JavaObject:
    return spark.sql(sql)._jdf.queryExecution().analyzed()


@dataclass
class Reference:
    """A table's name in a statement: where it stands, and whether an alias follows, whether it is all of a TABLE statement (then start is TABLE's)."""

    parts: list[str]
    start: int
    end: int
    aliased: bool
    statement: bool

    @property
    def name(self) -> str:
        return ".".join(f"`{p}`" for p in self.parts)


def references(spark: SparkSession, sql: str) -> list[Reference]:
    """Every name of a table or view that a query reads, in order; names that its own WITH makes are none."""
    root, found = parsed(spark, sql), []
    if is_instance_of(spark.sparkContext._gateway, root, COMMAND):
        raise AccessError("only queries are held to policies")

    def walk(node: JavaObject, made: frozenset[str], aliased: bool) -> None:
        name = kind(node)
        if name == "UnresolvedRelation":
            parts = seq(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in made:
                found.append(_place(sql, parts, node.origin(), aliased))
            return
        if name == "UnresolvedWith":
            for pair in seq(node.cteRelations()):
                own = pair._1().lower()
                walk(pair._2(), made | {own} if node.allowRecursion() else made, False)
                made = made | {own}
        for e in seq(node.expressions()):
            for plan in inner_plans(spark, e):
                walk(plan, made, False)
        for child in seq(node.children()):
            walk(child, made, name == "SubqueryAlias")

    walk(root, frozenset(), False)
    return sorted({r.start: r for r in found}.values(), key=lambda r: r.start)


def _place(sql: str, parts: list[str], origin: JavaObject, aliased: bool) -> Reference:
    at = _option(origin.startIndex())
    m = PATTERN.match(sql, at) if at is not None else None
    if not m or unquote(m.group()).lower() != ".".join(parts).lower():
        raise AccessError(f"cannot tell where '{'.'.join(parts)}' stands; write its name in one piece")
    before = re.search(r"\bTABLE\s+$", sql[:at], re.I)
    return Reference(parts, before.start() if before else at, m.end(), aliased, before is not None)


@dataclass(frozen=True)
class Relation:
    """A view or catalog table of an analyzed plan; text is a view's own."""

    table: str
    database: str | None
    text: str | None = None


def relation(node: JavaObject) -> Relation | None:
    name = kind(node)
    if name == "View":
        of, text = node.desc().identifier(), _option(node.desc().viewText())
    elif name == "LogicalRelation" and (table := _option(node.catalogTable())) is not None:
        of, text = table.identifier(), None
    elif name == "HiveTableRelation":
        of, text = node.tableMeta().identifier(), None
    elif name == "DataSourceV2Relation" and (at := _option(node.identifier())) is not None:
        space = list(at.namespace())
        return Relation(at.name().lower(), space[-1].lower() if space else None)
    else:
        return None
    database = _option(of.database())
    return Relation(of.table().lower(), database.lower() if database else None, text)


def roots(node: JavaObject) -> list[str]:
    """The folders of a leaf that reads files."""
    if kind(node) != "LogicalRelation" or kind(node.relation()) != "HadoopFsRelation":
        return []
    return [p.toString().rstrip("/") for p in seq(node.relation().location().rootPaths())]


def nodes(spark: SparkSession, plan: JavaObject, above: tuple[JavaObject, ...] = ()) -> Iterator[tuple[JavaObject, tuple[JavaObject, ...]]]:
    """Every node of a plan and of the subqueries in it, with the nodes above it."""
    yield plan, above
    above = (*above, plan)
    for e in seq(plan.expressions()):
        for inner in inner_plans(spark, e):
            yield from nodes(spark, inner, above)
    for child in seq(plan.children()):
        yield from nodes(spark, child, above)


def relations(spark: SparkSession, source: str) -> list[Relation]:
    """Every table and view that a source reads, at any depth."""
    return [r for n, _ in nodes(spark, analyzed(spark, f"SELECT * FROM {source}")) if (r := relation(n))]


def derived(spark: SparkSession, plan: JavaObject, closed: Callable[[Relation, str], bool]) -> set[str]:
    """Output columns of a plan that come from closed columns: through expressions, set operations, WITH and subqueries."""
    ids: set[int] = set()
    made: dict[int, list[bool]] = {}
    taken = lambda attributes: [a.exprId().id() in ids for a in seq(attributes)]

    def comes(e: JavaObject) -> bool:
        return any(taken(e.references().toSeq())) or any(any(taken(p.output())) for p in inner_plans(spark, e))

    def walk(node: JavaObject) -> None:
        children, expressions, name = seq(node.children()), seq(node.expressions()), kind(node)
        for child in children:
            walk(child)
        for e in expressions:
            for inner in inner_plans(spark, e):
                walk(inner)
        output, own = seq(node.output()), relation(node)
        if own:
            ids.update(a.exprId().id() for a in output if closed(own, a.name().lower()))
        if name == "CTERelationDef":
            made[node.id()] = taken(output and node.output())
        elif name == "CTERelationRef":
            ids.update(a.exprId().id() for a, x in zip(output, made.get(node.cteId(), [])) if x)
        elif name in SETS:
            sides = [taken(c.output()) for c in children]
            ids.update(a.exprId().id() for a, *xs in zip(output, *sides) if any(xs))
        else:
            named = {e.exprId().id(): comes(e) for e in expressions if kind(e) == "Alias"}
            ids.update(k for k, x in named.items() if x)
            below = {a.exprId().id() for c in children for a in seq(c.output())}
            new = [a.exprId().id() for a in output if a.exprId().id() not in below and a.exprId().id() not in named]
            if new and children and any(map(comes, expressions)):
                ids.update(new)

    walk(plan)
    return {a.name().lower() for a, x in zip(seq(plan.output()), taken(plan.output())) if x}
