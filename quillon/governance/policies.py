"""Row, mask, projection and aggregation policies, folded into scans before anything is joined.

Policies belong to base tables. Wherever a statement, a filter, a logical
table's subquery or a catalog view reads a governed table, that read becomes a
secured subquery; a view whose text cannot be had is refused. What Spark then
makes of the statement is checked once more on its analyzed plan: a governed
table outside a secured subquery ends in an error, however it was named.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from quillon.errors import AccessError, QueryError
from quillon.functions.dialect import to_spark
from quillon.functions.tokens import PATTERN, Token, close_of, lex, text_of, unquote
from quillon.governance.resolved import Relation, analyzed, derived, kind, nodes, references, relation, relations, roots
from quillon.model.schema import SemanticView


@dataclass(frozen=True)
class SecurityContext:
    """Who asks: the primary role, roles active in the session, and all roles granted."""

    user: str = "USER"
    primary: str = "PUBLIC"
    active: frozenset[str] = frozenset()
    granted: frozenset[str] = frozenset()

    def roles(self) -> set[str]:
        return {r.upper() for r in self.active | {self.primary}}


def fold_roles(sql: str, context: SecurityContext) -> str:
    """Session functions as literals, so that Catalyst folds the policy to what the caller may see."""
    tokens, out, at = lex(sql), [], 0
    quoted = lambda s: Token("string", "'" + s.replace("'", "''") + "'")
    while at < len(tokens):
        t = tokens[at]
        name = t.text.upper() if t.kind == "name" else ""
        if name in ("CURRENT_ROLE", "CURRENT_USER", "IS_ROLE_IN_SESSION", "IS_DATABASE_ROLE_IN_SESSION", "CURRENT_AVAILABLE_ROLES") and at + 1 < len(tokens) and tokens[at + 1].text == "(":
            end = close_of(tokens, at + 1)
            arg = tokens[at + 2 : end]
            if name == "CURRENT_ROLE":
                out.append(quoted(context.primary))
            elif name == "CURRENT_USER":
                out.append(quoted(context.user))
            elif name == "CURRENT_AVAILABLE_ROLES":
                held = sorted(r.upper() for r in context.granted | {context.primary})
                out += lex(f"array({', '.join(quoted(r).text for r in held)})")
            elif len(arg) == 1 and arg[0].kind == "string":
                out.append(Token("name", "TRUE" if arg[0].text[1:-1].upper() in context.roles() else "FALSE"))
            else:  # a column of role names
                out += lex(f"(upper({text_of(arg)}) IN ({', '.join(quoted(r).text for r in sorted(context.roles()))}))")
            at = end + 1
        else:
            out.append(t)
            at += 1
    return to_spark(text_of(out))


@dataclass
class Policies:
    """Policies by physical table. Nobody without a context is held to them: queries without one run as the owner."""

    row: dict[str, str] = field(default_factory=dict)
    mask: dict[tuple[str, str], str] = field(default_factory=dict)  # (table, column) -> expression over the table's columns
    projection: dict[tuple[str, str], frozenset[str]] = field(default_factory=dict)  # roles that may select the column
    aggregation: dict[str, tuple[int, frozenset[str]]] = field(default_factory=dict)  # (least rows in a group, free roles)
    grants: dict[str, frozenset[str]] = field(default_factory=dict)  # object -> roles that may read it
    owner_rights: bool = False

    def _tables(self) -> set[str]:
        """Tables with a policy of any kind."""
        return {t.lower() for t in [*self.row, *(t for t, _ in self.mask), *(t for t, _ in self.projection), *self.aggregation]}

    @staticmethod
    def _is(table: str, of: Relation, database: str) -> bool:
        """A policy's table is this relation: a plain name is a temporary view or a table of the current database."""
        parts = table.lower().split(".")
        return parts[-1] == of.table and (of.database == parts[-2] if len(parts) > 1 else of.database in (None, database))

    def _free(self, roles, context: SecurityContext) -> bool:
        return bool({r.upper() for r in roles} & context.roles())

    def _closed(self, spark: SparkSession, context: SecurityContext | None):
        """Whether a column of a relation may not be projected by the caller; None where all may."""
        held = [(t, c.lower()) for (t, c), roles in self.projection.items() if context is not None and not self._free(roles, context)]
        database = spark.catalog.currentDatabase().lower() if held else ""
        return (lambda of, column: any(c == column and self._is(t, of, database) for t, c in held)) if held else None

    def _least_of(self, spark: SparkSession, of: list[Relation], context: SecurityContext | None) -> int:
        """The least group size that aggregation policies on these relations ask of the caller; 0: none."""
        held = {t: k for t, (k, free) in self.aggregation.items() if context is not None and not self._free(free, context)}
        database = spark.catalog.currentDatabase().lower() if held else ""
        return max([k for t, k in held.items() if any(self._is(t, r, database) for r in of)], default=0)

    def covers(self, spark: SparkSession, view: SemanticView) -> bool:
        """A policy on any base table: rollups hold what only the owner may see."""
        if not self._tables():
            return False
        database = spark.catalog.currentDatabase().lower()
        return any(self._is(g, r, database) for t in view.tables for r in relations(spark, t.source) for g in self._tables())

    def secure(self, engine, sql: str, context: SecurityContext | None, mark: str, source: bool = False) -> str:
        """A query whose reads of governed tables are filtered and masked for the caller, each under the alias ``mark``.

        source: it is a logical table's, whose group sizes the compiler sees to.
        Names are those that Spark's parser finds; names of WITH shadow tables
        only where Spark says so. ``verify`` refuses what gets past this.
        """
        if context is None or not self._tables():
            return sql
        spark, groups = engine.spark, []
        for r in reversed(references(spark, sql)):
            if r.parts[0].startswith("__view_"):
                continue
            inner = self._secured(engine, r.name, context, mark, source)
            if inner is not None:
                sql = sql[: r.start] + ("SELECT * FROM " if r.statement else "") + f"(SELECT * FROM ({inner}) AS {mark})" + ("" if r.aliased else f" AS `{r.parts[-1]}`") + sql[r.end :]
            elif not source and (k := self._least_of(spark, relations(spark, r.name), context)):
                groups.append((r.start, k))
        for at, k in groups:
            sql = _with_least(sql, at, k, mark)
        return sql

    def secure_filter(self, engine, condition: str, context: SecurityContext | None, mark: str) -> str:
        """A condition whose subqueries are held to the policies; tables that may only be counted or filtered are refused."""
        if context is None or not (self._tables() or self.grants):
            return condition
        head = "SELECT 1 FROM __view_ WHERE "
        sql = head + to_spark(condition)
        read = [r for r in references(engine.spark, sql) if r.parts[0] != "__view_"]
        if not read:
            return condition
        self._granted([".".join(r.parts) for r in read], context)
        for r in read:
            of = relations(engine.spark, r.name)
            closed = self._closed(engine.spark, context)
            if self._least_of(engine.spark, of, context) or (closed and any(closed(x, c.lower()) for x in of for c in engine.spark.table(r.name).columns)):
                raise AccessError(f"a filter may not read '{'.'.join(r.parts)}'")
        return self.secure(engine, sql, context, mark)[len(head) :]

    def _secured(self, engine, name: str, context: SecurityContext, mark: str, source: bool) -> str | None:
        """A governed relation as a query for the caller; None where it holds nothing to filter or mask."""
        spark = engine.spark
        database = spark.catalog.currentDatabase().lower()
        of = relations(spark, name)
        tables = {t for t in [*self.row, *(t for t, _ in self.mask)] if any(self._is(t, r, database) for r in of)}
        if not tables:
            return f"SELECT * FROM {name}" if source and self._least_of(spark, of, context) else None
        top, columns = of[0], spark.table(name).columns
        below = {t for t in tables if any(self._is(t, r, database) for r in of[1:])}
        base = name
        if below:  # a view over governed tables: its own text is secured
            if not top.text:
                raise AccessError(f"view {name} reads a governed table and has no text to secure")
            base = f"({self.secure(engine, top.text, context, mark, source)}) AS __own({', '.join(f'`{c}`' for c in columns)})"
        rows = [fold_roles(p, context) for t, p in self.row.items() if self._is(t, top, database)]
        masks = {c.lower(): fold_roles(e, context) for (t, c), e in self.mask.items() if self._is(t, top, database)}
        made = [f"{masks.get(c.lower(), f'`{c}`')} AS `{c}`" for c in columns]
        # "WHERE (false)" alone would be an alias and its column.
        return f"SELECT {', '.join(made)} FROM {base}" + "".join(f"{' AND' if k else ' WHERE 1 = 1 AND'} ({r})" for k, r in enumerate(rows))

    def verify(self, engine, sql: str, context: SecurityContext | None, mark: str) -> str:
        """The statement, if its analyzed plan reads nothing past the policies; else an error.

        A governed relation must stand under ``mark``, files of one must not be
        read by path, groups must be large enough, and no output column may
        come from one that the caller may not project.
        """
        if context is None or not self._tables():
            return sql
        spark = engine.spark
        database = spark.catalog.currentDatabase().lower()
        try:
            plan = analyzed(spark, sql)
        except AnalysisException as error:
            if f"'{mark}' = '{mark}'" in sql:  # groups of a SELECT that has none
                raise QueryError("an aggregation policy allows aggregates only") from error
            raise
        filtered = {t.lower() for t in [*self.row, *(t for t, _ in self.mask)]}
        for node, above in nodes(spark, plan):
            if any(kind(x) == "SubqueryAlias" and x.alias() == mark for x in above):
                continue
            own = relation(node)
            if own and any(self._is(t, own, database) for t in filtered):
                raise AccessError(f"'{own.table}' is governed and cannot be read in this way")
            if own and self._least_of(spark, [own], context):
                self._check_groups(own, above, mark)
            if not own and not any(relation(x) for x in above) and (read := roots(node)) and any(_within(a, b) for a in read for b in self._folders(spark)):
                raise AccessError("files of a governed table cannot be read by path")
        closed = self._closed(spark, context)
        if closed and (shown := derived(spark, plan, closed)):
            raise AccessError(f"role {context.primary} may not project {', '.join(sorted(shown))}")
        return sql

    def _check_groups(self, own: Relation, above: tuple, mark: str) -> None:
        """The relation goes into an aggregate alone, whose small groups are left out."""
        names = [kind(x) for x in above]
        at = max((k for k, n in enumerate(names) if n == "Aggregate"), default=None)
        plain = at is not None and set(names[at + 1 :]) <= {"Project", "Filter", "SubqueryAlias", "View"}
        if not plain or not any(kind(x) == "Filter" and mark in x.condition().toString() for x in above[max(0, at - 2) : at]):
            raise QueryError(f"an aggregation policy allows aggregates of '{own.table}' only")

    def _folders(self, spark: SparkSession) -> set[str]:
        """Folders of the governed tables that are files themselves."""
        out = set()
        for t in self._tables():
            try:
                plan = spark.table(t)._jdf.queryExecution().analyzed()
            except AnalysisException:  # no such table now
                continue
            while kind(plan) in ("SubqueryAlias", "View"):
                plan = plan.child()
            out.update(roots(plan))
        return out

    def hidden(self, engine, source: str, context: SecurityContext | None) -> set[str]:
        """Columns of a source that come from columns the caller may not project."""
        closed = self._closed(engine.spark, context)
        return derived(engine.spark, analyzed(engine.spark, f"SELECT * FROM {source}"), closed) if closed else set()

    def _granted(self, names: list[str], context: SecurityContext) -> None:
        key = lambda x: unquote(x).lower().split(".")[-1]
        for name in names if self.grants else ():
            if not self._free({r for k, v in self.grants.items() if key(k) == key(name) for r in v}, context):
                raise AccessError(f"role {context.primary} may not read '{name}'")

    def check_access(self, spark: SparkSession, view: SemanticView, context: SecurityContext | None) -> None:
        """Caller rights: the view and every table that it names, in subqueries too; owner rights: the view."""
        if context is None or not self.grants:
            return
        needed = [view.name]
        if not self.owner_rights:
            needed += [".".join(r.parts) for t in view.tables for r in references(spark, f"SELECT * FROM {t.source}")]
        self._granted(needed, context)

    def check_statement(self, spark: SparkSession, sql: str, context: SecurityContext | None) -> None:
        """Plain SQL: every table and view that it names must be granted."""
        if context is not None and self.grants:
            self._granted([".".join(r.parts) for r in references(spark, sql) if not r.parts[0].startswith("__view_")], context)

    def least(self, spark: SparkSession, view: SemanticView, context: SecurityContext | None) -> dict[str, int]:
        """The least group size by alias, for tables over an aggregation policy that holds for the caller."""
        if not self.aggregation or context is None:
            return {}
        sizes = {t.alias.lower(): self._least_of(spark, relations(spark, t.source), context) for t in view.tables}
        return {alias: k for alias, k in sizes.items() if k}

    def check_aggregation(self, spark: SparkSession, view: SemanticView, query, context: SecurityContext | None) -> None:
        if not query.metrics and self.least(spark, view, context):
            raise QueryError("an aggregation policy allows metrics only")


def new_mark() -> str:
    """A name for one statement's secured parts, which no caller knows beforehand."""
    return f"__own_{secrets.token_hex(16)}"


def _within(a: str, b: str) -> bool:
    return a == b or a.startswith(b + "/") or b.startswith(a + "/")


def _with_least(sql: str, at: int, k: int, mark: str) -> str:
    """The SELECT that the place stands in, with a condition on its groups' sizes; one without GROUP BY stays as it is if it aggregates nothing."""
    spans = [(m.start(), m.end(), m.lastgroup, m.group()) for m in PATTERN.finditer(sql)]
    tokens = [(a, b, Token(g, t)) for a, b, g, t in spans if g != "space"]
    here = next(n for n, (a, b, _) in enumerate(tokens) if a <= at < b)
    depth, end = 0, len(tokens)
    marks: dict[str, int] = {}
    for n in range(here, len(tokens)):
        t = tokens[n][2]
        depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "op" else 0
        if depth < 0 or depth == 0 and t.is_word("ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "SORT", "CLUSTER", "DISTRIBUTE", "OFFSET"):
            end = n
            break
        if depth == 0 and t.is_word("HAVING"):
            marks["having"] = n
    put = tokens[end][0] if end < len(tokens) else len(sql)
    test = f"(COUNT(*) >= {k} AND '{mark}' = '{mark}')"
    if "having" in marks:
        start = tokens[marks["having"]][1]
        return f"{sql[:start]} ({sql[start:put]}) AND {test} {sql[put:]}"
    return f"{sql[:put]} HAVING {test} {sql[put:]}"


# Masks of the usual kinds, as expressions for Policies.mask.


def mask_unless(column: str, roles: list[str], otherwise: str) -> str:
    """The column for these roles, else another expression."""
    test = " OR ".join(f"IS_ROLE_IN_SESSION('{r}')" for r in roles)
    return f"CASE WHEN {test} THEN {column} ELSE {otherwise} END"


def mask_email(column: str) -> str:
    return rf"REGEXP_REPLACE({column}, '^.*@', '*****@')"


def mask_ssn(column: str) -> str:
    return f"CONCAT('***-**-', RIGHT({column}, 4))"


def mask_last4(column: str) -> str:
    return f"CONCAT(REPEAT('*', GREATEST(LENGTH({column}) - 4, 0)), RIGHT({column}, 4))"
