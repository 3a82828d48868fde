"""The engine: registers semantic views and answers queries on them with Spark DataFrames."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import AccessError, DeployError, QueryError, SemanticError
from quillon.functions.dialect import to_spark
from quillon.functions.outer import order_nulls, qualify, segments, top
from quillon.functions.tokens import Token, close_of, lex, own_names, split_top, text_of, unquote
from quillon.governance.policies import Policies, SecurityContext, new_mark
from quillon.model import ddl, yaml_io
from quillon.model.schema import Item, SemanticView, is_window
from quillon.operators.lineage import cut
from quillon.plans.compiler import Compiler, Query

#: Aggregates whose stored values can be aggregated again, and by what.
FOLDS = {"SUM": "SUM", "COUNT": "SUM", "COUNT_IF": "SUM", "MIN": "MIN", "MAX": "MAX"}
LEAST_STALENESS = 120
CLAUSES = ("DIMENSIONS", "METRICS", "FACTS", "WHERE", "VARIABLES")


@dataclass
class Materialization:
    name: str
    dimensions: list[str]
    metrics: list[str]
    path: str
    refreshed: float
    immutable_where: str | None = None
    history: list[tuple[float, str]] = field(default_factory=list)
    frozen: list[str] = field(default_factory=list)  # folders of what the immutable predicate covers; their files stay
    live: str = ""

    def folders(self) -> str:
        """The folders to read, as one path."""
        parts = [*self.frozen, self.live]
        return f"{self.path}/{parts[0]}" if len(parts) == 1 else f"{self.path}/{{{','.join(parts)}}}"


class Engine:
    """Semantic views over a Spark session. ``clock`` gives the time in seconds, for staleness."""

    def __init__(self, spark: SparkSession, policies: Policies | None = None, store: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.policies, self.clock = spark, policies or Policies(), clock
        self.store = store
        self.views: dict[str, SemanticView] = {}
        self.materializations: dict[str, dict[str, Materialization]] = {}

    # deployment ------------------------------------------------------------------

    def _columns(self, view: SemanticView) -> dict[str, list[str]]:
        """Physical columns by alias: each source is analyzed once for a deployed view."""
        held = view.__dict__.setdefault("physical", {})
        for t in view.tables:
            if t.source not in held:
                held[t.source] = self.spark.sql(f"SELECT * FROM {t.source} LIMIT 0").columns
        return {t.alias: held[t.source] for t in view.tables}

    def prepare(self, view: SemanticView | str) -> SemanticView:
        """Parse if need be, fill in implied keys and validate."""
        view = ddl.parse(view) if isinstance(view, str) else view
        view.__dict__.pop("physical", None)
        for r in view.relationships:
            if not r.right_keys and not r.range and not r.asof:
                t = view.table(r.right)
                r.right_keys = list(t.primary_key or next(iter(t.keys()), ()))
        view.columns = {k: {c.lower() for c in v} for k, v in self._columns(view).items()}
        view.validate()
        return view

    def deploy(self, view: SemanticView | str, dry_run: bool = False) -> SemanticView:
        """Register a view (DDL text or object); with dry_run only check it."""
        view = self.prepare(view)
        if not dry_run:
            self.views[view.name.lower()] = view
        return view

    def deploy_yaml(self, text: str, place: Callable[[str], str] = lambda name: name, dry_run: bool = False) -> SemanticView:
        """Register a view from YAML; ``place`` says where its base tables are."""
        return self.deploy(yaml_io.from_yaml(text, place), dry_run)

    def yaml(self, name: str) -> str:
        """A deployed view as YAML text."""
        return yaml_io.to_yaml(self.view(name))

    def drop(self, name: str) -> None:
        self.views.pop(name.lower(), None)
        self.materializations.pop(name.lower(), None)

    def view(self, name: str | SemanticView) -> SemanticView:
        if isinstance(name, SemanticView):
            return name if hasattr(name, "columns") else self.prepare(name)
        key = name.lower().split(".")[-1]
        if key not in self.views:
            raise QueryError(f"no semantic view named {name}")
        return self.views[key]

    # queries ----------------------------------------------------------------------

    def compiler(self, view: SemanticView, context: SecurityContext | None, mark: str = "") -> Compiler:
        sources, hidden, head = {}, {}, "SELECT * FROM "
        for t in view.tables:
            own = self.policies.secure(self, f"{head}{t.source}", context, mark, source=True)[len(head) :]
            sources[t.alias.lower()] = own
            if context is not None and (closed := self.policies.hidden(self, t.source, context)):
                hidden[t.alias.lower()] = closed
        return Compiler(view, self._columns(view), sources, hidden, self.policies.least(self.spark, view, context))

    def explain(self, view: str | SemanticView, dimensions: list[str] = (), metrics: list[str] = (), facts: list[str] = (), where: str | None = None, variables: dict | None = None, context: SecurityContext | None = None) -> str:
        """The Spark SQL of a query; nothing is scanned."""
        mark = new_mark()
        return self.policies.verify(self, self._compiled(view, Query(list(dimensions), list(metrics), list(facts), where, variables or {}), context, mark), context, mark)

    def _compiled(self, view: str | SemanticView, q: Query, context: SecurityContext | None, mark: str) -> str:
        v = self.view(view)
        self.policies.check_access(self.spark, v, context)
        self.policies.check_aggregation(self.spark, v, q, context)
        if q.where:
            q.where = self.policies.secure_filter(self, q.where, context, mark)
        return self._from_rollup(v, q) or self.compiler(v, context, mark).compile(q)

    def query(self, view: str | SemanticView, dimensions: list[str] = (), metrics: list[str] = (), facts: list[str] = (), where: str | None = None, variables: dict | None = None, context: SecurityContext | None = None) -> DataFrame:
        """Dimensions (in order), then metrics or facts, as a DataFrame."""
        return self.spark.sql(self.explain(view, dimensions, metrics, facts, where, variables, context))

    def sql(self, text: str, context: SecurityContext | None = None) -> DataFrame:
        """SQL with SEMANTIC_VIEW(...) calls, WITH name AS SEMANTIC VIEW definitions, or views in FROM and JOIN."""
        return self.spark.sql(self.translate(text, context))

    def run(self, script: str, context: SecurityContext | None = None) -> DataFrame | None:
        """Statements one after the other; the last one's result. TABLE(RESULT_SCAN(LAST_QUERY_ID(-n))) is the n-th last result so far, that of SHOW too."""
        from quillon.model.introspect import show_views

        held: list[str] = []
        out = None
        for tokens in split_top(lex(script), ";"):
            if tokens[0].is_word("SHOW") and len(tokens) > 2 and tokens[1].is_word("SEMANTIC") and tokens[2].is_word("VIEWS"):
                out = show_views(self, *([tokens[4].text[1:-1]] if len(tokens) > 4 and tokens[3].is_word("LIKE") else []))
            elif tokens[0].is_word("SHOW"):
                if context is not None and self.policies.grants:
                    raise AccessError("SHOW tells what is there, granted or not")
                out = self.spark.sql(text_of(tokens))
            else:
                out = self.sql(text_of(_results(tokens, held)), context)
            # A secured result is stored: its plan reads governed tables under a mark of its own.
            held.append(f"__result_{uuid.uuid4().hex}")
            (cut(out) if context is not None else out).createOrReplaceTempView(held[-1])
        return out

    def translate(self, text: str, context: SecurityContext | None = None) -> str:
        """Spark SQL for a statement: views become their queries, the statement around them loses its dialect."""
        tokens, mark = lex(text.rstrip().rstrip(";")), new_mark()
        local: dict[str, SemanticView] = {}
        if tokens[0].is_word("WITH") and any(a.is_word("AS") and b.is_word("SEMANTIC") for a, b in zip(tokens, tokens[1:])):
            tokens, local = self._ad_hoc(tokens)
        inner: dict[str, str] = {}  # queries of views are Spark SQL already: names stand for them until the end

        def held(sql: str) -> Token:
            inner[name := f"__view_{len(inner)}__"] = sql
            return Token("name", name)

        out, at = [], 0
        while at < len(tokens):
            if tokens[at].is_word("SEMANTIC_VIEW") and at + 1 < len(tokens) and tokens[at + 1].text == "(":
                end = close_of(tokens, at + 1)
                out.append(held(self._call(tokens[at + 2 : end], local, context, mark)))
                at = end + 1
            else:
                out.append(tokens[at])
                at += 1
        out = order_nulls(self._selects(out, {**self.views, **local}, held, context, mark))
        sql = to_spark(text_of(out))
        self.policies.check_statement(self.spark, sql, context)
        sql = self.policies.secure(self, sql, context, mark)
        sql = re.sub(r"__view_\d+__", lambda m: f"({inner[m[0]]})", sql)
        return self.policies.verify(self, sql, context, mark)

    def _selects(self, tokens: list[Token], named: dict[str, SemanticView], held: Callable[[str], Token], context: SecurityContext | None, mark: str) -> list[Token]:
        """Every SELECT of a statement, inner ones first, with views in FROM replaced and QUALIFY written out."""
        out, at = [], 0
        while at < len(tokens):
            if tokens[at].text == "(" and tokens[at].kind == "op":
                end = close_of(tokens, at)
                out += [tokens[at], *self._selects(tokens[at + 1 : end], named, held, context, mark), tokens[end]]
                at = end + 1
            else:
                out.append(tokens[at])
                at += 1
        if top(out, "SELECT") is None:
            return out
        start = top(out, "SELECT")
        parts = segments(out[start:])
        return out[:start] + [t for p in parts for t in (qualify(self._views_in(p, named, held, context, mark)) if p and p[0].is_word("SELECT") else p)]

    def _ad_hoc(self, tokens: list[Token]) -> tuple[list[Token], dict[str, SemanticView]]:
        local, at, kept = {}, 1, []
        while True:
            name, start = tokens[at].text, at + 2
            if tokens[start].is_word("SEMANTIC"):
                start += 2
                if tokens[start].text == "(":
                    end = close_of(tokens, start)
                    body = tokens[start + 1 : end]
                else:
                    end = start
                    while end < len(tokens) and not tokens[end].is_word("SELECT") and not (tokens[end].text == "," and end + 2 < len(tokens) and tokens[end + 2].is_word("AS")):
                        end = close_of(tokens, end) + 1 if tokens[end].text == "(" else end + 1
                    body, end = tokens[start:end], end - 1
                local[name.lower()] = self.prepare(f"CREATE SEMANTIC VIEW {name} {text_of(body)}")
            else:
                end = close_of(tokens, start)
                kept += [*tokens[at : end + 1], Token("op", ",")]
            at = end + 1
            if at < len(tokens) and tokens[at].text == ",":
                at += 1
                continue
            return ([Token("name", "WITH"), *kept[:-1]] if kept else []) + tokens[at:], local

    def _call(self, tokens: list[Token], local: dict[str, SemanticView], context: SecurityContext | None, mark: str) -> str:
        name = unquote(tokens[0].text).split(".")[-1].lower()
        q, depth = Query(), 0
        marks = []
        for k, t in enumerate(tokens[1:], 1):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and t.is_word(*CLAUSES):
                marks.append(k)
        for a, b in zip(marks, [*marks[1:], len(tokens)]):
            part = tokens[a + 1 : b]
            part = part[:-1] if part and part[-1].text == "," else part
            word = tokens[a].text.upper()
            if word == "WHERE":
                q.where = text_of(part)
            elif word == "VARIABLES":
                q.variables = {p[0].text: p[-1].text[1:-1].replace("''", "'") if p[-1].kind == "string" else (float if "." in p[-1].text else int)(text_of(p[2:]).replace(" ", "")) for p in split_top(part)}
            else:
                getattr(q, word.lower()).extend(unquote(p[0].text) for p in split_top(part))
        return self._compiled(local.get(name, name), q, context, mark)

    def _views_in(self, tokens: list[Token], named: dict[str, SemanticView], held: Callable[[str], Token], context: SecurityContext | None, mark: str) -> list[Token]:
        """A SELECT over views: each is one row for each combination of its dimensions that the SELECT names.

        Conditions of WHERE on one view alone filter inside it, so they may name
        dimensions and facts that are not selected.
        """
        low = lambda t: unquote(t.text).lower()
        start = top(tokens, "FROM")
        if start is None:
            return tokens
        where = top(tokens, "WHERE", start=start)
        stop = top(tokens, "WHERE", "GROUP", "ORDER", "HAVING", "QUALIFY", "LIMIT", start=start)
        stop = len(tokens) if stop is None else stop
        views: list[tuple[int, int, SemanticView, str | None]] = []  # place, end, view, alias
        for k in range(start + 1, stop):
            before = tokens[k - 1]
            if tokens[k].kind == "name" and (before.is_word("FROM", "JOIN") or before.text == ",") and (v := named.get(low(tokens[k]).split(".")[-1])):
                end, alias = k + 1, None
                if end < stop and tokens[end].is_word("AS"):
                    end += 1
                if end < stop and tokens[end].kind == "name" and not tokens[end].is_word("JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "ON", "USING"):
                    end, alias = end + 1, unquote(tokens[end].text)
                views.append((k, end, v, alias))
        if not views:
            return tokens
        names = [(alias or v.name).lower() for _, _, v, alias in views]

        def owner(t: Token) -> tuple[int, str, Item] | None:
            """(which view, its part of the reference, the item) of a name."""
            parts = low(t).split(".")
            for n, (_, _, v, _) in enumerate(views):
                ref = parts[1:] if len(parts) > 1 and parts[0] == names[n] else parts
                if len(parts) > 1 and parts[0] in names and parts[0] != names[n]:
                    continue
                for kind in ("dimension", "metric", "fact"):
                    found = [i for i in v.find(kind, ".".join(ref)) if not i.extras.private]
                    if found:
                        return n, kind, found[0]
            return None

        keep, inside = [], [[] for _ in views]
        if where is not None:
            end = top(tokens, "GROUP", "ORDER", "HAVING", "QUALIFY", "LIMIT", start=where)
            end = len(tokens) if end is None else end
            for part in self._conjuncts(tokens[where + 1 : end]):
                mine = {o[0] for t in part if t.kind == "name" and (o := owner(t))}
                n = 0 if len(views) == 1 and top(tokens, "JOIN", start=start) is None else next(iter(mine)) if len(mine) == 1 and all(owner(t) for t in part if "." in t.text and t.kind == "name") else None
                if n is None:
                    keep.append(part)
                else:
                    inside[n].append([t._replace(text=".".join(unquote(t.text).split(".")[1:])) if t.kind == "name" and low(t).startswith(names[n] + ".") else t for t in part])
            joined = [t for k, p in enumerate(keep) for t in ([Token("name", "AND")] if k else []) + p]
            tokens = [*tokens[:where], *([Token("name", "WHERE"), *joined] if joined else []), *tokens[end:]]
        asked = [([], []) for _ in views]
        places = {x for k, end, _, _ in views for x in range(k, end)}
        out: list[Token] = []
        for k, t in enumerate(tokens):
            if k in places:
                out.append(t)
                continue
            found = owner(t) if t.kind == "name" and not t.is_word("SELECT", "GROUP", "BY", "ALL", "ORDER") and not (k + 1 < len(tokens) and tokens[k + 1].text == "(") and not (k and tokens[k - 1].is_word("AS")) else None
            if found and found[1] != "fact":
                into = asked[found[0]][found[1] == "metric"]
                if found[2].label not in into:
                    into.append(found[2].label)
                said = low(t).split(".")
                out.append(Token("name", f"{names[found[0]]}.{said[-1]}" if said[0] in names and len(said) > 1 else said[-1]))
            else:
                out.append(t)
        for (k, end, v, alias), (dims, metrics), cond in reversed(list(zip(views, asked, inside))):
            condition = " AND ".join(f"({text_of(p)})" for p in cond) if len(cond) > 1 else text_of(cond[0]) if cond else None
            sql = self._compiled(v, Query(dims, metrics, where=condition), context, mark)
            out[k:end] = [held(sql), Token("name", alias or v.name)]
        return out

    @staticmethod
    def _conjuncts(tokens: list[Token]) -> list[list[Token]]:
        """Parts between ANDs outside parentheses, BETWEEN's own AND apart; one part where there is an OR."""
        if top(tokens, "OR") is not None:
            return [tokens]
        out, at, between = [[]], 0, False
        while at < len(tokens):
            t = tokens[at]
            if t.text == "(" and t.kind == "op":
                end = close_of(tokens, at)
                out[-1] += tokens[at : end + 1]
                at = end + 1
                continue
            if t.is_word("AND") and not between:
                out.append([])
            else:
                between = t.is_word("BETWEEN") or (between and not t.is_word("AND"))
                out[-1].append(t)
            at += 1
        return out

    # rollups ------------------------------------------------------------------------

    def _fold(self, m: Item) -> str | None:
        t = lex(m.expr)
        if len(t) > 2 and t[0].kind == "name" and t[1].text == "(" and close_of(t, 1) == len(t) - 1 and not t[2].is_word("DISTINCT"):
            return FOLDS.get(t[0].text.upper())
        return None

    @staticmethod
    def _counts(m: Item) -> bool:
        """Its value over no rows is 0."""
        return lex(m.expr)[0].is_word("COUNT", "COUNT_IF")

    def set_max_staleness(self, view: str, seconds: int) -> None:
        if seconds < LEAST_STALENESS:
            raise DeployError(f"MAX_STALENESS must be at least {LEAST_STALENESS} seconds")
        self.view(view).max_staleness = seconds

    def add_materialization(self, view: str, name: str, dimensions: list[str], metrics: list[str], immutable_where: str | None = None) -> Materialization:
        """Store a rollup; queries that it covers read it while it is fresh."""
        v = self.view(view)
        if v.max_staleness is None:
            raise DeployError("a materialization needs MAX_STALENESS")
        for ref in metrics:
            for m in v.find("metric", ref):
                if is_window(m.expr) or m.non_additive or m.using or not m.entity:
                    raise DeployError(f"metric '{m.label}' cannot be materialized")
        base = self.store or self.spark.conf.get("spark.sql.warehouse.dir")
        made = Materialization(name, [d.split(".")[-1].lower() for d in dimensions], [m.split(".")[-1].lower() for m in metrics], f"{base}/quillon_rollups/{v.name}_{name}_{uuid.uuid4().hex[:8]}", 0.0, immutable_where)
        self._write(v, made)
        self.materializations.setdefault(v.name.lower(), {})[name.lower()] = made
        return made

    def _write(self, v: SemanticView, m: Materialization) -> None:
        """Compute what is not immutable; of the last state only rows that became immutable since are kept, in a folder more."""
        n, fresh = len(m.history), self.compiler(v, None)
        made = lambda where: self.spark.sql(fresh.compile(Query(list(m.dimensions), list(m.metrics), where=where)))
        frozen, live = [], f"live-{n}"
        if m.immutable_where:
            kept = self.spark.read.parquet(f"{m.path}/{m.live}").where(m.immutable_where) if n else made(m.immutable_where)
            if not n or not kept.isEmpty():
                frozen = [f"frozen-{n}"]
                kept.write.parquet(f"{m.path}/{frozen[0]}")
        new = made(f"NOT coalesce(({m.immutable_where}), false)" if m.immutable_where else None)
        if m.frozen:  # files that stay keep their types
            new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.read.parquet(f"{m.path}/{m.frozen[0]}").schema])
        new.write.parquet(f"{m.path}/{live}")
        m.frozen, m.live, m.refreshed = [*m.frozen, *frozen], live, self.clock()
        m.history.append((m.refreshed, "incremental" if m.immutable_where and n else "full"))

    def refresh(self, view: str, name: str) -> None:
        """Compute a rollup again, but for the rows that its immutable predicate covers: their files are neither read nor written."""
        self._write(self.view(view), self.materializations[view.lower()][name.lower()])

    def drop_materialization(self, view: str, name: str) -> None:
        self.materializations[view.lower()].pop(name.lower())

    def show_materializations(self, view: str) -> DataFrame:
        rows = [(m.name, ",".join(m.dimensions), ",".join(m.metrics), m.refreshed, len(m.history), m.immutable_where) for m in self.materializations.get(view.lower(), {}).values()]
        return self.spark.createDataFrame(rows, "name string, dimensions string, metrics string, refreshed double, refreshes int, immutable_where string")

    def _from_rollup(self, v: SemanticView, q: Query) -> str | None:
        if q.facts or not q.metrics or v.max_staleness is None or v.name.lower() not in self.views or self.policies.covers(self.spark, v):
            return None
        items = [v.find("metric", m) for m in q.metrics]
        if any(len(i) != 1 or not self._fold(i[0]) for i in items):
            return None
        dims = [d.split(".")[-1].lower() for d in q.dimensions]
        metrics = [m.split(".")[-1].lower() for m in q.metrics]
        tokens = lex(q.where or "")
        named = [unquote(t.text) for t, own in zip(tokens, own_names(tokens)) if own]
        used = {n.split(".")[-1].lower() for n in named if v.find("dimension", n)}
        others = {n for n in named if not v.find("dimension", n) and v.find("fact", n)}
        for m in self.materializations.get(v.name.lower(), {}).values():
            if not others and set(dims) | used <= set(m.dimensions) and set(metrics) <= set(m.metrics) and self.clock() - m.refreshed <= v.max_staleness:
                folded = [f"{f'coalesce(SUM(`{n}`), 0)' if self._counts(i[0]) else f'{self._fold(i[0])}(`{n}`)'} AS `{n}`" for i, n in zip(items, metrics, strict=True)]
                keys = [f"`{d}`" for d in dims]
                where = f" WHERE {to_spark(re.sub(r'\b\w+\.(\w+)', r'\1', q.where))}" if q.where else ""
                group = f" GROUP BY {', '.join(keys)}" if keys else ""
                return f"SELECT {', '.join([*keys, *folded])} FROM parquet.`{m.folders()}`{where}{group}"
        return None

    # checks ---------------------------------------------------------------------------

    def check_keys(self, view: str) -> DataFrame:
        """Declared keys that are not unique: table, key, excess rows. A wrong key inflates totals without an error."""
        v, parts = self.view(view), []
        for t in v.tables:
            for key in t.keys():
                cols = ", ".join(f"`{k.lower()}`" for k in key)
                parts.append(f"SELECT '{t.alias}' AS table_name, '{','.join(key)}' AS key, sum(n - 1) AS excess FROM (SELECT {cols}, count(*) AS n FROM {t.source} GROUP BY {cols}) HAVING sum(n - 1) > 0")
        return self.spark.sql(" UNION ALL ".join(parts)) if parts else self.spark.createDataFrame([], "table_name string, key string, excess long")


def _results(tokens: list[Token], held: list[str]) -> list[Token]:
    """TABLE(RESULT_SCAN(LAST_QUERY_ID(n))) as the name of an earlier result."""
    out, at = [], 0
    while at < len(tokens):
        if tokens[at].is_word("TABLE") and [t.text.upper() for t in tokens[at + 1 : at + 6]] == ["(", "RESULT_SCAN", "(", "LAST_QUERY_ID", "("]:
            end = close_of(tokens, at + 5)
            n = int(text_of(tokens[at + 6 : end]).replace(" ", "") or -1)
            if not -len(held) <= n < 0:
                raise QueryError("no such earlier statement")
            out.append(Token("name", held[n]))
            at = close_of(tokens, at + 1) + 1
        else:
            out.append(tokens[at])
            at += 1
    return out


__all__ = ["AccessError", "Engine", "SemanticError"]
