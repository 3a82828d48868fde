"""Semantic views as YAML text: reader and writer. The writer's text reads back as the same view."""

from __future__ import annotations

from collections.abc import Callable

from quillon.errors import DeployError
from quillon.model.schema import Extras, Item, Relationship, SemanticView, Table, Variable

try:
    import yaml
except ModuleNotFoundError:  # an optional library: DDL text and objects work without it
    yaml = None


def _library():
    if yaml is None:
        raise DeployError("YAML needs the PyYAML library")
    return yaml


def _extras(d: dict) -> Extras:
    said = d.get("description") or d.get("comment")
    return Extras(list(d.get("synonyms") or []), said.strip() if said else None, {t["name"]: str(t.get("value", "")) for t in d.get("tags") or []}, d.get("access_modifier") == "private_access")


def _said(x: Extras) -> dict:
    out: dict = {"synonyms": x.synonyms} if x.synonyms else {}
    out |= {"description": x.comment} if x.comment else {}
    out |= {"tags": [{"name": k, "value": v} for k, v in x.tags.items()]} if x.tags else {}
    return out | ({"access_modifier": "private_access"} if x.private else {})


def _source(base: dict | str) -> str:
    """db.schema.table of a base table, or a parenthesised SELECT."""
    if isinstance(base, str):
        return base
    if base.get("definition"):
        return f"({base['definition'].strip().rstrip(';')})"
    return ".".join(str(base[k]) for k in ("database", "schema", "table") if base.get(k))


def _items(table: dict, kind: str) -> list[Item]:
    out = []
    for d in table.get(kind) or []:
        order = [(f"{n['table']}.{n['dimension']}" if n.get("table") else n["dimension"], "DESC" if str(n.get("sort_direction", "")).lower().startswith("desc") else "ASC") for n in d.get("non_additive_dimensions") or []]
        out.append(Item(d["name"], table.get("name"), str(d["expr"]), list(d.get("using_relationships") or []), order, _extras(d)))
    return out


def from_yaml(text: str, place: Callable[[str], str] = lambda name: name) -> SemanticView:
    """The view of a YAML text; ``place`` says where a base table (by its dotted name) is found."""
    d = _library().safe_load(text)
    if not isinstance(d, dict) or not d.get("name"):
        raise DeployError("a semantic view in YAML needs a name")
    tables, facts, dimensions, metrics = [], [], [], []
    for t in d.get("tables") or []:
        source = _source(t.get("base_table") or t["name"])
        ranges = [c["distinct_range"] for c in t.get("constraints") or [] if c.get("distinct_range")]
        keys = [list(k["columns"]) for k in t.get("unique_keys") or []]
        made = Table(t["name"], source if source.startswith("(") else place(source), list((t.get("primary_key") or {}).get("columns") or []), keys, (ranges[0]["start_column"], ranges[0]["end_column"]) if ranges else None, _extras(t))
        tables.append(made)
        facts += _items(t, "facts")
        dimensions += [*_items(t, "dimensions"), *_items(t, "time_dimensions")]
        metrics += _items(t, "metrics")
    metrics += _items({"metrics": d.get("metrics")}, "metrics")
    links = []
    for r in d.get("relationships") or []:
        left, right, between, asof = [], [], None, None
        for c in r["relationship_columns"]:
            left.append(c["left_column"])
            kind = str(c.get("type", "")).lower()
            if kind == "range":
                between = (c["right_range"]["start_column"], c["right_range"]["end_column"])
            elif kind == "asof":
                asof = c["right_column"]
            else:
                right.append(c["right_column"])
        links.append(Relationship(r["name"], r["left_table"], left, r["right_table"], right, between, asof))
    variables = [Variable(v["name"], str(v.get("data_type", "VARCHAR")), None if v.get("default") is None else str(v["default"])) for v in d.get("variables") or []]
    told = {k: str(v).strip() for k, v in (d.get("module_custom_instructions") or {}).items()}
    if isinstance(d.get("custom_instructions"), str):
        told["sql_generation"] = d["custom_instructions"].strip()
    asked = [{k: q[k] for k in ("name", "question", "sql", "verified_by", "verified_at") if k in q} for q in d.get("verified_queries") or []]
    return SemanticView(d["name"], tables, links, facts, dimensions, metrics, variables, Extras(comment=(d.get("description") or "").strip() or None), asked, told)


def to_yaml(view: SemanticView) -> str:
    """YAML text of a view."""
    def item(i: Item) -> dict:
        out = {"name": i.name, "expr": i.expr} | _said(i.extras)
        if i.using:
            out["using_relationships"] = i.using
        if i.non_additive:
            parts = [(d.rsplit(".", 1), o) for d, o in i.non_additive]
            out["non_additive_dimensions"] = [({"table": p[0]} if len(p) > 1 else {}) | {"dimension": p[-1], "sort_direction": "descending" if o.upper().startswith("DESC") else "ascending", "null_order": "last"} for p, o in parts]
        return out

    def base(t: Table) -> dict:
        if t.is_query:
            return {"definition": t.source.strip()[1:-1].strip()}
        parts = t.source.split(".")
        return dict(zip(("database", "schema", "table")[-len(parts) :], parts))

    def table(t: Table) -> dict:
        out: dict = {"name": t.alias, "base_table": base(t)} | _said(t.extras)
        if t.primary_key:
            out["primary_key"] = {"columns": t.primary_key}
        if t.unique:
            out["unique_keys"] = [{"columns": k} for k in t.unique]
        if t.distinct_range:
            out["constraints"] = [{"name": f"{t.alias}_range", "distinct_range": dict(zip(("start_column", "end_column"), t.distinct_range))}]
        for kind, items in (("facts", view.facts), ("dimensions", view.dimensions), ("metrics", view.metrics)):
            own = [item(i) for i in items if (i.entity or "").lower() == t.alias.lower()]
            out |= {kind: own} if own else {}
        return out

    def link(r: Relationship) -> dict:
        columns = []
        for k, left in enumerate(r.left_keys):
            last = k == len(r.left_keys) - 1
            if last and r.range:
                columns.append({"left_column": left, "type": "range", "right_range": dict(zip(("start_column", "end_column"), r.range))})
            elif last and r.asof:
                columns.append({"left_column": left, "type": "asof", "right_column": r.asof})
            else:
                columns.append({"left_column": left, "right_column": r.right_keys[k]})
        return {"name": r.name, "left_table": r.left, "right_table": r.right, "relationship_columns": columns}

    for r in view.relationships:  # keys that the text leaves to the primary key are written out
        if not r.right_keys and not r.range and not r.asof:
            r.right_keys = list(view.table(r.right).primary_key)
    out: dict = {"name": view.name} | ({"description": view.extras.comment} if view.extras.comment else {})
    out["tables"] = [table(t) for t in view.tables]
    derived = [item(m) for m in view.metrics if not m.entity]
    for key, value in (("relationships", [link(r) for r in view.relationships]), ("metrics", derived), ("variables", [{"name": v.name, "data_type": v.type} | ({"default": v.default} if v.default is not None else {}) for v in view.variables]), ("verified_queries", view.verified_queries), ("module_custom_instructions", view.instructions)):
        out |= {key: value} if value else {}
    return _library().safe_dump(out, sort_keys=False, allow_unicode=True, width=1000)
