"""The join graph: which way leads from a metric's entity to a dimension's, and whether it keeps the grain."""

from __future__ import annotations

from dataclasses import dataclass

from quillon.errors import QueryError
from quillon.model.schema import Relationship, SemanticView


@dataclass(frozen=True)
class Edge:
    """A relationship walked from its many side, or back where the many side's key is declared unique."""

    relationship: str
    start: str
    end: str
    back: bool = False


class JoinGraph:
    def __init__(self, view: SemanticView):
        self.view = view
        self.by_name = {r.name.lower(): r for r in view.relationships}
        self.edges: dict[str, list[Edge]] = {}
        for r in view.relationships:
            self.edges.setdefault(r.left.lower(), []).append(Edge(r.name.lower(), r.left.lower(), r.right.lower()))
            fk = {k.lower() for k in r.left_keys}
            if not r.range and not r.asof and any({k.lower() for k in key} <= fk for key in view.table(r.left).keys()):
                self.edges.setdefault(r.right.lower(), []).append(Edge(r.name.lower(), r.right.lower(), r.left.lower(), True))

    def relationship(self, edge: Edge) -> Relationship:
        return self.by_name[edge.relationship]

    def paths(self, start: str, end: str) -> list[tuple[Edge, ...]]:
        """All simple paths; those that never walk back come alone where there are any."""
        start, end, found = start.lower(), end.lower(), []

        def walk(at: str, path: tuple[Edge, ...], seen: frozenset[str]) -> None:
            if at == end:
                found.append(path)
                return
            for e in self.edges.get(at, []):
                if e.end not in seen:
                    walk(e.end, (*path, e), seen | {e.end})

        walk(start, (), frozenset({start}))
        forward = [p for p in found if not any(e.back for e in p)]
        return forward or found

    def choose(self, start: str, end: str, using: list[str]) -> tuple[Edge, ...]:
        """The one path from a metric's entity to a dimension's, by USING where there are several."""
        found = self.paths(start, end)
        if not found:
            raise QueryError(f"The dimension entity '{end.upper()}' must be related to and have an equal or lower level of granularity compared to the base metric or dimension entity '{start.upper()}'.")
        if len(found) > 1 and using:
            want = {u.lower() for u in using}
            found = [p for p in found if any(e.relationship in want for e in p)] or found
        if len(found) > 1:
            raise QueryError(f"Multi-path relationship between the dimension entity '{end.upper()}' and the base metric or dimension entity '{start.upper()}' is not supported.")
        return found[0]
