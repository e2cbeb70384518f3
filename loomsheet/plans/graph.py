"""Paths through the model: from a field's table to the tables it can be served at.

A join leads from its one side to its many side. Following joins that way
never repeats a row of the start table's facts at the root more often than the
root has rows, so these are the paths that don't fan out measures of the root.
Against that direction lie roll-down paths, which do repeat rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from loomsheet.model import Cardinality, Catalog, Expressible, FieldExpression, Join, TableType


@dataclass(frozen=True)
class Path:
    """A field, one of its expressions, and the tables from the expression's to the root's, with the joins between."""

    field: str
    expression: FieldExpression
    tables: tuple[str, ...]
    joins: tuple[Join, ...]
    cost: int

    @property
    def start(self) -> str:
        return self.tables[0]

    @property
    def root(self) -> str:
        return self.tables[-1]


#: Paths from one table to another that are weighed.
PATHS = 8


class _Joins(tuple):
    """Joins of a path; two paths of one cost and the same tables stay in the order they were found."""

    def __lt__(self, other) -> bool:
        return False


class Graph:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.down: dict[str, list[tuple[str, Join]]] = {}  # one side to many side
        for j in catalog.joins:
            left, right = (catalog.table(t).name for t in (j.left, j.right))
            if j.cardinality is not Cardinality.MANY_TO_ONE:
                self.down.setdefault(left, []).append((right, j))
            if j.cardinality is not Cardinality.ONE_TO_MANY:
                self.down.setdefault(right, []).append((left, j))
        for of in self.down.values():
            of.sort(key=lambda x: x[0])

    def up(self, table: str) -> list[tuple[str, Join]]:
        """Neighbours on the one side."""
        return sorted(((a, j) for a, of in self.down.items() for b, j in of if b == table), key=lambda x: x[0])

    def _walk(self, start: str, step) -> list[tuple[tuple[str, ...], tuple[Join, ...]]]:
        """Simple paths from a table, itself first, cheapest first; to each table the ``PATHS`` cheapest, so dense models don't multiply them."""
        found, reached = [], {}
        heap = [(0, 0, (start,), ())]
        while heap:
            cost, hops, tables, joins = heapq.heappop(heap)
            n = reached[tables[-1]] = reached.get(tables[-1], 0) + 1
            if n > PATHS:
                continue
            found.append((tables, joins))
            for nxt, j in step(tables[-1]):
                if nxt not in tables:
                    heapq.heappush(heap, (cost + self.catalog.join_cost(j), hops + 1, (*tables, nxt), _Joins((*joins, j))))
        return found

    def _path(self, x: Expressible, e: FieldExpression, tables, joins) -> Path:
        cost = sum(map(self.catalog.join_cost, joins)) if joins else self.catalog.table(tables[-1]).row_count
        return Path(x.name, e, tables, joins, cost)

    def base_paths(self, x: Expressible) -> list[Path]:
        """Every way to serve a field at a root without fan-out."""
        step = lambda t: self.down.get(t, [])
        return [self._path(x, e, *p) for e in x.expressions for t in e.tables for p in self._walk(self.catalog.table(t).name, step)]

    def secondary_paths(self, x: Expressible, targets: set[str]) -> list[Path]:
        """Roll-down: from a finer table along joins many to one, ending in a table that a plan holds already."""
        step = lambda t: [(n, j) for n, j in self.up(t) if j.allow_roll_down != 0]
        found = [self._path(x, e, *p) for e in x.expressions for t in e.tables for p in self._walk(self.catalog.table(t).name, step)]
        return [p for p in found if p.root in targets and len(p.tables) > 1 and not set(p.tables[:-1]) & targets]

    def all_base_paths(self) -> list[Path]:
        return [p for x in self.catalog.fields.values() for p in self.base_paths(x)]

    def reaches(self, x: Expressible) -> set[str]:
        """Roots at which a field can be served."""
        return {p.root for p in self.base_paths(x)}

    def compatible(self, names: list[str]) -> list[str]:
        """Fields that share a root with all of the named ones."""
        chosen = [self.catalog.field(n) for n in names]
        roots = set.intersection(*(self.reaches(x) for x in chosen)) if chosen else set(t.name for t in self.catalog.tables.values())
        return sorted(x.name for x in self.catalog.fields.values() if x.name not in {c.name for c in chosen} and self.reaches(x) & roots)

    def universe(self, names: list[str]) -> tuple[list[str], dict[str, list[str]]]:
        """What can be added to the named fields: those of one root with all of them; and for each further measure, which gets a root of its own, the dimensions it shares with the measures named."""
        same = self.compatible(names)
        chosen = [self.catalog.field(n) for n in names]
        roots = [self.reaches(x) for x in chosen if x in self.catalog.measures()]
        if not roots:
            return same, {}
        dims = [d for d in self.catalog.dimensions() if all(self.reaches(d) & r for r in roots)]
        others = [m for m in self.catalog.measures() if not m.virtual and m.name not in same and m not in chosen]
        found = {m.name: sorted(d.name for d in dims if self.reaches(d) & self.reaches(m)) for m in others}
        return same, {m: d for m, d in found.items() if d}

    def is_fact(self, table: str) -> bool:
        return self.catalog.table(table).kind is TableType.FACT
