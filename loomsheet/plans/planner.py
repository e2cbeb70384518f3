"""From fields to plans: roots chosen by a cost matrix, one plan per root that a measure needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from loomsheet.model import Catalog, Dimension, Join, Measure, TableType
from loomsheet.plans.graph import Graph, Path


class PlanError(ValueError):
    pass


@dataclass
class RootPlan:
    """Fields served at one root. ``crossed``: dimensions from plans of other roots, joined without a condition."""

    root: str
    paths: dict[str, Path]
    measures: list[str]
    rolled: dict[str, Path] = field(default_factory=dict)
    crossed: list[RootPlan] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)

    @property
    def tables(self) -> set[str]:
        return {t for p in (*self.paths.values(), *self.rolled.values()) for t in p.tables} | {self.root}

    def joins(self) -> list[tuple[str, Join]]:
        """The tables to join after the root, in order, with their joins; each pair of tables once, no table that no path needs."""
        paths = sorted(self.paths.values(), key=lambda p: (-p.cost, p.start, p.tables))
        seen, out = {self.root}, []
        todo = [list(zip(reversed(p.tables[:-1]), reversed(p.joins), strict=True)) for p in paths]
        todo += [list(zip(reversed(p.tables[:-1]), reversed(p.joins), strict=True)) for p in self.rolled.values()]
        for steps in todo:
            for table, j in steps:
                if table not in seen:
                    seen.add(table)
                    out.append((table, j))
        return out


class Planner:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.graph = catalog, Graph(catalog)

    # The cost matrix.
    def matrix(self, names: list[str]) -> dict[str, dict[str, Path]]:
        """By root and field the best path: the select table that scores highest, then cost, hops and names."""
        paths = {n: self.graph.base_paths(self.catalog.field(n)) for n in names}
        starts = {n: {p.start for p in of} for n, of in paths.items()}
        rows: dict[str, dict[str, list[Path]]] = {}
        for n, of in paths.items():
            for p in of:
                rows.setdefault(p.root, {}).setdefault(n, []).append(p)

        def rank(n: str, p: Path):
            score = 16 * self.graph.is_fact(p.start) + sum(p.start in starts[o] for o in names if o != n)
            return (-score, p.cost, len(p.tables), p.tables)

        return {root: {n: min(of, key=lambda p, n=n: rank(n, p)) for n, of in row.items()} for root, row in rows.items()}

    def _hinted(self, row: dict[str, Path], hints: list[str]) -> int:
        tables = {t.lower() for p in row.values() for t in p.tables}
        return sum(h.lower() in tables for h in hints)

    def plan(self, dims: list[str], measures: list[str], hints: list[str] = (), filter_dims: list[str] = (), disjoint: str = "suppress", grain: str = "safe") -> list[RootPlan]:
        """Plans for selected dimensions and measures.

        ``filter_dims`` are joined where they can be reached. ``disjoint`` says
        what becomes of a dimension that a root can't reach: suppress (null),
        cross (joined without a condition) or error. ``grain``: safe computes a
        measure only at its own tables, unless a dimension can't be reached
        there, and says so in a message; strict refuses that; reference lets it
        travel to finer roots, where it repeats.
        """
        dims, measures = (list(dict.fromkeys(self.catalog.field(n).name for n in of)) for of in (dims, measures))
        wanted = list(dict.fromkeys(self.catalog.field(n).name for n in (*dims, *filter_dims)))
        plans = self._measured(wanted, measures, list(hints), grain) if measures else self._plain(wanted, list(hints))
        for p in plans:
            self._complete(p, dims, disjoint, grain == "strict")
        return plans

    def _plain(self, dims: list[str], hints: list[str]) -> list[RootPlan]:
        if not dims:
            return []
        rows = self.matrix(dims)

        def order(root: str):
            row = rows[root]
            own = any(p.start == root for p in row.values())
            kind = self.catalog.table(root).kind is not TableType.DIMENSION
            return (-self._hinted(row, hints), -len(row), not own, kind, sum(p.cost for p in row.values()), root)

        root = min(rows, key=order)
        return [RootPlan(root, rows[root], [])]

    def _measured(self, dims: list[str], measures: list[str], hints: list[str], grain: str) -> list[RootPlan]:
        rows = self.matrix(dims + measures)

        def here(m: str, root: str) -> bool:
            """Whether a measure may be computed at a root."""
            path = rows[root].get(m)
            return path is not None and (grain == "reference" or len(path.tables) == 1)

        def order(root: str):
            row = rows[root]
            reached = [d for d in dims if d in row]
            own = any(p.start == root for p in row.values())
            return (-self._hinted(row, hints), -len(reached), sum(p.cost for p in row.values()), not own, root)

        pending, plans = list(measures), []
        for root in sorted(rows, key=order):
            served = [m for m in pending if here(m, root) and (grain == "reference" or self._best_own(m, root, rows, dims))]
            if served:
                pending = [m for m in pending if m not in served]
                plans.append(RootPlan(root, {n: p for n, p in rows[root].items() if n in dims or n in served}, served))
        if pending:
            raise PlanError(f"measures that no table serves: {', '.join(pending)}")
        if grain == "reference":
            return self._pruned(plans)
        moved = [self._coarsened(p, rows, dims, order) for p in plans]
        if grain == "strict" and (repeated := [m for p in moved for m in p.messages]):
            raise PlanError("; ".join(repeated))
        return self._pruned(moved)

    def _best_own(self, m: str, root: str, rows: dict, dims: list[str]) -> bool:
        """Whether, of the tables a measure is defined on, this one reaches the most dimensions."""
        own = [r for r in rows if (p := rows[r].get(m)) is not None and len(p.tables) == 1]
        reach = lambda r: sum(d in rows[r] for d in dims)
        return reach(root) == max(map(reach, own))

    def _coarsened(self, p: RootPlan, rows: dict, dims: list[str], order) -> RootPlan:
        """The plan, moved to a finer root if its own reaches a dimension less than that one does; a message says that values repeat."""
        reached = [d for d in dims if d in rows[p.root]]
        if len(reached) == len(dims):
            return p
        finer = [r for r in rows if all(m in rows[r] for m in p.measures) and sum(d in rows[r] for d in dims) > len(reached)]
        if not finer:
            return p
        root = min(finer, key=order)
        moved = RootPlan(root, {n: q for n, q in rows[root].items() if n in dims or n in p.measures}, p.measures)
        moved.messages.append(f"{', '.join(p.measures)} computed at {root}, where rows of {p.root} repeat, to reach {', '.join(d for d in dims if d in rows[root] and d not in reached)}")
        return moved

    @staticmethod
    def _pruned(plans: list[RootPlan]) -> list[RootPlan]:
        return [p for p in plans if not any(set(p.measures) < set(q.measures) for q in plans)]

    def _complete(self, plan: RootPlan, dims: list[str], disjoint: str, strict: bool = False) -> None:
        """Roll down to dimensions that the root doesn't reach; then treat the rest as disjoint."""
        left = [d for d in dims if d not in plan.paths]
        for d in list(left):
            paths = self.graph.secondary_paths(self.catalog.field(d), plan.tables)
            paths = [p for p in paths if not (any(map(self.graph.is_fact, p.tables[:-1])) and any(map(self.graph.is_fact, plan.tables)))]
            if paths:
                best = min(paths, key=lambda p: (p.cost, len(p.tables), p.tables))
                plan.rolled[d] = best
                left.remove(d)
                if any(j.allow_roll_down != 1 for j in best.joins):
                    if strict and plan.measures:
                        raise PlanError(f"{d} lies on {best.start}, finer than {plan.root}: rows would repeat")
                    plan.messages.append(f"{d} lies on {best.start}, finer than {plan.root}: rows may be duplicated")
        if not left:
            return
        if disjoint == "error":
            raise PlanError(f"{plan.root} reaches no {', '.join(left)}")
        if disjoint == "suppress":
            plan.missing = left
            plan.messages.append(f"{plan.root} reaches no {', '.join(left)}; they are null")
            return
        while left:  # greedily, the root that serves most of what is left
            rows = self.matrix(left)
            root = min(rows, key=lambda r: (-len(rows[r]), sum(p.cost for p in rows[r].values()), r))
            plan.crossed.append(RootPlan(root, rows[root], []))
            plan.messages.append(f"{', '.join(rows[root])} joined to {plan.root} without a condition")
            left = [d for d in left if d not in rows[root]]

    def expand(self, name: str) -> tuple[str, list[str]]:
        """A virtual measure as a formula over base measures, and these; a base measure as itself."""
        from loomsheet.functions.canonical import reference, tokens

        x = self.catalog.field(name)
        if not isinstance(x, Measure) or not x.virtual:
            return f"[{x.name}]", [x.name]
        parts, found = [], []
        for t in tokens(x.expressions[0].sql):
            ref = reference(t) if t[0] in "@[" and len(t) > 1 else None
            if ref:
                if ref[1].lower() == name.lower():
                    raise PlanError(f"{name} refers to itself")
                formula, bases = self.expand(ref[1])
                parts.append(f"({formula})")
                found += bases
            else:
                parts.append(t)
        return " ".join(parts), list(dict.fromkeys(found))

    def kind(self, name: str) -> type:
        return Dimension if isinstance(self.catalog.field(name), Dimension) else Measure
