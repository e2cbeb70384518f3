"""From queries to DataFrames: scan, join, filter, aggregate, merge, derive, window, sort.

Each stage is one DataFrame step, so nothing has to be repaired afterwards:
an aggregate of an aggregate, or a window over one, is simply a later step.
Nothing is executed here; Catalyst sees one plan for the whole query.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.functions.canonical import is_aggregate, is_window, reference, references, rewrite, tokens
from loomsheet.model import Catalog, Dimension, Join, Measure
from loomsheet.operators.query import All, Any, Constant, Derived, Not, Query, SetFilter, slug, slugs
from loomsheet.plans.planner import PlanError, Planner, RootPlan
from loomsheet.sources.catalog import Reader, resolver


def condition_refs(node) -> list[str]:
    """Names of all items in a condition."""
    if node is None:
        return []
    if isinstance(node, str):
        return [item for _, item in references(node)]
    if isinstance(node, Not):
        return condition_refs(node.node)
    return [r for n in node.nodes for r in condition_refs(n)]


def conjuncts(node) -> list:
    """The parts of a condition that must all hold."""
    if node is None:
        return []
    return [c for n in node.nodes for c in conjuncts(n)] if isinstance(node, All) else [node]


def condition_sql(node, write) -> str:
    """A condition as text; ``write`` turns a leaf into Spark SQL."""
    if isinstance(node, str):
        return f"({write(node)})"
    if isinstance(node, Not):
        return f"(NOT {condition_sql(node.node, write)})"
    if not node.nodes:
        return "(true)" if isinstance(node, All) else "(false)"
    return "(" + (" AND " if isinstance(node, All) else " OR ").join(condition_sql(n, write) for n in node.nodes) + ")"


class Compiler:
    """``path``: the folder that file sources are read from. ``messages`` collects what the planner has to say."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None) -> None:
        self.spark, self.catalog = spark, catalog
        self.reader, self.planner = Reader(spark, catalog, path), Planner(catalog)
        self.messages: list[str] = []

    # Tables.
    def select(self, table: str, items: dict[str, str], where: str | None = None, as_of: str | None = None) -> DataFrame:
        """Canonical expressions over one table; ``*`` or table.* stands for all of its columns, computed ones too, under their own names."""
        found = resolver(self.catalog, table)
        df = self.reader.scan(table)
        if where:
            df = df.where(rewrite(where, found, as_of))
        out = []
        for name, sql in items.items():
            star = sql == "*" or sql.endswith(".*") and sql[:-2].lower() == table.lower()
            out += [F.col(f"`{table}__{c.name}`").alias(c.name) for c in self.catalog.table(table).columns] if star else [F.expr(rewrite(sql, found, as_of)).alias(name)]
        return df.select(*out)

    def joined(self, plan: RootPlan) -> DataFrame:
        """The root with every table that the plan needs."""
        df = self.reader.scan(plan.root)
        for table, j in plan.joins():
            how = j.kind if self.catalog.table(j.right).name == table else j.kind.flipped()
            right = self.reader.scan(table)
            df = df.crossJoin(right) if j.kind.how == "cross" or not j.sql else df.join(right, F.expr(self.join_sql(j)), how.how)
        return df

    def join_sql(self, j: Join) -> str:
        return rewrite(j.sql, resolver(self.catalog, None, tleft=j.left, tright=j.right))

    def _field_sql(self, plan: RootPlan, name: str, as_of: str | None) -> str:
        path = plan.paths.get(name) or plan.rolled[name]
        return rewrite(path.expression.sql, resolver(self.catalog, path.start), as_of)

    # Queries.
    def compile(self, q: Query, blocks: dict[str, DataFrame] | None = None) -> DataFrame:
        blocks = blocks or {}
        names = [x if isinstance(x, str) else x.name for x in q.select]
        out = slugs([self.catalog.field(n).name if isinstance(x, str) else n for n, x in zip(names, q.select, strict=True)])
        fields = [self.catalog.field(x).name for x in q.select if isinstance(x, str)]
        dims = [n for n in fields if self.planner.kind(n) is Dimension]
        # A window keeps only keys that are selected, or measures, which can be computed beside the selected ones.
        known = {n.lower() for n in names} | {m.name.lower() for m in self.catalog.measures()}
        derived = {x.name: Derived(x.name, pruned_window(x.formula, known) if is_window(x.formula) else x.formula) for x in q.select if isinstance(x, Derived)}
        # Derived items over dimensions alone, without aggregates or windows, are dimensions themselves.
        early = {n: d for n, d in derived.items() if self._row_level(d, derived)}
        formulas, bases = {}, []
        for n in [n for n in fields if n not in dims] + [i for n, d in derived.items() if n not in early for _, i in references(d.formula)]:
            if n in derived or n in dims:
                continue
            x = self.catalog.field(n)
            if isinstance(x, Dimension):
                raise PlanError(f"a formula uses {n}, which isn't selected")
            formulas[x.name], found = self.planner.expand(x.name)
            bases += found
        early_dims = [self.catalog.field(i).name for d in early.values() for _, i in references(d.formula)]
        rows, having, later, sets = self._sorted_conditions(q, dims, early_dims, bases, derived, early, formulas)
        bases = list(dict.fromkeys(bases))
        filter_dims = [self.catalog.field(i).name for c in rows for i in condition_refs(c)] + [d for s in q.sets for d in s.on]
        if not dims and not bases and not early:
            return self._constants(q, out)
        plans = self.planner.plan(dims, bases, list(q.hints), [*filter_dims, *early_dims], q.disjoint, q.grain)
        keys = {n: out[n] for n in (*dims, *early)}
        inner = {b: f"_m{k}" for k, b in enumerate(bases)}
        parts = [(p, self._root(p, q, keys, early, inner, rows, [*q.sets], blocks)) for p in plans]
        for p in plans:
            self.messages += p.messages
        df = self._merged(parts, keys)
        for kept in sets:
            df = self._semi(df, kept, q, keys, blocks)
        columns = {**keys, **inner}
        values = dict(columns)
        # Measures, virtual measures and what is derived from them.
        for n, formula in formulas.items():
            made = out.get(n, f"_v{len(values)}")
            df = df.withColumn(made, F.expr(self._over(formula, values, q.as_of)))
            values[n] = made
        if having:
            df = df.where(reduce(lambda a, b: a & b, [F.expr(condition_sql(c, lambda t: self._over(t, values, q.as_of))) for c in having]))
        for n, d in self._in_order({n: d for n, d in derived.items() if n not in early}):
            df = df.withColumn(out[n], F.expr(self._window(d.formula, values, q.as_of)))
            values[n] = out[n]
        for c in later:
            df = df.where(condition_sql(c, lambda t: self._over(t, values, q.as_of)))
        for x in q.select:
            if isinstance(x, Constant):
                df = df.withColumn(out[x.name], F.lit(x.value))
        if q.distinct:
            df = df.select(*out.values()).distinct()
        df = self._ordered(df, q.order, {**values, **out})
        df = df.select(*out.values())
        return df if q.limit is None else df.limit(q.limit)

    def _row_level(self, d: Derived, derived: dict) -> bool:
        refs = [i for _, i in references(d.formula)]
        if is_window(d.formula) or is_aggregate(d.formula) or not refs:
            return False
        return all(i not in derived and i.lower() in self.catalog.fields and self.planner.kind(i) is Dimension for i in refs)

    def _sorted_conditions(self, q: Query, dims, early_dims, bases: list[str], derived, early, formulas: dict):
        """Conditions by stage: before aggregation, after it, after derived items; and those that need a set of their own."""
        rows, having, later, sets = [], [], [], []
        for c in conjuncts(q.where):
            refs = condition_refs(c)
            if any(r in derived and r not in early for r in refs):
                later.append(c)
                continue
            if any(r in early for r in refs):
                c = self._inlined(c, early)
                refs = condition_refs(c)
            kinds = {self.planner.kind(r) for r in refs}
            if Measure not in kinds:
                rows.append(c)
                continue
            missing = [self.catalog.field(r).name for r in refs if self.planner.kind(r) is Measure and self.catalog.field(r).name not in formulas]
            needed = [b for m in missing for b in self.planner.expand(m)[1]]
            if not missing or self._one_plan(dims, bases, needed, q):
                for m in missing:
                    formulas[m], found = self.planner.expand(m)
                    bases += found
                having.append(c)
            else:
                sets.append(c)
        return rows, having, later, sets

    def _one_plan(self, dims, bases, needed, q: Query) -> bool:
        """Whether the measures of a filter can be computed beside the selected ones."""
        if not bases:
            return not dims or len(self.planner.plan(dims, needed, list(q.hints), (), q.disjoint, q.grain)) == 1
        try:
            before = self.planner.plan(dims, bases, list(q.hints), (), q.disjoint, q.grain)
            after = self.planner.plan(dims, list(dict.fromkeys([*bases, *needed])), list(q.hints), (), q.disjoint, q.grain)
        except PlanError:
            return False
        return {p.root for p in before} == {p.root for p in after}

    def _inlined(self, node, early: dict[str, Derived]):
        if isinstance(node, str):
            return " ".join(f"({early[r[1]].formula})" if t[0] in "@[" and len(t) > 1 and (r := reference(t)) and r[1] in early else t for t in tokens(node))
        if isinstance(node, Not):
            return Not(self._inlined(node.node, early))
        return type(node)(*(self._inlined(n, early) for n in node.nodes))

    def _semi(self, df: DataFrame, c, q: Query, keys: dict[str, str], blocks) -> DataFrame:
        """Keep the groups that meet a condition on measures of another root."""
        dims = [n for n in keys if n.lower() in self.catalog.fields]
        measures = [self.catalog.field(r).name for r in condition_refs(c) if self.planner.kind(r) is Measure]
        inner = self.compile(Query(tuple(dims) + tuple(dict.fromkeys(measures)), where=c, as_of=q.as_of, grain=q.grain), blocks)
        if not dims:
            return df.join(inner.select(F.lit(1).alias("_one")).limit(1), how="left_semi")
        inner = inner.select(*[F.col(slug(d)).alias(f"_k{k}") for k, d in enumerate(dims)])
        return df.join(inner, reduce(lambda a, b: a & b, [F.col(keys[d]).eqNullSafe(F.col(f"_k{k}")) for k, d in enumerate(dims)]), "left_semi")

    def _root(self, p: RootPlan, q: Query, keys, early, inner, rows, sets: list[SetFilter], blocks) -> DataFrame:
        """One root's groups: keys and base measures."""
        df = self.joined(p)
        served = {*p.paths, *p.rolled}

        def over_fields(text: str) -> str:
            return self._over_fields(text, p, q.as_of)

        for c in rows:
            absent = [r for r in condition_refs(c) if self.catalog.field(r).name not in served]
            if absent:
                self.messages.append(f"{p.root} can't apply a filter on {', '.join(absent)}")
                continue
            df = df.where(condition_sql(c, over_fields))
        for k, s in enumerate(sets):
            if all(self.catalog.field(d).name in served for d in s.on):
                on = [F.expr(self._field_sql(p, self.catalog.field(d).name, q.as_of)) == F.col(f"_s{k}_{i}") for i, d in enumerate(s.on)]
                other = blocks[s.block].select(*[F.col(slug(d)).alias(f"_s{k}_{i}") for i, d in enumerate(s.on)])
                df = df.join(other, reduce(lambda a, b: a & b, on), "left_anti" if s.exclude else "left_semi")
        mine = [n for n in keys if n in served or n in early and all(self.catalog.field(i).name in served for _, i in references(early[n].formula))]
        key_columns = [F.expr(over_fields(early[n].formula) if n in early else self._field_sql(p, n, q.as_of)).alias(keys[n]) for n in mine]
        measures = [F.expr(self._field_sql(p, m, q.as_of)).alias(inner[m]) for m in p.measures]
        if not measures:
            df = df.select(*key_columns)
        else:
            df = df.groupBy(*key_columns).agg(*measures) if key_columns else df.agg(*measures)
        # Dimensions that the root can't reach are crossed with its groups, not with its rows.
        for extra in p.crossed:
            got = [n for n in keys if n in extra.paths and n not in mine]
            df = df.crossJoin(self.joined(extra).select(*[F.expr(self._field_sql(extra, n, q.as_of)).alias(keys[n]) for n in got]).distinct())
            mine += got
        return df

    def _over_fields(self, text: str, p: RootPlan, as_of: str | None) -> str:
        def found(parts: list[str]) -> str | None:
            ref = reference(parts[0]) if len(parts) == 1 and parts[0][0] in "@[" else None
            return f"({self._field_sql(p, self.catalog.field(ref[1]).name, as_of)})" if ref else None

        return rewrite(text, found, as_of)

    def _merged(self, parts: list[tuple[RootPlan, DataFrame]], keys: dict[str, str]) -> DataFrame:
        """Roots joined on the dimensions they share, each row of either side kept, null keys meeting; without shared ones, all with all."""
        _, df = parts[0]
        for _, other in parts[1:]:
            shared = [c for c in keys.values() if c in df.columns and c in other.columns]
            df = merged(df, other, shared) if shared else df.crossJoin(other)
        for c in keys.values():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df

    def _over(self, text: str, values: dict[str, str], as_of: str | None) -> str:
        """A formula over items that are columns already."""
        lower = {n.lower(): c for n, c in values.items()}

        def found(parts: list[str]) -> str | None:
            ref = reference(parts[0]) if len(parts) == 1 and parts[0][0] in "@[" else None
            if not ref:
                return None
            if ref[1].lower() not in lower:
                raise PlanError(f"{ref[1]} isn't available here")
            return f"`{lower[ref[1].lower()]}`"

        return rewrite(text, found, as_of)

    def _window(self, text: str, values: dict[str, str], as_of: str | None) -> str:
        return self._over(pruned_window(text, {n.lower() for n in values}) if is_window(text) else text, values, as_of)

    @staticmethod
    def _in_order(derived: dict[str, Derived]) -> list[tuple[str, Derived]]:
        """Items after those they refer to."""
        out: list[tuple[str, Derived]] = []
        left = dict(derived)
        while left:
            ready = [n for n, d in left.items() if not any(i in left for _, i in references(d.formula) if i != n)]
            if not ready:
                raise PlanError(f"{', '.join(left)} refer to each other")
            out += [(n, left.pop(n)) for n in ready]
        return out

    def _constants(self, q: Query, out: dict[str, str]) -> DataFrame:
        df = self.spark.range(1)
        for x in q.select:
            value = F.lit(x.value) if isinstance(x, Constant) else F.expr(rewrite(x.formula, None, q.as_of))
            df = df.withColumn(out[x.name], value)
        return df.select(*out.values())

    @staticmethod
    def _ordered(df: DataFrame, order: tuple, columns: dict[str, str]) -> DataFrame:
        if not order:
            return df
        lower = {n.lower(): c for n, c in columns.items()}
        return df.orderBy(*[sort_column(F.col(lower[o[0].lower()]), *o[1:]) for o in order])


def merged(left: DataFrame, right: DataFrame, shared: list[str], how: str = "full") -> DataFrame:
    """Two results joined on columns that both have; null meets null, and a key is that of whichever side has the row."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    both = left.join(right, reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in shared]), how)
    if how in ("left_semi", "left_anti"):
        return both
    keys = {c: F.coalesce(left[c], right[f"_r_{c}"]) for c in shared}
    return both.select(*[keys[c].alias(c) if c in keys else left[c] for c in left.columns], *[right[c] for c in right.columns if not c.startswith("_r_") or c[3:] not in keys])


def sort_column(c: Column, way: str = "asc", nulls: str | None = None) -> Column:
    end = {None: "", "nulls first": "_nulls_first", "nulls last": "_nulls_last"}[nulls.lower() if nulls else None]
    return getattr(c, way.lower() + end)()


_OVER = re.compile(r"\bover\s*\(", re.I)


def pruned_window(text: str, known: set[str]) -> str:
    """Window specifications without keys that name an unknown item; without order keys, the frame goes as well."""
    out, rest = [], text
    while m := _OVER.search(rest):
        depth, end = 1, m.end()
        while end < len(rest) and depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        spec = rest[m.end() : end - 1]
        frame = re.search(r"\b(rows|range)\b.*", spec, re.I | re.S)
        head = spec[: frame.start()] if frame else spec
        order = re.search(r"\border\s+by\b(.*)", head, re.I | re.S)
        part = re.search(r"\bpartition\s+by\b(.*?)(?=\border\s+by\b|\Z)", head, re.I | re.S)
        kept = {k: [x.strip() for x in _commas(g[1]) if all(i.lower() in known for _, i in references(x))] for k, g in (("PARTITION BY", part), ("ORDER BY", order)) if g}
        parts = [f"{k} {', '.join(v)}" for k, v in kept.items() if v]
        if frame and kept.get("ORDER BY"):
            parts.append(frame[0].strip())
        out += [rest[: m.start()], f"OVER ({' '.join(parts)})"]
        rest = rest[end:]
    return "".join([*out, rest])


def _commas(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]
