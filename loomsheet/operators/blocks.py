"""Reports of several blocks: set filters, joins of blocks, re-aggregation, merged results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.functions.canonical import calls, is_window, reference, references, rewrite, tokens
from loomsheet.model import Dimension, Measure
from loomsheet.operators.compiler import Compiler, condition_sql, conjuncts, merged, pruned_window, sort_column
from loomsheet.operators.query import Block, BlockJoin, Constant, Derived, Report, slug
from loomsheet.plans.planner import PlanError


class ReportRunner:
    """``run`` returns every block's DataFrame; the last block is the report's result.

    Blocks are lazy. One with ``keep`` is cached, as several blocks read it;
    ``close`` frees it. The project's row limit is applied by ``result`` alone.
    """

    def __init__(self, compiler: Compiler) -> None:
        self.compiler, self.spark = compiler, compiler.spark
        self.frames: dict[str, DataFrame] = {}
        self.dims: dict[str, list[str]] = {}
        self.adds: dict[str, dict[str, str | None]] = {}  # by block and column, how values may be aggregated again
        self.kept: list[DataFrame] = []

    def run(self, report: Report) -> dict[str, DataFrame]:
        for b in report.blocks:
            df = self._block(b)
            if b.keep:
                df = df.cache()
                self.kept.append(df)
            self.frames[b.name] = df
            df.createOrReplaceTempView(slug(b.name))
        return self.frames

    def result(self, report: Report) -> DataFrame:
        df = self.run(report)[report.blocks[-1].name]
        most = self.compiler.catalog.project.max_result_rows
        return df.limit(most) if most > 0 else df

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        for name in self.frames:
            self.spark.catalog.dropTempView(slug(name))
        self.frames, self.kept = {}, []

    def _block(self, b: Block) -> DataFrame:
        if b.sql is not None or b.values is not None:
            if b.sql is not None:
                df = self.spark.sql(b.sql)
            else:
                columns = list(b.columns) or [f"col{k + 1}" for k in range(len(b.values[0]))]
                df = self.spark.createDataFrame(list(b.values), columns)
            if b.dims is not None:
                self.dims[b.name] = [slug(d) if slug(d) in df.columns else d for d in b.dims]
            else:
                earlier = {d for of in self.dims.values() for d in of}
                self.dims[b.name] = [c for c, t in df.dtypes if c in earlier or t in ("string", "date", "boolean") or t.startswith("timestamp")]
            self.adds[b.name] = {c: "sum" for c in df.columns}
            return df
        if b.query is not None:
            df = self.compiler.compile(b.query, self.frames)
            fields = self.compiler.catalog.fields
            self.dims[b.name] = [slug(x) for x in b.query.select if isinstance(x, str) and isinstance(fields.get(x.lower()), Dimension)]
            names = [x if isinstance(x, str) else x.name for x in b.query.select]
            self.adds[b.name] = {slug(n): self._additive(fields.get(n.lower()) if isinstance(x, str) else None) for n, x in zip(names, b.query.select, strict=True)}
            return df
        return self._combined(b)

    @staticmethod
    def _additive(field) -> str | None:
        """How values of a measure are aggregated again: sum, min or max, if the measure is one such aggregate."""
        if not isinstance(field, Measure) or field.virtual:
            return None
        ways = set()
        for e in field.expressions:
            ts = [t.lower() for t in tokens(e.sql)]
            whole = len(calls(e.sql)) >= 1 and ts[1:2] == ["("] and ts[-1] == ")" and _closes(ts) == len(ts) - 1
            ways.add({"sum": "sum", "count": "sum", "min": "min", "max": "max"}.get(ts[0]) if whole and "distinct" not in ts else None)
        return ways.pop() if len(ways) == 1 else None

    def _combined(self, b: Block) -> DataFrame:
        """Blocks joined on their common dimensions, then a selection, aggregated again if it is coarser."""
        if b.source is None:
            raise PlanError(f"{b.name} has neither a query, SQL nor a source")
        df, columns, dims = self._renamed(b.source), {}, list(self.dims[b.source])
        owner = {f"{slug(b.source)}__{c}": (b.source, c) for c in self.frames[b.source].columns}
        own_dims, twins = {b.source: list(dims)}, {}
        for c in self.frames[b.source].columns:
            columns[None, c] = columns[b.source.lower(), c] = c if c in dims else f"{slug(b.source)}__{c}"
        for j in b.joins:
            df, mine, equal = self._joined(df, dims, j, columns)
            twins |= equal
            if j.how not in ("left_semi", "left_anti"):
                owner |= {f"{slug(j.block)}__{c}": (j.block, c) for c in self.frames[j.block].columns}
                own_dims[j.block] = [twins.get(d, d) for d in mine.values()]
                dims += [d for d in mine.values() if d not in dims]

        def write(text: str) -> str:
            def found(parts: list[str]) -> str | None:
                ref = reference(parts[0]) if len(parts) == 1 and parts[0][0] in "@[" else None
                if not ref:
                    return None
                key = (ref[0].lower() if ref[0] else None, slug(ref[1]))
                if key not in columns:
                    raise PlanError(f"{b.name}: no item {parts[0]}")
                return f"`{columns[key]}`"

            return rewrite(text, found)

        every = [f"[{c}]" for c in self.frames[b.source].columns]
        wanted = [y for x in b.select for y in (self._every(x, b, every) if isinstance(x, str) and x.endswith("*") else [x])] or every
        chosen = [(x if isinstance(x, str) else x.name, x) for x in wanted]
        for c in conjuncts(b.where):
            df = df.where(condition_sql(c, write))
        keys, measures, derived = [], [], []
        for name, x in chosen:
            if isinstance(x, Constant):
                derived.append((slug(name), None, x.value))
            elif isinstance(x, Derived):
                derived.append((slug(name), x.formula, None))
            else:
                ref = self._ref(name)
                column = columns.get((ref[0].lower() if ref[0] else None, slug(ref[1])))
                if column is None:
                    raise PlanError(f"{b.name}: no item {name}")
                (keys if column in dims else measures).append((slug(ref[1]) if column in dims or (None, slug(ref[1])) in columns else column, column))
        coarser = bool({twins.get(d, d) for d in dims} - {twins.get(c, c) for _, c in keys})
        needed = {columns[k] for _, f, _ in derived if f for r in references(f) if (k := (r[0].lower() if r[0] else None, slug(r[1]))) in columns}
        hidden = [c for c in needed if c not in dims and c not in {m for _, m in measures}]
        if coarser and (measures or hidden):
            df = self._aggregated(b, df, [c for _, c in keys], [*measures, *((c, c) for c in hidden)], owner, own_dims, [twins.get(d, d) for d in dims])
        for name, formula, value in derived:
            if formula is None:
                df = df.withColumn(name, F.lit(value))
            else:
                known = {i for (_, i) in columns} | {r[1].lower() for r in references(formula) if (r[0].lower() if r[0] else None, slug(r[1])) in columns}
                df = df.withColumn(name, F.expr(write(pruned_window(formula, known) if is_window(formula) else formula)))
        out = {c: n for n, c in [*keys, *measures]}
        order_names = {slug(self._ref(n)[1]) if isinstance(x, str) else slug(n): n for n, x in chosen}
        df = df.select(*[F.col(c).alias(n) for c, n in out.items()], *[F.col(n) for n, _, _ in derived])
        wanted = list(dict.fromkeys(out.get(columns.get(self._key(n)), slug(self._ref(n)[1])) if isinstance(x, str) else slug(n) for n, x in chosen))
        df = df.select(*wanted)
        self.dims[b.name] = [n for n, _ in keys]
        self.adds[b.name] = {n: (self.adds[owner[c][0]].get(owner[c][1]) if c in owner and self._told(b, n, c, self._ref) in (None, "sum", "min", "max") else None) for n, c in measures}
        if b.order:
            missing = [o[0] for o in b.order if slug(self._ref(o[0])[1]) not in df.columns]
            if missing:
                raise PlanError(f"{b.name}: sorted by {missing}, which isn't among {sorted(order_names)}")
            df = df.orderBy(*[sort_column(F.col(slug(self._ref(o[0])[1])), *o[1:]) for o in b.order])
        return df if b.limit is None else df.limit(b.limit)

    def _key(self, name: str) -> tuple[str | None, str]:
        ref = self._ref(name)
        return (ref[0].lower() if ref[0] else None, slug(ref[1]))

    @staticmethod
    def _ref(name: str) -> tuple[str | None, str]:
        ts = tokens(name)
        found = reference(ts[0]) if len(ts) == 1 and ts[0][0] in "@[" else None
        return found or (None, name)

    @staticmethod
    def _told(b: Block, name: str, column: str, ref) -> str | None:
        return next((v for k, v in b.again.items() if slug(ref(k)[1]) == name or column.endswith("__" + slug(ref(k)[1]))), None)

    def _aggregated(self, b: Block, df: DataFrame, keys: list[str], measures: list[tuple[str, str]], owner: dict, own_dims: dict, dims: list[str]) -> DataFrame:
        """Measures at the keys. What ``again`` names is aggregated over all rows, the rest with each value of its block once."""
        parts: dict[tuple[str, ...], list] = {}
        for name, c in measures:
            how = self._told(b, name, c, self._ref)
            block, item = owner[c]
            if how is None and (how := self.adds[block].get(item)) is None:
                raise PlanError(f"{b.name}: {item} can't be aggregated again; say how in again")
            told = self._told(b, name, c, self._ref) is not None
            repeated = not told and set(dims) - set(own_dims[block])
            parts.setdefault(tuple(own_dims[block]) if repeated else (), []).append((c, how))
        out = None
        for once, of in parts.items():
            rows = df
            if once:  # a row for each of the block's own
                rows = df.groupBy(*dict.fromkeys([*keys, *once])).agg(*[F.max(c).alias(c) for c, _ in of])
            made = [getattr(F, how)(c).alias(c) for c, how in of]
            rows = rows.groupBy(*keys).agg(*made) if keys else rows.agg(*made)
            out = rows if out is None else merged(out, rows, keys, "inner") if keys else out.crossJoin(rows)
        return out

    def _every(self, x: str, b: Block, every: list[str]) -> list[str]:
        """The items that ``*`` or @[block].* stands for."""
        if x == "*":
            return every + [f"@[{j.block}].[{c}]" for j in b.joins if j.how not in ("left_semi", "left_anti") for c in self.frames[j.block].columns if f"[{c}]" not in every]
        block = x[:-2].strip("@[]")
        return [f"@[{block}].[{c}]" for c in next(f for n, f in self.frames.items() if n.lower() == block.lower()).columns]

    def _renamed(self, name: str) -> DataFrame:
        """A block whose measures carry its name; dimensions keep theirs."""
        df, dims = self.frames[name], self.dims[name]
        return df.select(*[F.col(c).alias(c if c in dims else f"{slug(name)}__{c}") for c in df.columns])

    def _pairs(self, dims: list[str], j: BlockJoin, columns: dict) -> list[tuple[str, str]]:
        """Columns so far and columns of the block that must be equal."""
        if j.on is None:
            return [(d, d) for d in dims if d in self.dims[j.block]]
        if isinstance(j.on, str):
            out = []
            for part in re.split(r"\band\b", j.on, flags=re.I):
                refs = references(part)
                if len(refs) != 2 or [t for t in tokens(part) if t not in ("(", ")")][1:2] != ["="]:
                    raise PlanError(f"a join of blocks takes pairs of equal items, not {part.strip()}")
                right = next((r for r in refs if r[0] and r[0].lower() == j.block.lower()), refs[1])
                left = refs[1] if right is refs[0] else refs[0]
                out.append(((left[0].lower() if left[0] else None, slug(left[1])), slug(right[1])))
        else:
            out = [((None, slug(x)), slug(y)) for x, y in ((p, p) if isinstance(p, str) else p for p in j.on)]
        missing = [x for x, _ in out if x not in columns]
        if missing:
            raise PlanError(f"a join of blocks names {missing[0][1]}, which isn't there")
        return [(columns[x], y) for x, y in out]

    def _joined(self, df: DataFrame, dims: list[str], j: BlockJoin, columns: dict) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
        """The join, the block's dimensions by the names that they have in it, and of those the ones that equal a column there was."""
        pairs = [] if j.how == "cross" else self._pairs(dims, j, columns)
        same = {y: x for x, y in pairs if x == y}
        right, mine, new = self.frames[j.block], {}, {}
        for c in right.columns:
            if c in self.dims[j.block]:
                mine[c] = same.get(c) or (c if c not in df.columns else f"{slug(j.block)}__{c}")
            new[c] = mine.get(c, f"{slug(j.block)}__{c}")
        right = right.select(*[F.col(c).alias(f"_j_{k}") for k, c in enumerate(right.columns)])
        name = {c: f"_j_{k}" for k, c in enumerate(new)}
        if j.how not in ("left_semi", "left_anti"):
            for c, n in new.items():
                columns[j.block.lower(), c] = n
                columns.setdefault((None, c), n)
        if not pairs:
            return df.crossJoin(right).select(*df.columns, *[F.col(name[c]).alias(n) for c, n in new.items()]), mine, {}
        on = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(name[y])) for x, y in pairs])
        both = df.join(right, on, j.how)
        if j.how in ("left_semi", "left_anti"):
            return both, mine, {}
        # A key of both is that of whichever side has the row.
        keys = {x: F.coalesce(F.col(x), F.col(name[y])).alias(x) for y, x in same.items()}
        return both.select(*[keys.get(c, F.col(c)) for c in df.columns], *[F.col(name[c]).alias(n) for c, n in new.items() if c not in same]), mine, {mine[y]: x for x, y in pairs if x != y and y in mine}


def _closes(ts: list[str]) -> int:
    """The place of the parenthesis that closes the one at place 1."""
    depth = 0
    for k, t in enumerate(ts[1:], 1):
        depth += {"(": 1, ")": -1}.get(t, 0)
        if not depth:
            return k
    return len(ts)


def union(frames: list[DataFrame], every: bool = True) -> DataFrame:
    """Rows of all blocks, by column name; without ``every``, equal rows once."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if every else out.distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    b = b.select(*a.columns)
    return a.intersectAll(b) if every else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    b = b.select(*a.columns)
    return a.exceptAll(b) if every else a.subtract(b)


def sampled(df: DataFrame, share: float, seed: int = 0, strata: str | None = None, shares: dict | None = None) -> DataFrame:
    """A random sample of rows, or of each stratum the share that ``shares`` gives."""
    return df.sampleBy(strata, shares or {}, seed) if strata else df.sample(share, seed)


def load_block(df: DataFrame, target: str, kind: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    """Write a block's result: a folder of files, a table (kind table), or over JDBC."""
    writer = df.write.mode(mode).options(**options)
    if kind == "table":
        writer.saveAsTable(target)
    elif kind == "jdbc":
        writer.format("jdbc").option("dbtable", target).save()
    else:
        writer.format(kind).save(target)
