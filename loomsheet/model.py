"""The semantic model: tables, joins, dimensions and measures, as frozen dataclasses."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field


class TableType(enum.Enum):
    DIMENSION = "DIMENSION"
    FACT = "FACT"
    BRIDGE = "BRIDGE"


class KeyType(enum.Enum):
    NONE = "NO_KEY_TYPE"
    PRIMARY = "PRIMARY_KEY"
    FOREIGN = "FOREIGN_KEY"


class Cardinality(enum.Enum):
    ONE_TO_MANY = "ONE_TO_MANY"
    ONE_TO_ONE = "ONE_TO_ONE"
    MANY_TO_ONE = "MANY_TO_ONE"
    MANY_TO_MANY = "MANY_TO_MANY"


class JoinType(enum.Enum):
    INNER = "INNER_JOIN"
    LEFT = "LEFT_OUTER_JOIN"
    RIGHT = "RIGHT_OUTER_JOIN"
    FULL = "FULL_OUTER_JOIN"
    CROSS = "CROSS_JOIN"

    @property
    def how(self) -> str:
        """Spark's name for the join."""
        return {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}[self.name]

    def flipped(self) -> JoinType:
        """The same join written with its sides exchanged."""
        return {JoinType.LEFT: JoinType.RIGHT, JoinType.RIGHT: JoinType.LEFT}.get(self, self)


@dataclass(frozen=True)
class Project:
    """Limits of zero or less mean none."""

    name: str
    desc: str | None = None
    max_report_seconds: int = 1800
    max_result_rows: int = 100_000
    max_temp_seconds: int = -1
    max_temp_rows: int = -1


@dataclass(frozen=True)
class DataSource:
    """``kind``: parquet, csv, json, orc, table or jdbc. ``options`` holds the path, or what the reader takes."""

    name: str
    kind: str = "parquet"
    options: dict[str, str] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Column:
    """A computed column has ``sql``, over the other columns of its table."""

    name: str
    data_type: str = "TEXT"
    key: KeyType = KeyType.NONE
    sql: str | None = None
    references: tuple[str, str] | None = None  # the table and column that a foreign key points to


@dataclass(frozen=True)
class Table:
    """Two tables may share a physical name: each is then a role of it."""

    name: str
    columns: tuple[Column, ...]
    kind: TableType = TableType.DIMENSION
    physical: str | None = None
    schema: str | None = None
    row_count: int = 0
    source: str = ""

    @property
    def physical_name(self) -> str:
        return self.physical or self.name

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Join:
    """``sql`` names columns as table.column, or as tleft.column and tright.column."""

    left: str
    right: str
    sql: str
    cardinality: Cardinality = Cardinality.ONE_TO_MANY
    kind: JoinType = JoinType.INNER
    cost: int = 0
    allow_roll_down: int = -1  # -1: not set, 0: no, 1: yes

    @property
    def pair(self) -> frozenset[str]:
        return frozenset((self.left, self.right))


@dataclass(frozen=True)
class FieldExpression:
    """``sql`` and the tables it is valid on."""

    sql: str
    tables: tuple[str, ...]


@dataclass(frozen=True)
class Expressible:
    name: str
    expressions: tuple[FieldExpression, ...]
    desc: str | None = None

    def on(self, table: str) -> FieldExpression | None:
        """The expression that is valid on a table."""
        return next((e for e in self.expressions if table in e.tables), None)

    def with_expression(self, e: FieldExpression):
        """With one more expression; equal SQL unites its tables."""
        same = [x for x in self.expressions if x.sql == e.sql]
        if not same:
            return type(self)(self.name, (*self.expressions, e), self.desc)
        tables = tuple(dict.fromkeys((*same[0].tables, *e.tables)))
        return type(self)(self.name, tuple(FieldExpression(x.sql, tables) if x.sql == e.sql else x for x in self.expressions), self.desc)


@dataclass(frozen=True)
class Dimension(Expressible):
    pass


@dataclass(frozen=True)
class Measure(Expressible):
    """A virtual measure has no tables: its SQL refers to other measures as @[Name]."""

    @property
    def virtual(self) -> bool:
        return any("@[" in e.sql for e in self.expressions)


@dataclass
class Catalog:
    """All of a project; names are looked up without regard to case."""

    project: Project
    sources: dict[str, DataSource] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    joins: list[Join] = field(default_factory=list)
    fields: dict[str, Expressible] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def add(self, *items) -> Catalog:
        for x in items:
            if isinstance(x, DataSource):
                self.sources[x.name.lower()] = x
            elif isinstance(x, Table):
                self.tables[x.name.lower()] = x
            elif isinstance(x, Expressible):
                self.fields[x.name.lower()] = x
            elif isinstance(x, Join):
                if any(j.pair == x.pair for j in self.joins):
                    self.warnings.append(f"a join of {x.left} and {x.right} exists already; one more is ignored")
                else:
                    self.joins.append(x)
            else:
                raise TypeError(f"{x!r} has no place in a catalog")
        return self

    def table(self, name: str) -> Table:
        return self._get(self.tables, name, "table")

    def field(self, name: str) -> Expressible:
        return self._get(self.fields, name, "dimension or measure")

    @staticmethod
    def _get(of: dict, name: str, what: str):
        try:
            return of[name.lower()]
        except KeyError:
            raise KeyError(f"no {what} named {name!r}") from None

    def dimensions(self) -> list[Dimension]:
        return [x for x in self.fields.values() if isinstance(x, Dimension)]

    def measures(self) -> list[Measure]:
        return [x for x in self.fields.values() if isinstance(x, Measure)]

    def join_cost(self, j: Join) -> int:
        if j.cost > 0:
            return j.cost
        rows = [self.table(t).row_count for t in (j.left, j.right)]
        return sum(rows) if j.cardinality is Cardinality.MANY_TO_MANY else max(rows)
