"""A model from tables: keys, table types, joins, dimensions and measures.

Schemas come from Spark (files, the catalog, JDBC). Keys and foreign keys are
declared, or found in the data: a join is detected by similar names first, then
by values of a key that occur on the other side.
"""

from __future__ import annotations

import difflib
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.model import Cardinality, Catalog, Column, DataSource, Dimension, Expressible, FieldExpression, Join, KeyType, Measure, Project, Table, TableType

_TYPES = {
    "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "BIGINT", "string": "TEXT", "varchar": "TEXT", "char": "TEXT", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "DECIMAL", "double": "DECIMAL", "decimal": "DECIMAL", "boolean": "BOOLEAN",
}


def data_type(spark_type: str) -> str:
    """The model's type for Spark's; UNSUPPORTED for binary and nested ones."""
    return _TYPES.get(re.match(r"\w+", spark_type)[0], "UNSUPPORTED")


def list_schemas(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def default_schema(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()


def list_tables(spark: SparkSession, schema: str | None = None, pattern: str = ".*") -> list[str]:
    """Tables of a schema whose name matches a regular expression."""
    return [t.name for t in spark.catalog.listTables(schema) if re.fullmatch(pattern, t.name)]


def test_connection(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 + 1").first()[0] == 2


def sample_file(spark: SparkSession, path: str, rows: int = 100, **options: str) -> DataFrame:
    """The first rows of a delimited file, with types inferred."""
    return spark.read.options(**({"header": "true", "inferSchema": "true"} | options)).csv(path).limit(rows)


def test_source(spark: SparkSession, source: DataSource) -> bool:
    """Whether a datasource answers: a database runs a query, a catalog lists its tables, a folder of files is there."""
    options = dict(source.options)
    try:
        if source.kind == "jdbc":
            return spark.read.format("jdbc").options(**options, query=options.pop("test_query", "SELECT 1 AS one")).load().count() == 1
        if source.kind == "table":
            spark.catalog.listTables(options.get("schema"))
            return True
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(options.get("path", "."))
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    except Exception:  # noqa: BLE001 - whatever a driver raises, the source doesn't answer
        return False


def sniffed(spark: SparkSession, path: str, lines: int = 50) -> dict[str, str]:
    """The delimiter and whether there is a header, from a file's first lines. Compressed files are read as well."""
    rows = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value.strip()]
    plain = [re.sub(r'"[^"]*"', "", r) for r in rows]

    def fit(d: str) -> tuple[int, int]:
        counts = [r.count(d) for r in plain]
        return (min(counts, default=0) > 0 and len(set(counts)) == 1, min(counts, default=0))

    best = max(",;\t|", key=fit)
    head = [x.strip('" ') for x in rows[0].split(best)] if rows else []
    named = bool(head) and all(x and not re.fullmatch(r"[-+]?[\d.,:/ -]+", x) for x in head) and len(set(head)) == len(head)
    return {"sep": best, "header": str(named).lower()}


def file_rows(spark: SparkSession, path: str, **options: str) -> int:
    """Rows of a delimited file, counted by all executors."""
    return spark.read.options(**({"header": "true"} | options)).csv(path).count()


#: Tables that are imported at the same time.
IMPORTED_AT_ONCE = 8


def table_type(columns) -> TableType:
    """From the keys: one primary and no foreign key, or something mixed: a dimension; only foreign keys: a bridge; foreign keys and values, or no keys: a fact."""
    primary = sum(c.key is KeyType.PRIMARY for c in columns)
    foreign = sum(c.key is KeyType.FOREIGN for c in columns)
    plain = sum(c.key is KeyType.NONE for c in columns)
    if primary == 1 and not foreign:
        return TableType.DIMENSION
    if foreign and (foreign == len(columns) or not plain):
        return TableType.BRIDGE
    if foreign and plain or not primary and not foreign:
        return TableType.FACT
    return TableType.DIMENSION


def import_table(name: str, df: DataFrame, primary: tuple[str, ...] = (), foreign: dict[str, tuple[str, str]] | None = None, source: str = "", schema: str | None = None, count: bool = True) -> Table:
    """A table of the model from a DataFrame. A column that is both kinds of key counts as primary."""
    foreign = foreign or {}
    key = lambda c: KeyType.PRIMARY if c in primary else KeyType.FOREIGN if c in foreign else KeyType.NONE
    columns = tuple(Column(c, data_type(t), key(c), None, foreign.get(c)) for c, t in df.dtypes)
    return Table(name, columns, table_type(columns), name, schema, df.count() if count else 0, source)


def refreshed(old: Table, new: Table) -> Table:
    """The new table, with the old one's computed columns."""
    have = {c.name.lower() for c in new.columns}
    return Table(new.name, new.columns + tuple(c for c in old.columns if c.sql and c.name.lower() not in have), new.kind, new.physical, new.schema, new.row_count, new.source)


def declared_joins(tables: list[Table]) -> list[Join]:
    """A join, one to many, for each table that foreign keys point to; references to the table itself are left out."""
    out = []
    for t in tables:
        by: dict[str, list[str]] = {}
        for c in t.columns:
            if c.references and c.references[0].lower() != t.name.lower():
                by.setdefault(c.references[0], []).append(f"{c.references[0]}.{c.references[1]} = {t.name}.{c.name}")
        out += [Join(parent, t.name, " and ".join(on)) for parent, on in by.items()]
    return out


def similarity(a: str, b: str) -> int:
    """How alike two names are, of 100."""
    return round(100 * difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio())


def detect_join(left: Table, right: Table, left_df: DataFrame, right_df: DataFrame, samples: int = 11) -> Join | None:
    """A join of two tables.

    In turn: all pairs of columns whose names are over 80 alike; a primary key
    of which sampled values occur in a column of the other table; the best
    pair of names at 50 or more; the pair of columns of which over a tenth of
    the sampled values are shared. Only columns of one type are compared.
    """
    pairs = [(a, b) for a in left.columns for b in right.columns if a.data_type == b.data_type and a.data_type != "UNSUPPORTED"]
    rated = sorted(((similarity(a.name, b.name), a.name, b.name) for a, b in pairs), reverse=True)
    close = [(a, b) for s, a, b in rated if s > 80]
    if not close:
        close = _by_key(left, right, left_df, right_df, pairs, samples)
    if not close and rated and rated[0][0] >= 50:
        close = [rated[0][1:]]
    if not close:
        close = _by_overlap(left_df, right_df, pairs, samples)
    if not close:
        return None
    sql = " AND ".join(f"tleft.{a} = tright.{b}" for a, b in close)
    return Join(left.name, right.name, sql, cardinality(left_df, right_df, [a for a, _ in close], [b for _, b in close]))


#: Rows from which sampled values are taken.
SAMPLED_ROWS = 10_000


def _samples(df: DataFrame, columns: list[str], n: int) -> dict[str, list]:
    """Up to ``n`` different values of each column, of the first rows: one small job."""
    rows = df.select(*[F.col(f"`{c}`") for c in columns]).limit(SAMPLED_ROWS).collect()
    return {c: list(dict.fromkeys(r[k] for r in rows if r[k] is not None))[:n] for k, c in enumerate(columns)}


def _found(samples: dict[str, list], df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """For each pair, how many of the sampled values of the first occur in the second column: one scan of the needed columns."""
    pairs = [p for p in pairs if samples[p[0]]]
    if not pairs:
        return {}
    seen = [F.count_distinct(F.when(F.col(f"`{b}`").isin(samples[a]), F.col(f"`{b}`"))) for a, b in pairs]
    return dict(zip(pairs, df.agg(*seen).first(), strict=True))


def _by_key(left: Table, right: Table, left_df, right_df, pairs, n: int) -> list[tuple[str, str]]:
    """The first pair of which one column is a primary key with values in the other."""
    ours = [(a.name, b.name) for a, b in pairs if a.key is KeyType.PRIMARY]
    theirs = [(b.name, a.name) for a, b in pairs if b.key is KeyType.PRIMARY]
    hits = _found(_samples(left_df, sorted({a for a, _ in ours}), n), right_df, ours) if ours else {}
    back = _found(_samples(right_df, sorted({b for b, _ in theirs}), n), left_df, theirs) if theirs else {}
    return next(([(a.name, b.name)] for a, b in pairs if hits.get((a.name, b.name)) or back.get((b.name, a.name))), [])


def _by_overlap(left_df, right_df, pairs, n: int) -> list[tuple[str, str]]:
    samples = _samples(left_df, sorted({a.name for a, _ in pairs}), 10 * n) if pairs else {}
    hits = _found(samples, right_df, [(a.name, b.name) for a, b in pairs])
    best = (0.1, None)
    for (a, b), found in hits.items():
        if found / len(samples[a]) > best[0]:
            best = (found / len(samples[a]), (a, b))
    return [best[1]] if best[1] else []


def cardinality(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> Cardinality:
    """From whether a key occurs more than once on each side; an empty side gives one to many."""

    def most(df: DataFrame, keys: list[str]) -> int | None:
        return df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().agg(F.max("count")).first()[0]

    a, b = most(left, left_keys), most(right, right_keys)
    if a is None or b is None:
        return Cardinality.ONE_TO_MANY
    return {(True, True): Cardinality.ONE_TO_ONE, (True, False): Cardinality.ONE_TO_MANY, (False, True): Cardinality.MANY_TO_ONE, (False, False): Cardinality.MANY_TO_MANY}[a == 1, b == 1]


def field_name(column: str, table: str, singular: bool = True) -> str:
    """A title for a column: order_date and orderDate become Order Date; a bare id takes its table's name."""
    column, table = (re.sub(r"[\"`\[\]]", "", x) for x in (column, table))
    if singular:
        table = re.sub(r"ves$", "f", table) if table.endswith("ves") else re.sub(r"ies$", "y", table) if table.endswith("ies") else re.sub(r"(?<!s)s$", "", table)
    if column.lower() == "id":
        column = f"{table}_{column}"
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9]+$)", " ", column).replace("_", " ").split()
    return " ".join(w[:1].upper() + w[1:] for w in words)


def is_id(column: str, whole_word: bool = True) -> bool:
    """Whether a column's name marks an identifier: id or key as a word of its own, or with ``whole_word`` off the letters id anywhere."""
    if not whole_word:
        return "id" in column.lower()
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", column).replace("_", " ").lower().split()
    return any(w in ("id", "key") or w.endswith("key") for w in words)


def _put(catalog: Catalog, made: Expressible) -> None:
    """Fields of one name share it, with an expression for each table."""
    old = catalog.fields.get(made.name.lower())
    if old is not None and type(old) is type(made):
        for e in made.expressions:
            old = old.with_expression(e)
        made = old
    catalog.add(made)


def generate_dimensions(catalog: Catalog, tables: list[Table]) -> None:
    """A dimension for each column, except numbers that aren't identifiers."""
    for t in tables:
        for c in t.columns:
            number = c.data_type == "DECIMAL" or c.data_type in ("INTEGER", "BIGINT") and not is_id(c.name)
            if c.data_type != "UNSUPPORTED" and not number:
                _put(catalog, Dimension(field_name(c.name, t.name), (FieldExpression(c.name, (t.name,)),)))


def generate_measures(catalog: Catalog, tables: list[Table]) -> None:
    """A sum for each number, and a count, its name led by #, for each identifier."""
    for t in tables:
        for c in t.columns:
            if c.data_type in ("INTEGER", "BIGINT", "DECIMAL"):
                name, sql = field_name(c.name, t.name), f"sum({c.name})"
                if is_id(c.name):
                    name, sql = f"# {name}", f"count({c.name})"
                elif name.lower() in catalog.fields and isinstance(catalog.fields[name.lower()], Dimension):
                    name = f"Total {name}"
                _put(catalog, Measure(name, (FieldExpression(sql, (t.name,)),)))


def generate(name: str, frames: dict[str, DataFrame], primary: dict[str, tuple[str, ...]] | None = None, foreign: dict[str, dict[str, tuple[str, str]]] | None = None, joins: bool = True, dimensions: bool = True, measures: bool = True, detect: bool = False, into: Catalog | None = None) -> Catalog:
    """A catalog for tables. Into an existing one, tables are refreshed and fields merged. ``detect`` seeks joins that no key declares."""
    catalog = into or Catalog(Project(name)).add(DataSource(name))
    made = []
    with ThreadPoolExecutor(IMPORTED_AT_ONCE) as pool:  # a job a table counts its rows
        tables = pool.map(lambda t: import_table(t, frames[t], (primary or {}).get(t, ()), (foreign or {}).get(t), name), frames)
        tables = list(tables)
    for t, new in zip(frames, tables, strict=True):
        old = catalog.tables.get(t.lower())
        made.append(refreshed(old, new) if old else new)
    catalog.add(*made)
    if joins:
        have = {j.pair for j in catalog.joins}
        for j in declared_joins(made):
            if j.pair not in have:
                catalog.add(j)
                have.add(j.pair)
        if detect:
            for k, a in enumerate(made):
                for b in made[k + 1 :]:
                    if frozenset((a.name, b.name)) not in have and (j := detect_join(a, b, frames[a.name], frames[b.name])):
                        catalog.add(j)
    if dimensions:
        generate_dimensions(catalog, made)
    if measures:
        generate_measures(catalog, made)
    return catalog
