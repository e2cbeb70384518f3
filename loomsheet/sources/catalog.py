"""The catalog on disk, and its tables as DataFrames.

Layout: <root>/<project>/project.json, dimensions/*.json, measures/*.json, and
for each datasource a folder with datasource.json, tables/*.json, joins/*.json.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.functions.canonical import rewrite
from loomsheet.model import Cardinality, Catalog, Column, DataSource, Dimension, Expressible, FieldExpression, Join, JoinType, KeyType, Measure, Project, Table, TableType


def lenient(text: str):
    """JSON that may hold comments, single-quoted strings, bare names as keys and trailing commas."""
    string = r'"(?:\\.|[^"\\])*"' + "|" + r"'(?:\\.|[^'\\])*'"

    def one(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "/*")):
            return " "
        if s[0] == "'":
            return json.dumps(s[1:-1].replace("\\'", "'"))
        return s

    text = re.sub(rf"{string}|//[^\n]*|/\*.*?\*/", one, text, flags=re.S)
    text = re.sub(rf"({string})|([{{,]\s*)([A-Za-z_]\w*)(\s*:)", lambda m: m[1] or f'{m[2]}"{m[3]}"{m[4]}', text)
    text = re.sub(rf"({string})|,(\s*[}}\]])", lambda m: m[1] or m[2], text)
    return json.loads(text)


def _table_name(ref: str) -> str:
    """The table in datasource.table, datasource.schema.table or schema.table."""
    return ref.split(".")[-1]


def table_from(d: dict, source: str) -> Table:
    columns = tuple(
        Column(c["name"], c.get("dataType", "TEXT"), KeyType(c.get("keyType") or "NO_KEY_TYPE"), c.get("sql"), tuple(c["references"]) if c.get("references") else None)
        for c in d.get("columns", ())
    )
    return Table(d["name"], columns, TableType(d.get("tableType") or "DIMENSION"), d.get("physicalName"), d.get("schemaName"), int(d.get("rowCount") or 0), source)


def table_to(t: Table) -> dict:
    columns = [{"name": c.name, "dataType": c.data_type, "keyType": c.key.value, **({"sql": c.sql} if c.sql else {}), **({"references": list(c.references)} if c.references else {})} for c in t.columns]
    return {"name": t.name, "schemaName": t.schema, "physicalName": t.physical_name, "rowCount": t.row_count, "tableType": t.kind.value, "columns": columns}


def join_from(d: dict) -> Join:
    side = lambda s: _table_name(d.get(f"{s}TableName") or d[f"{s}Table"])
    return Join(side("left"), side("right"), d.get("sql") or "", Cardinality(d.get("cardinalityType") or "ONE_TO_MANY"), JoinType(d.get("joinType") or "INNER_JOIN"), int(d.get("cost") or 0), int(d.get("allowRollDown", -1)))


def join_to(j: Join) -> dict:
    return {"sql": j.sql, "leftTableName": j.left, "rightTableName": j.right, "cost": j.cost, "allowRollDown": j.allow_roll_down, "cardinalityType": j.cardinality.value, "joinType": j.kind.value}


def field_from(d: dict, kind: type[Expressible], catalog: Catalog) -> Expressible | None:
    """The field without tables that the catalog lacks; None if nothing is left of it."""
    made = kind(d["name"], (), d.get("desc"))
    for e in d.get("expressions", ()):
        names = [_table_name(t) for t in e.get("tables", ())]
        known = tuple(n for n in names if n.lower() in catalog.tables)
        if len(known) < len(names):
            catalog.warnings.append(f"{d['name']}: no table for {sorted(set(names) - set(known))}")
        if known or not names:
            made = made.with_expression(FieldExpression(e["sql"], known))
    return made if made.expressions else None


def field_to(x: Expressible, catalog: Catalog) -> dict:
    def full(t: str) -> str:
        table = catalog.table(t)
        return ".".join(p for p in (table.source, table.schema, table.name) if p)

    return {"name": x.name, "desc": x.desc, "expressions": [{"sql": e.sql, "tables": [full(t) for t in e.tables]} for e in x.expressions]}


def _read(path: Path, catalog: Catalog):
    try:
        return lenient(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        catalog.warnings.append(f"{path.name}: {e}")
        return None


def load(folder: str | Path) -> Catalog:
    """One project. A file that can't be read is noted in ``warnings`` and left out."""
    folder = Path(folder)
    catalog = Catalog(Project(folder.name))
    if d := _read(folder / "project.json", catalog):
        catalog.project = Project(d.get("name", folder.name), d.get("desc"), *(int(d.get(k, v)) for k, v in (("maxReportExecutionTime", 1800), ("maxResultRows", 100_000), ("maxTempExecutionTime", -1), ("maxTempResultRows", -1))))
    inner = [p for p in sorted(folder.iterdir()) if p.is_dir() and p.name not in ("dimensions", "measures")]
    for source in inner:
        d = _read(source / "datasource.json", catalog) if (source / "datasource.json").exists() else {}
        d = d or {}
        catalog.add(DataSource(d.get("name", source.name), d.get("kind", "parquet"), {k: str(v) for k, v in (d.get("options") or {}).items()}))
        for kind, make in (("tables", lambda x, s=source.name: table_from(x, s)), ("joins", join_from)):
            for path in sorted((source / kind).glob("*.json")):
                if (x := _read(path, catalog)) is not None:
                    try:
                        catalog.add(make(x))
                    except (KeyError, ValueError) as e:
                        catalog.warnings.append(f"{path.name}: {e}")
    for part, kind in (("dimensions", Dimension), ("measures", Measure)):
        for path in sorted((folder / part).glob("*.json")):
            if (x := _read(path, catalog)) is not None and (f := field_from(x, kind, catalog)):
                catalog.add(f)
    return catalog


def load_all(root: str | Path) -> dict[str, Catalog]:
    """Every project under a folder."""
    return {p.name: load(p) for p in sorted(Path(root).iterdir()) if (p / "project.json").exists()}


def _write(path: Path, d: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(d, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def save(catalog: Catalog, root: str | Path) -> Path:
    """Write all of a catalog; its folder is returned."""
    folder, p = Path(root) / catalog.project.name, catalog.project
    _write(folder / "project.json", {"name": p.name, "desc": p.desc, "maxReportExecutionTime": p.max_report_seconds, "maxResultRows": p.max_result_rows, "maxTempExecutionTime": p.max_temp_seconds, "maxTempResultRows": p.max_temp_rows})
    sources = list(catalog.sources.values()) or [DataSource("default")]
    for s in sources:
        _write(folder / s.name / "datasource.json", {"name": s.name, "kind": s.kind, "options": s.options})
    for t in catalog.tables.values():
        _write(folder / (t.source or sources[0].name) / "tables" / f"{t.schema + '.' if t.schema else ''}{t.name}.json", table_to(t))
    for j in catalog.joins:
        _write(folder / (catalog.table(j.left).source or sources[0].name) / "joins" / f"{j.left}_{j.right}.json", join_to(j))
    for x in catalog.fields.values():
        _write(folder / ("measures" if isinstance(x, Measure) else "dimensions") / f"{x.name.replace('/', '_')}.json", field_to(x, catalog))
    return folder


JDBC_DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "azure": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", 1433),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@{host}:{port}/{database}", 1521),
    "teradata": ("com.teradata.jdbc.TeraDriver", "jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", 1025),
    "netezza": ("org.netezza.Driver", "jdbc:netezza://{host}:{port}/{database}", 5480),
    "vertica": ("com.vertica.jdbc.Driver", "jdbc:vertica://{host}:{port}/{database}", 5433),
    "presto": ("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://{host}:{port}/{database}", 8080),
    "hive": ("org.apache.hive.jdbc.HiveDriver", "jdbc:hive2://{host}:{port}/{database}", 10000),
    "derby_remote": ("org.apache.derby.jdbc.ClientDriver", "jdbc:derby://{host}:{port}/{database}", 1527),
    "derby_local": ("org.apache.derby.jdbc.EmbeddedDriver", "jdbc:derby:{database}", 0),
    "access": ("net.ucanaccess.jdbc.UcanaccessDriver", "jdbc:ucanaccess://{database}", 0),
}


def jdbc_options(vendor: str, database: str, host: str = "localhost", port: int | None = None, user: str | None = None, password: str | None = None, url: str | None = None, **more: str) -> dict[str, str]:
    """Options for Spark's JDBC reader and writer; an explicit ``url`` wins over the vendor's template."""
    driver, template, usual = JDBC_DRIVERS[vendor.lower()]
    out = {"driver": driver, "url": url or template.format(host=host, port=port or usual, database=database), **more}
    return out | {k: v for k, v in (("user", user), ("password", password)) if v is not None}


def redacted(options: dict[str, str]) -> dict[str, str]:
    """Options that may be shown: no password, in a value or inside a URL."""
    hide = lambda v: re.sub(r"(?i)((?:password|pwd)\s*=\s*)[^;&\s]+", r"\1***", re.sub(r"(://[^:/@\s]+:)[^@/\s]+@", r"\1***@", v))
    return {k: "***" if k.lower() in ("password", "pwd") else hide(v) for k, v in options.items()}


class Reader:
    """Tables of a catalog as DataFrames. ``paths`` replaces the folders of file sources."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None = None) -> None:
        self.spark, self.catalog, self.path = spark, catalog, path

    def raw(self, table: Table) -> DataFrame:
        source = self.catalog.sources.get(table.source.lower()) or DataSource("default")
        options = dict(source.options)
        path = self.path or options.pop("path", ".")
        if source.kind == "jdbc":
            name = ".".join(p for p in (table.schema, table.physical_name) if p)
            return self.spark.read.format("jdbc").options(**options, dbtable=name).load()
        if source.kind == "table":
            return self.spark.read.table(".".join(p for p in (table.schema, table.physical_name) if p))
        ends = options.pop("suffix", f".{source.kind}")
        if source.kind == "csv":
            options = {"header": "true", "inferSchema": "true"} | options
        return self.spark.read.format(source.kind).options(**options).load(f"{path}/{table.physical_name}{ends}")

    def scan(self, name: str, computed: bool = True) -> DataFrame:
        """The table, each column named table__column, so that roles of one table stay apart."""
        table = self.catalog.table(name)
        df = self.raw(table)
        have = {c.lower(): c for c in df.columns}
        columns = [F.col(f"`{have[c.name.lower()]}`").alias(scanned(table, c.name)) for c in table.columns if not c.sql]
        out = df.select(*columns)
        for c in table.columns if computed else ():
            if c.sql:
                out = out.withColumn(scanned(table, c.name), F.expr(rewrite(c.sql, resolver(self.catalog, table.name))))
        return out


def scanned(table: Table, column: str) -> str:
    return f"{table.name}__{column}"


def resolver(catalog: Catalog, table: str | None = None, **roles: str):
    """A function from an identifier's parts to a scanned column, or None. ``roles``: further names for tables."""

    def found(parts: list[str]) -> str | None:
        column = parts[-1]
        if len(parts) > 1:
            name = roles.get(parts[-2].lower(), parts[-2])
            t = catalog.tables.get(name.lower())
        else:
            t = catalog.tables.get(table.lower()) if table else None
        c = t.column(column) if t else None
        return f"`{scanned(t, c.name)}`" if c else None

    return found
