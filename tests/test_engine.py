"""Planner decisions, reports, persistence, generation and the function vocabulary."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomsheet import queries as registered
from loomsheet.functions.canonical import infer_format, is_window, references, rewrite, spark_format, tokens, unit_of
from loomsheet.functions.dialects import CAPABILITIES, DIALECTS, dropped, limited, rewrite_for, table_from
from loomsheet.model import Cardinality, Catalog, Column, DataSource, Dimension, FieldExpression, Join, JoinType, KeyType, Measure, Project, Table, TableType
from loomsheet.operators import blocks as B
from loomsheet.operators.compiler import Compiler, pruned_window
from loomsheet.operators.query import All, Block, BlockJoin, Derived, Query, Report, slugs
from loomsheet.plans.graph import Graph
from loomsheet.plans.planner import PlanError, Planner
from loomsheet.sources import catalog as C
from loomsheet.sources import generate as G
from loomsheet.star import star


@pytest.fixture(scope="module")
def model():
    return star()


def test_every_query_matches_its_sql(spark, sf):
    """A sample of each group; all of them are compared at a larger scale by the driver."""
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["p_select", "f_tree", "f_exclude", "f_windowed", "j_three_roots", "j_blocks_full", "a_again", "a_finer_dimension", "w_pruned", "u_except_all", "m_tier", "c_dateadd", "e_array"]
    for n in names:
        df = registered.QUERIES[n](spark, sf)
        got = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
        want = db.execute(registered.ORACLE[n])
        at = sorted(range(len(want.description)), key=lambda k: want.description[k][0])
        assert sorted(df.columns) == sorted(d[0] for d in want.description), n
        assert got == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall()), n


def test_paths_run_from_one_to_many(model):
    g = Graph(model)
    assert g.reaches(model.field("Customer Region")) == {"customer_region", "customer_nation", "customer", "orders", "lineitem", "events"}
    paths = [p for p in g.base_paths(model.field("Customer Region")) if p.root == "lineitem"]
    assert [p.tables for p in paths] == [("customer_region", "customer_nation", "customer", "orders", "lineitem")]
    assert {p.start for p in g.secondary_paths(model.field("Order Status"), {"customer"})} == {"orders"}
    assert "Event Type" not in g.compatible(["Revenue"]) and "Supplier Name" in g.compatible(["Revenue"])


def test_cycles_end():
    c = Catalog(Project("x"))
    for n in "abc":
        c.add(Table(n, (Column("k", "INTEGER"),), row_count=1))
    for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
        c.add(Join(a, b, "tleft.k = tright.k", Cardinality.ONE_TO_ONE))
    c.add(Dimension("K", (FieldExpression("k", ("a",)),)))
    assert len(Graph(c).base_paths(c.field("K"))) == 5
    c.add(Join("b", "a", "tleft.k = tright.k"))
    assert len(c.joins) == 3 and c.warnings


def test_roots(model):
    p = Planner(model)
    assert [x.root for x in p.plan(["Customer Region"], ["Revenue"])] == ["lineitem"]
    assert sorted(x.root for x in p.plan(["Market Segment"], ["Revenue", "# Orders", "# Events"])) == ["events", "lineitem", "orders"]
    one = p.plan(["Return Flag"], ["Quantity", "# Orders"], grain="reference")
    assert [(x.root, sorted(x.measures)) for x in one] == [("lineitem", ["# Orders", "Quantity"])]
    assert p.plan(["Customer Nation", "Customer Region"], [])[0].root == "customer_nation"
    assert p.plan(["Market Segment"], [], hints=["events"])[0].root == "events"
    moved = p.plan(["Part Brand"], ["# Orders"])[0]
    assert moved.root == "lineitem" and "repeat" in moved.messages[0]
    lost = p.plan(["Part Brand"], ["# Events"])[0]
    assert lost.missing == ["Part Brand"]
    assert p.plan(["Part Brand"], ["# Events"], disjoint="cross")[0].crossed[0].root == "part"
    with pytest.raises(PlanError):
        p.plan(["Part Brand"], ["# Events"], disjoint="error")


def test_strict_grain_repeats_nothing(model):
    p = Planner(model)
    assert p.plan(["Customer Region"], ["# Orders"], grain="strict")[0].root == "orders"
    with pytest.raises(PlanError, match="repeat"):
        p.plan(["Part Brand"], ["# Orders"], grain="strict")
    with pytest.raises(PlanError, match="repeat"):
        p.plan(["Order Priority"], ["# Customers"], grain="strict")


def test_dense_models_have_few_paths():
    c = Catalog(Project("dense"))
    names = [f"t{k:02d}" for k in range(16)]
    for n in names:
        c.add(Table(n, (Column("k", "INTEGER"),), row_count=1))
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            c.add(Join(a, b, "tleft.k = tright.k", Cardinality.ONE_TO_ONE, cost=1))
    c.add(Dimension("K", (FieldExpression("k", ("t00",)),)))
    paths = Graph(c).base_paths(c.field("K"))
    assert len(paths) <= 8 * 16 and {p.root for p in paths} == set(names)
    assert all(min(len(p.tables) for p in paths if p.root == n) == 2 for n in names[1:])


def test_groups_are_crossed_not_rows(spark, sf, model):
    df = Compiler(spark, model, sf).compile(Query(("Part Brand", "# Events"), disjoint="cross"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Cross") :]
    assert below.count("Aggregate") == 2 and "Aggregate" not in plan[: plan.index("Join Cross")]


def test_blocks_join_on_pairs_and_nulls(spark, sf, model):
    runner = B.ReportRunner(Compiler(spark, model, sf))
    rows = lambda *v: Block("a", values=v, columns=("k", "x"), dims=("k",))
    other = Block("b", values=((1, "p", 5), (1, "q", 6), (None, "r", 7)), columns=("j", "tag", "y"), dims=("j", "tag"))
    both = lambda **o: Block("both", source="a", **o)
    run = lambda *blocks: sorted(map(tuple, runner.run(Report(blocks))["both"].collect()), key=str)
    on = (BlockJoin("b", "inner", "@[a].[k] = @[b].[j]"),)
    assert run(rows((1, 10), (None, 20), (3, 30)), other, both(joins=on, select=("[k]", "@[b].[tag]", "[x]", "@[b].[y]"))) == [(1, "p", 10, 5), (1, "q", 10, 6), (None, "r", 20, 7)]
    assert run(rows((1, 10), (None, 20)), other, both(joins=on, select=("[k]", "[x]", "@[b].[y]"))) == [(1, 10, 11), (None, 20, 7)]  # x once, y added
    assert run(rows((1, 10), (None, 20)), other, both(joins=(BlockJoin("b", "left_anti", (("k", "j"),)),))) == []
    assert run(rows((1, 10), (2, 20)), other, both(joins=(BlockJoin("b", "full", (("k", "j"),)),), select=("*",))) == [(1, 10, 1, "p", 5), (1, 10, 1, "q", 6), (2, 20, None, None, None), (None, None, None, "r", 7)]
    with pytest.raises(PlanError):
        run(rows((1, 10)), other, both(joins=(BlockJoin("b", "inner", "@[a].[k] < @[b].[j]"),)))
    mean = Block("m", query=Query(("Market Segment", "Order Status", "Average Order")))
    with pytest.raises(PlanError, match="again"):
        run(mean, Block("both", source="m", select=("[Market Segment]", "[Average Order]")))


def test_null_groups_meet(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "id int, g string").write.parquet(f"{tmp_path}/d.parquet")
    for name, rows in (("f", [(1, 5), (2, 6), (2, 7)]), ("h", [(2, 1), (1, 2)])):
        spark.createDataFrame(rows, f"{name}_id int, v int").write.parquet(f"{tmp_path}/{name}.parquet")
    c = Catalog(Project("p")).add(DataSource("s"), Table("d", (Column("id"), Column("g")), source="s"))
    for name in "fh":
        c.add(Table(name, (Column(f"{name}_id"), Column("v")), TableType.FACT, source="s"), Join("d", name, f"tleft.id = tright.{name}_id"), Measure(name.upper(), (FieldExpression("sum(v)", (name,)),)))
    c.add(Dimension("G", (FieldExpression("g", ("d",)),)))
    rows = lambda q: sorted(map(tuple, Compiler(spark, c, str(tmp_path)).compile(q).collect()), key=str)
    assert rows(Query(("G", "F", "H"))) == [("x", 5, 2), (None, 13, 1)]
    assert rows(Query(("G", "F"), where="[H] < 2")) == [(None, 13)]


def test_roll_down_needs_leave(model):
    p = Planner(model).plan(["Order Priority"], ["# Customers"], grain="safe")[0]
    assert "repeat" in " ".join(p.messages) or "duplicated" in " ".join(p.messages)
    closed = star()
    closed.joins = [Join(j.left, j.right, j.sql, j.cardinality, j.kind, j.cost, 0) for j in closed.joins]
    assert Graph(closed).secondary_paths(closed.field("Order Status"), {"customer"}) == []


def test_joins_hold_only_needed_tables(model):
    plan = Planner(model).plan(["Customer Region", "Market Segment"], ["Revenue"])[0]
    assert [t for t, _ in plan.joins()] == ["orders", "customer", "customer_nation", "customer_region"]


@pytest.mark.parametrize("dims", [("Customer Region",), ("Supplier Nation", "Part Brand"), ("Order Year", "Return Flag", "Market Segment")])
def test_no_fan_out(spark, sf, model, dims):
    got = Compiler(spark, model, sf).compile(Query((*dims, "Quantity", "# Orders"))).agg(F.sum("quantity")).first()[0]
    want = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    assert math.isclose(got, want)


def test_filters_reach_the_scan(spark, sf, model):
    df = Compiler(spark, model, sf).compile(Query(("Order Status", "# Orders"), where="[Order Status] = 'F'"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_reports(spark, sf, model):
    runner = B.ReportRunner(Compiler(spark, model, sf))
    report = Report((
        Block("o", query=Query(("Market Segment", "Order Status", "# Orders")), keep=True),
        Block("e", query=Query(("Market Segment", "# Events"))),
        Block("both", source="o", joins=(BlockJoin("e", "left"),), select=("[Market Segment]", "[# Orders]", Derived("Share", "@[o].[# Orders] / sum(@[o].[# Orders]) over ()")), order=(("[# Orders]", "desc"),)),
    ))
    out = runner.result(report).collect()
    assert len(out) == 5 and math.isclose(sum(r.share for r in out), 1.0)
    assert [r.n_orders for r in out] == sorted((r.n_orders for r in out), reverse=True)
    runner.close()
    assert runner.frames == {}
    with pytest.raises(PlanError):
        runner.run(Report((Block("o", query=Query(("Market Segment", "# Orders"))), Block("x", source="o", select=("[Nothing]",)))))


def test_row_limit(spark, sf):
    c = star()
    c.project = Project("small", max_result_rows=2)
    assert B.ReportRunner(Compiler(spark, c, sf)).result(Report((Block("d", query=Query(("Customer Nation",))),))).count() == 2


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 1, 2, 3], [1, 3, 3]))
    rows = lambda df: sorted(r.k for r in df.collect())
    assert rows(B.union([a, b])) == [1, 1, 1, 2, 3, 3, 3] and rows(B.union([a, b], every=False)) == [1, 2, 3]
    assert rows(B.intersect(a, b, every=True)) == [1, 3] and rows(B.subtract(a, b)) == [2]
    assert rows(B.subtract(a, b, every=True)) == [1, 2]
    assert B.sampled(spark.range(1000), 0.5, 1).count() not in (0, 1000)
    assert B.sampled(spark.range(100).withColumn("s", F.col("id") % 2), 0, 1, "s", {0: 1.0}).count() == 50


def test_loading_blocks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for kind in ("parquet", "csv", "json", "orc"):
        B.load_block(df, str(tmp_path / f"t.{kind}"), kind, **({"header": "true"} if kind == "csv" else {}))
        c = Catalog(Project("p")).add(DataSource("s", kind), Table("t", (Column("k"), Column("v"), Column("w", sql="v || '!'")), source="s"))
        assert [tuple(map(str, r)) for r in C.Reader(spark, c, str(tmp_path)).scan("t").collect()] == [("1", "a", "a!")]


def test_models_are_saved_and_loaded(model, tmp_path):
    folder = C.save(model, tmp_path)
    again = C.load_all(tmp_path)["star"]
    assert again.warnings == []
    assert again.tables == model.tables and {j.pair for j in again.joins} == {j.pair for j in model.joins}
    assert again.fields == model.fields
    (folder / "measures" / "broken.json").write_text("{nope")
    (folder / "measures" / "Odd.json").write_text("{'name': 'Odd', /* why */ expressions: [{sql: 'sum(x)', tables: ['files.lineitem', 'files.gone'],}]}")
    (folder / "files" / "joins" / "more.json").write_text(json.dumps({"leftTable": "s.part", "rightTable": "s.events", "sql": "a"}))
    again = C.load(folder)
    assert len(again.warnings) == 2
    assert again.field("odd").expressions[0].tables == ("lineitem",)
    assert frozenset(("part", "events")) in {j.pair for j in again.joins}


def test_lenient_json():
    assert C.lenient("{a: 'it\\'s', // no\n \"b\": [1, 2,], /* x */ c: {'d': \"//e\"}}") == {"a": "it's", "b": [1, 2], "c": {"d": "//e"}}


def test_jdbc_options_show_no_password():
    o = C.jdbc_options("postgresql", "shop", "db", user="u", password="s3")
    assert o["url"] == "jdbc:postgresql://db:5432/shop" and C.redacted(o)["password"] == "***"
    assert "s3" not in str(C.redacted({"url": "jdbc:x://u:s3@h/d?password=s3"}))


def test_functions():
    assert rewrite("a / b / 2") == "a / nullif(b, 0) / 2" and rewrite("a / 0") == "a / nullif(0, 0)"
    assert rewrite("- - x") == "- -x" and rewrite("a / 0e0") == "a / nullif(0e0, 0)" and rewrite("a % b") == "a % nullif(b, 0)" and rewrite("log(2, 8)") == "log(2, 8)"
    assert rewrite("log(x) + ln(y)") == "log10(x) + ln(y)" and rewrite("atan2(x, y)") == "atan2(y, x)"
    assert rewrite("'a/b' || left_trim(s)") == "'a/b' || ltrim(s)"
    assert rewrite("count()") == "count(*)" and rewrite("count(distinct a)") == "count(DISTINCT a)"
    assert rewrite("d = last(2, week)", as_of="2020-01-01") == "(d BETWEEN DATE'2020-01-01' - INTERVAL 2 WEEK AND DATE'2020-01-01')"
    assert unit_of("qq") == "QUARTER" and unit_of("nonsense") == "DAY" and unit_of(None) == "DAY"
    assert spark_format("dd MON yyyy hh24:mi:ss.ff3") == "dd MMM yyyy HH:mm:ss.SSS"
    assert infer_format("3 March 2020") == "d MMMM yyyy" and infer_format("soon") is None
    assert references("@[a].[b] + [c] + @d.e + @[this].[f]") == [("a", "b"), (None, "c"), ("d", "e"), (None, "f")]
    assert is_window("sum(x) over ()") and not is_window("sum(over_x)")
    assert tokens("a<>b||'c''d'") == ["a", "<>", "b", "||", "'c''d'"]
    assert pruned_window("sum(x) over (partition by [a], [b] order by [c] rows 1 preceding)", {"a"}) == "sum(x) OVER (PARTITION BY [a])"
    for bad in ("f(", "(a", "a)", "tier(x)", "PASS(a, b)", "d('soon')"):
        with pytest.raises(ValueError):
            rewrite(bad)


def test_closed_forms(spark):
    row = spark.range(1).select(*[F.expr(rewrite(s)).alias(n) for n, s in {"a": "sinh(1e0)", "b": "atanh(0.5e0)", "c": "atan2(3e0, 4e0)", "d": "1 / (1 - 1)", "e": "zeroifnull(nullifzero(0))", "f": "tier(null, 1, 2)", "g": "position('abc', 'z')", "h": "if(1 > 2, 1)", "i": "datediff(DATE'2020-01-31', DATE'2020-02-01', month)"}.items()]).first()
    assert math.isclose(row.a, math.sinh(1)) and math.isclose(row.b, math.atanh(0.5)) and math.isclose(row.c, math.atan2(4, 3))
    assert (row.d, row.e, row.f, row.g, row.h, row.i) == (None, 0, "Unknown", 0, None, 0)


def test_dialects():
    for d in DIALECTS:
        assert rewrite_for(d, "sum(a) / b")
        assert d in CAPABILITIES
    assert rewrite_for("mysql", "a % b") == "mod(a, b)" and rewrite_for("oracle", "log(x)") == "log(10, x)"
    assert rewrite_for("mssql", "length(s)") == "len(s)" and rewrite_for("presto", "dateadd(d, 1, mm)") == "date_add('month', 1, d)"


def test_dialect_dates():
    month = lambda d: rewrite_for(d, "datediff(a, b, month)")
    assert month("oracle") == "trunc(months_between(b, a))" and month("hive") == "cast(months_between(b, a) as int)"
    for d in DIALECTS:
        for unit, days in (("month", 30), ("quarter", 90), ("year", 365)):
            text = rewrite_for(d, f"datediff(a, b, {unit})")
            assert "86400" not in text and text != rewrite_for(d, "datediff(a, b)"), (d, unit)
        for text in (rewrite_for(d, "d('2020-01-02')"), rewrite_for(d, "d('3 March 2020')"), rewrite_for(d, "x = last(2)", as_of="2020-01-05")):
            assert "yyyy" not in text or d in ("hive", "drill") or "YYYY" in text, (d, text)
    assert rewrite_for("postgresql", "d('2020-01-02')") == "DATE '2020-01-02'" and rewrite_for("oracle", "d('03/04/2020')") == "to_date('03/04/2020', 'FMMM/FMDD/YYYY')"
    assert rewrite_for("mysql", "d('03 Feb 2020')") == "str_to_date('03 Feb 2020', '%e %b %Y')"
    assert rewrite_for("postgresql", "x = last(2)", as_of="2020-01-05") == "(x BETWEEN (DATE '2020-01-05' - (2) * INTERVAL '1' DAY) AND DATE '2020-01-05')".replace("- (2)", "+ (-(2))")
    db = duckdb.connect()  # which reads the generic forms
    for a, b in (("2020-01-31", "2020-02-29"), ("2020-01-15", "2021-03-14"), ("2020-01-15", "2021-04-15"), ("2020-05-01", "2020-05-01")):
        for unit, n in (("month", 1), ("quarter", 3), ("year", 12)):
            sql = rewrite_for("netezza", f"datediff(x, y, {unit})")
            got = db.execute(f"SELECT CAST(floor({sql.replace('cast(', 'trunc(').replace(' as integer)', ')')}) AS INT) FROM (SELECT TIMESTAMP '{a}' AS x, TIMESTAMP '{b}' AS y)").fetchone()[0]
            assert got == db.execute(f"SELECT datesub('month', TIMESTAMP '{a}', TIMESTAMP '{b}') // {n}").fetchone()[0], (a, b, unit)


def test_dialect_statements():
    assert limited("mssql", "select distinct a from t", 5) == "select distinct TOP 5 a from t" and limited("mysql", "SELECT 1", 2) == "SELECT 1 LIMIT 2"
    assert limited("oracle", "SELECT a FROM t ORDER BY a", 3) == "SELECT * FROM (SELECT a FROM t ORDER BY a) WHERE ROWNUM <= 3" and "FETCH FIRST 1" in limited("derby", "SELECT 1", 1)
    assert table_from("azure", "x", "SELECT 1 AS a") == "SELECT * INTO #x FROM (SELECT 1 AS a) AS kept" and "VOLATILE" in table_from("teradata", "x", "SELECT 1")
    assert table_from("postgresql", "x", "SELECT 1") == "CREATE TEMPORARY TABLE x AS SELECT 1" and table_from("presto", "x", "SELECT 1") == "CREATE TABLE x AS SELECT 1"
    assert dropped("netezza", "x") == "DROP TABLE x IF EXISTS" and dropped("oracle", "x") == "DROP TABLE x"
    db = duckdb.connect()
    db.execute(table_from("postgresql", "kept", limited("postgresql", "SELECT * FROM range(9)", 4)))
    assert db.execute("SELECT count(*) FROM kept").fetchone()[0] == 4
    db.execute(dropped("postgresql", "kept"))


def test_names():
    assert G.field_name("id", "orders") == "Order Id" and G.field_name("id", "categories") == "Category Id"
    assert G.field_name("orderDate", "x") == "Order Date" and G.field_name("HTTPCode", "x") == "HTTP Code" and G.field_name("shelf_no", "shelves") == "Shelf No"
    assert G.is_id("OrderID") is False or G.is_id("order_id")
    assert G.is_id("paid") is False and G.is_id("paid", whole_word=False)
    assert slugs(["# Orders", "N Orders", "Größe", "x" * 9], 5) == {"# Orders": "n_ord", "N Orders": "n_or2", "Größe": "groe", "x" * 9: "xxxxx"}


def test_table_types():
    def kind(*keys):
        return G.table_type([Column(str(k), key=x) for k, x in enumerate(keys)])

    P, FK, N = KeyType.PRIMARY, KeyType.FOREIGN, KeyType.NONE
    assert kind(P, N) is TableType.DIMENSION and kind(FK, FK) is TableType.BRIDGE and kind(P, FK) is TableType.BRIDGE
    assert kind(P, FK, N) is TableType.FACT and kind(N, N) is TableType.FACT and kind(P, P, N) is TableType.DIMENSION


def test_models_are_generated(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders", "nation")}
    c = G.generate("shop", frames, {"customer": ("c_custkey",), "orders": ("o_orderkey",), "nation": ("n_nationkey",)}, {"orders": {"o_custkey": ("customer", "c_custkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}})
    assert c.table("orders").kind is TableType.FACT and c.table("nation").kind is TableType.DIMENSION
    assert {tuple(sorted(j.pair)) for j in c.joins} == {("customer", "orders"), ("customer", "nation")}
    c.add(DataSource("shop", "parquet"))
    total = Compiler(spark, c, sf).compile(Query(("C Mktsegment", "O Totalprice")))
    assert total.count() == 5
    again = G.generate("shop", frames, into=c, measures=False, dimensions=False)
    assert len(again.joins) == 2
    none = G.generate("n", frames, measures=False)
    assert none.measures() == [] and none.dimensions()


def test_joins_are_detected(spark):
    a = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "cust_id int, name string")
    b = spark.createDataFrame([(k, k % 5, 1.0) for k in range(20)], "num int, customer_ref int, amount double")
    left, right = G.import_table("a", a, ("cust_id",)), G.import_table("b", b)
    j = G.detect_join(left, right, a, b)
    assert "tleft.cust_id = tright." in j.sql
    same = spark.createDataFrame([(k % 5, 2.0) for k in range(20)], "cust_id int, amount double")
    j = G.detect_join(left, G.import_table("c", same), a, same)
    assert j.sql == "tleft.cust_id = tright.cust_id" and j.cardinality is Cardinality.ONE_TO_MANY
    assert G.cardinality(a, a, ["cust_id"], ["cust_id"]) is Cardinality.ONE_TO_ONE
    assert G.cardinality(same, same, ["cust_id"], ["cust_id"]) is Cardinality.MANY_TO_MANY
    assert G.cardinality(a, same.limit(0), ["cust_id"], ["cust_id"]) is Cardinality.ONE_TO_MANY


def test_catalog_listing(spark):
    assert G.test_connection(spark) and G.default_schema(spark) in G.list_schemas(spark)
    spark.range(1).createOrReplaceTempView("seen_table")
    assert "seen_table" in G.list_tables(spark, pattern="seen.*")
    spark.catalog.dropTempView("seen_table")


def test_outer_join_written_either_way():
    assert JoinType.LEFT.flipped() is JoinType.RIGHT and JoinType.INNER.flipped() is JoinType.INNER


def test_measure_filter_of_another_root(spark, sf, model):
    df = Compiler(spark, model, sf).compile(Query(("Market Segment", "# Events"), where=All("[# Orders] > 1000000")))
    assert df.count() == 0


def test_virtual_measures_expand(model):
    formula, bases = Planner(model).expand("Order Index")
    assert set(bases) == {"Order Total", "# Orders", "Largest Order"} and formula.count("[") == 3
    bad = star().add(Measure("Loop", (FieldExpression("@[Loop] + 1", ()),)))
    with pytest.raises(PlanError):
        Planner(bad).expand("Loop")
