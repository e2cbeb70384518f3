"""The registered queries of the semantic engine, and for each the SQL that gives the same rows.

Names start with the group of the operator: p projection, f filter, j join, a
aggregation, w window, o order, u set operation, m mathematics, t text, c
calendar, e conditional, g join graph, s sources and models, d statements.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from loomsheet.model import Cardinality, Catalog, DataSource, Dimension, FieldExpression, Join, JoinType, Measure, Project, Table, TableType
from loomsheet.operators import blocks as B
from loomsheet.operators import statements as S
from loomsheet.operators.compiler import Compiler
from loomsheet.operators.query import All, Any, Block, BlockJoin, Constant, Derived, Not, Query, Report, SetFilter
from loomsheet.plans.graph import Graph
from loomsheet.sources import catalog as C
from loomsheet.sources import generate as G
from loomsheet.star import star

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "1998-06-15"


def _compiler(spark, sf_dir) -> Compiler:
    return Compiler(spark, star(), sf_dir)


def _add(name: str, sql: str | None, run) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _query(name: str, sql: str, select: tuple, digits: dict[str, int] | None = None, **options) -> None:
    """``digits``: columns to round, as sums of doubles depend on their order."""

    def run(spark, sf_dir):
        df = _compiler(spark, sf_dir).compile(Query(select, **options))
        return _rounded(df, digits)

    _add(name, sql, run)


def _rounded(df, digits: dict[str, int] | None):
    for c, n in (digits or {}).items():
        df = df.withColumn(c, F.round(F.col(c), n) + F.lit(0.0))
    return df


def _table(name: str, sql: str, table: str, items: dict[str, str], where: str | None = None, as_of: str | None = None, digits: dict[str, int] | None = None) -> None:
    _add(name, sql, lambda spark, sf_dir: _rounded(_compiler(spark, sf_dir).select(table, items, where, as_of), digits))


def _report(name: str, sql: str, blocks, digits: dict[str, int] | None = None) -> None:
    def run(spark, sf_dir):
        made = blocks(spark) if callable(blocks) else blocks
        runner = B.ReportRunner(_compiler(spark, sf_dir))
        return _rounded(runner.run(Report(made))[made[-1].name], digits)

    _add(name, sql, run)


def flagship(spark, sf_dir):
    """Revenue by customer region and order year."""
    return QUERIES["p_select"](spark, sf_dir)


# Common pieces of SQL. Sums are rounded like the engine's.
REV = "round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0"
_LINES = "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"

# Projections.
_query("p_select", f"SELECT r_name AS customer_region, CAST(year(o_orderdate) AS INT) AS order_year, {REV} AS revenue FROM {_LINES} GROUP BY 1, 2", ("Customer Region", "Order Year", "Revenue"), {"revenue": 2})
_table("p_scan", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation", "customer_nation", {"key": "n_nationkey", "name": "n_name", "region": "n_regionkey"})
_table("p_computed_column", "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) + 0.0 AS net FROM lineitem", "lineitem", {"k": "l_orderkey", "net": "net_price"}, digits={"net": 4})
_query("p_constant", "SELECT r_name AS customer_region, 'fixed' AS label, 7 AS seven FROM region", ("Customer Region", Constant("Label", "fixed"), Constant("Seven", 7)))
_query("p_constant_only", "SELECT 'x' AS label, 3 AS three", (Constant("Label", "x"), Constant("Three", 3)))
_query("p_block_ref", "SELECT c_mktsegment AS market_segment, count(o_orderkey) AS n_orders, count(o_orderkey) * 2 AS twice FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", ("Market Segment", "# Orders", Derived("Twice", "@[this].[# Orders] * 2")))
_query("p_derived_dimension", f"SELECT upper(c_mktsegment) || '-' || o_orderstatus AS tag, {REV} AS revenue FROM {_LINES} GROUP BY 1", (Derived("Tag", "upper([Market Segment]) || '-' || [Order Status]"), "Revenue"), {"revenue": 2})
_query("p_derived_measure", f"SELECT r_name AS customer_region, {REV} AS revenue, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) + 0.0 AS unit_price FROM {_LINES} GROUP BY 1", ("Customer Region", "Revenue", Derived("Unit Price", "[Revenue] / [Quantity]")), {"revenue": 2, "unit_price": 4})
_table("p_pass", "SELECT p_partkey AS k, p_size / 3.0 AS third FROM part", "part", {"k": "p_partkey", "third": "PASS('CAST(p_size AS DOUBLE) / 3.0')"})
_query("p_distinct", "SELECT DISTINCT c_mktsegment AS market_segment, n_name AS customer_nation FROM customer JOIN nation ON n_nationkey = c_nationkey", ("Market Segment", "Customer Nation"), distinct=True)
_table("p_star", "SELECT *, r_regionkey + 1 AS next FROM region", "region", {"": "*", "next": "r_regionkey + 1"})
_table("p_prefix_star", "SELECT lineitem.*, round(l_extendedprice * (1 - l_discount), 4) + 0.0 AS net_price FROM lineitem", "lineitem", {"": "lineitem.*"}, digits={"net_price": 4})
_report("p_values", "SELECT k, v, k * 2 AS twice FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) t(k, v)", (Block("rows", values=((1, "a"), (2, "b"), (None, "c")), columns=("k", "v"), dims=("k", "v")), Block("more", source="rows", select=("*", Derived("Twice", "[k] * 2")))))
_report("p_block_star", "SELECT n_name AS customer_nation, r_name AS customer_region, n AS n_customers FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) USING (n_nationkey)", (Block("places", query=Query(("Customer Nation", "Customer Region"))), Block("people", query=Query(("Customer Nation", "# Customers"))), Block("both", source="places", joins=(BlockJoin("people", "inner"),), select=("*",))))
_query("p_long_names", "SELECT c_mktsegment AS market_segment, count(*) AS n_orders, count(*) + 1 AS n_orders2, count(*) + 2 AS groe FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", ("Market Segment", "# Orders", Derived("N Orders", "[# Orders] + 1"), Derived("Größe", "[# Orders] + 2")))
_report("p_with_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 6) SELECT n, CAST(n * n AS INT) AS square FROM r", (Block("numbers", sql="WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 6) SELECT n, n * n AS square FROM r"),))
_report("p_unnest", "SELECT r_regionkey AS k, unnest([r_name, upper(r_name)]) AS v FROM region", (Block("regions", sql=None, query=Query(("Customer Region",))), Block("pieces", sql="SELECT CAST(k AS INT) AS k, v FROM (SELECT CASE customer_region WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS k, explode(array(customer_region, upper(customer_region))) AS v FROM regions)")))
_report("p_subquery_alias", "SELECT s.seg AS seg, s.n AS n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) s WHERE s.n > 0", (Block("counts", query=Query(("Market Segment", "# Customers"))), Block("renamed", sql="SELECT s.seg, s.n FROM counts AS s(seg, n) WHERE s.n > 0")))

# Filters.
_query("f_where", f"SELECT c_mktsegment AS market_segment, {REV} AS revenue FROM {_LINES} WHERE r_name = 'ASIA' AND o_orderstatus <> 'F' GROUP BY 1", ("Market Segment", "Revenue"), {"revenue": 2}, where=All("[Customer Region] = 'ASIA'", "[Order Status] <> 'F'"))
_query("f_having", "SELECT n_name AS customer_nation, count(o_orderkey) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(o_orderkey) > 500", ("Customer Nation", "# Orders"), where="[# Orders] > 500")
_query("f_tree", f"SELECT n_name AS customer_nation, {REV} AS revenue FROM {_LINES} WHERE (r_name = 'ASIA' OR (c_mktsegment = 'BUILDING' AND NOT (o_orderstatus = 'O'))) GROUP BY 1", ("Customer Nation", "Revenue"), {"revenue": 2}, where=Any("[Customer Region] = 'ASIA'", All("[Market Segment] = 'BUILDING'", Not("[Order Status] = 'O'"))))
_query("f_where_and_having", f"SELECT c_mktsegment AS market_segment, o_orderstatus AS order_status, {REV} AS revenue FROM {_LINES} WHERE r_name <> 'ASIA' GROUP BY 1, 2 HAVING sum(l_quantity) > 1000", ("Market Segment", "Order Status", "Revenue"), {"revenue": 2}, where=All("[Customer Region] <> 'ASIA'", "[Quantity] > 1000"))
_big = Block("big", query=Query(("Customer Key", "Order Total"), where="[Order Total] > 3000000"))
_BIG = "SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000"
for _n, _op, _ex in (("f_include", "IN", False), ("f_exclude", "NOT IN", True)):
    _report(_n, f"SELECT c_mktsegment AS market_segment, count(c_custkey) AS n_customers FROM customer WHERE c_custkey {_op} ({_BIG}) GROUP BY 1", (_big, Block("chosen", query=Query(("Market Segment", "# Customers"), sets=(SetFilter("big", ("Customer Key",), _ex),)))))
_query("f_measure_of_other_root", "SELECT c_mktsegment AS market_segment, count(event_id) AS n_events FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment IN (SELECT c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) > 2900) GROUP BY 1", ("Market Segment", "# Events"), where="[# Orders] > 2900")
_query("f_measure_same_root", "SELECT n_name AS customer_nation, count(o_orderkey) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING max(o_totalprice) > 490000", ("Customer Nation", "# Orders"), where="[Largest Order] > 490000")
_query("f_windowed", "SELECT * FROM (SELECT n_name AS customer_nation, count(o_orderkey) AS n_orders, CAST(rank() OVER (ORDER BY count(o_orderkey) DESC, n_name) AS INT) AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) WHERE place <= 5", ("Customer Nation", "# Orders", Derived("Place", "rank() over (order by [# Orders] desc, [Customer Nation])")), where="[Place] <= 5")
_table("f_comparison", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size <> 20 AND p_retailprice > 950 AND NOT (p_size <= 12)", "part", {"k": "p_partkey"}, "p_size >= 10 and p_size < 40 and p_size <> 20 and p_retailprice > 950 and not (p_size <= 12)")
_table("f_null", "SELECT e.event_id AS k FROM events e WHERE e.value IS NOT NULL AND NULLIF(e.event_type, 'view') IS NULL", "events", {"k": "event_id"}, "value is not null and nullif(event_type, 'view') is null")
_table("f_like", "SELECT p_partkey AS k FROM part WHERE p_brand LIKE 'Brand#_2' AND p_type NOT LIKE '%!%%' ESCAPE '!'", "part", {"k": "p_partkey"}, "p_brand like 'Brand#_2' and p_type not like '%!%%' escape '!'")
_table("f_between", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice NOT BETWEEN 920 AND 980", "part", {"k": "p_partkey"}, "p_size between 5 and 15 and p_retailprice not between 920 and 980")
_table("f_in", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT')", "orders", {"k": "o_orderkey"}, "o_orderstatus in ('F', 'O') and o_orderpriority not in ('1-URGENT')")
_report("f_in_subquery", "SELECT c_mktsegment AS market_segment, count(c_custkey) AS n_customers FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1", (Block("asia", query=Query(("Customer Nation",), where="[Customer Region] = 'ASIA'", distinct=True)), Block("chosen", query=Query(("Market Segment", "# Customers"), sets=(SetFilter("asia", ("Customer Nation",)),)))))
_report("f_scalar_subquery", "SELECT n_name AS customer_nation, count(*) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) > (SELECT count(*) / 25.0 FROM customer)", (Block("by_nation", query=Query(("Customer Nation", "# Customers"))), Block("above", sql="SELECT customer_nation, n_customers FROM by_nation WHERE n_customers > (SELECT sum(n_customers) / 25.0 FROM by_nation)")))
_table("f_last", f"SELECT o_orderkey AS k FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' - INTERVAL 3 MONTH AND DATE '{AS_OF}'", "orders", {"k": "o_orderkey"}, "CAST(o_orderdate AS DATE) = last(3, month)", AS_OF)
_query("f_unreachable_dropped", "SELECT event_type AS event_type, count(event_id) AS n_events FROM events GROUP BY 1", ("Event Type", "# Events"), where=All("[Part Brand] = 'Brand#11'"))

# Joins.
_query("j_path", f"SELECT s_name AS supplier_name, n_name AS supplier_nation, r_name AS supplier_region, {REV} AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3", ("Supplier Name", "Supplier Nation", "Supplier Region", "Revenue"), {"revenue": 2})
_query("j_roles", f"SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, {REV} AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2", ("Customer Nation", "Supplier Nation", "Revenue"), {"revenue": 2})


def _typed(kind: JoinType, sql: str = "tleft.r_regionkey = tright.n_regionkey", cardinality: Cardinality = Cardinality.ONE_TO_MANY, where: str | None = None):
    """Regions and a subset of nations joined in one way."""

    def run(spark, sf_dir):
        c = Catalog(Project("typed")).add(
            Table("region", star().table("region").columns, TableType.DIMENSION, row_count=5),
            Table("nation", star().table("customer_nation").columns, TableType.FACT, row_count=25),
            Join("region", "nation", sql, cardinality, kind),
            Dimension("Region", (FieldExpression("r_name", ("region",)),)),
            Measure("Nations", (FieldExpression("count(n_nationkey)", ("nation",)),)),
        )
        return Compiler(spark, c, sf_dir).compile(Query(("Region", "Nations"), where=where))

    return run


for _kind, _sql in ((JoinType.INNER, "JOIN"), (JoinType.LEFT, "LEFT JOIN"), (JoinType.RIGHT, "RIGHT JOIN"), (JoinType.FULL, "FULL JOIN")):
    _add(f"j_{_kind.how}", f"SELECT r_name AS region, count(n_nationkey) AS nations FROM region {_sql} nation ON r_regionkey = n_regionkey AND n_name > 'NATION_2' AND r_name <> 'EUROPE' GROUP BY 1", _typed(_kind, "tleft.r_regionkey = tright.n_regionkey and tright.n_name > 'NATION_2' and tleft.r_name <> 'EUROPE'"))
_add("j_cross", "SELECT r_name AS region, count(n_nationkey) AS nations FROM region CROSS JOIN nation GROUP BY 1", _typed(JoinType.CROSS, ""))
_add("j_theta", "SELECT r_name AS region, count(n_nationkey) AS nations FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey AND r_regionkey + 4 GROUP BY 1", _typed(JoinType.INNER, "nation.n_nationkey between region.r_regionkey and region.r_regionkey + 4"))
_query("j_disjoint_suppressed", "SELECT CAST(NULL AS VARCHAR) AS part_brand, count(event_id) AS n_events FROM events", ("Part Brand", "# Events"))
_query("j_disjoint_crossed", "SELECT p_brand AS part_brand, n AS n_events FROM (SELECT DISTINCT p_brand FROM part), (SELECT count(event_id) AS n FROM events)", ("Part Brand", "# Events"), disjoint="cross")
_query("j_roll_down", "SELECT o_orderpriority AS order_priority, count(c_custkey) AS n_customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", ("Order Priority", "# Customers"))
_query("j_two_roots", f"SELECT market_segment, revenue, n_orders FROM (SELECT c_mktsegment AS market_segment, {REV} AS revenue FROM {_LINES} GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS market_segment, count(o_orderkey) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) USING (market_segment)", ("Market Segment", "Revenue", "# Orders"), {"revenue": 2})
_query("j_three_roots", "SELECT c_custkey AS customer_key, COALESCE(a, NULL) AS n_orders, b AS n_events, c AS account_balance FROM (SELECT o_custkey AS c_custkey, count(*) AS a FROM orders GROUP BY 1) FULL JOIN (SELECT user_id AS c_custkey, count(*) AS b FROM events JOIN customer ON customer.c_custkey = user_id GROUP BY 1) USING (c_custkey) FULL JOIN (SELECT c_custkey, round(sum(c_acctbal), 2) + 0.0 AS c FROM customer GROUP BY 1) USING (c_custkey)", ("Customer Key", "# Orders", "# Events", "Account Balance"), {"account_balance": 2})
_query("j_no_shared_dims", "SELECT a AS n_orders, b AS n_events FROM (SELECT count(*) AS a FROM orders), (SELECT count(*) AS b FROM events)", ("# Orders", "# Events"))
_seg = Block("orders_by", query=Query(("Market Segment", "Order Status", "# Orders")))
_ev = Block("events_by", query=Query(("Market Segment", "# Events")))
_OB = "SELECT c_mktsegment AS market_segment, o_orderstatus AS order_status, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"
_EB = "SELECT c_mktsegment AS market_segment, count(*) AS n_events FROM events JOIN customer ON c_custkey = user_id GROUP BY 1"
_report("j_blocks", f"SELECT market_segment, order_status, n_orders, n_events FROM ({_OB}) LEFT JOIN ({_EB}) USING (market_segment)", (_seg, _ev, Block("both", source="orders_by", joins=(BlockJoin("events_by", "left"),), select=("[Market Segment]", "[Order Status]", "[# Orders]", "@[events_by].[# Events]"))))
_report("j_blocks_full", f"SELECT market_segment, n_orders, n_events FROM (SELECT market_segment, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM ({_OB}) WHERE market_segment <> 'BUILDING' GROUP BY 1) FULL JOIN (SELECT * FROM ({_EB}) WHERE market_segment <> 'HOUSEHOLD') USING (market_segment)", (Block("o", query=Query(("Market Segment", "# Orders"), where="[Market Segment] <> 'BUILDING'")), Block("e", query=Query(("Market Segment", "# Events"), where="[Market Segment] <> 'HOUSEHOLD'")), Block("both", source="o", joins=(BlockJoin("e", "full"),), select=("[Market Segment]", "[# Orders]", "@[e].[# Events]"))))
_report("j_semi_anti", f"SELECT market_segment, order_status, n_orders FROM ({_OB}) WHERE market_segment IN (SELECT market_segment FROM ({_EB}) WHERE n_events > 100)", (_seg, Block("busy", query=Query(("Market Segment", "# Events"), where="[# Events] > 100")), Block("kept", source="orders_by", joins=(BlockJoin("busy", "left_semi"),), select=("[Market Segment]", "[Order Status]", "[# Orders]"))))
_report("j_natural_using", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", (Block("nations", query=Query(("Customer Nation", "Customer Region"))), Block("again", query=Query(("Customer Region",), distinct=True)), Block("both", sql="SELECT customer_nation AS name, customer_region AS region FROM nations NATURAL JOIN again JOIN again AS b USING (customer_region)")))

_SUPPLIERS = Block("sellers", query=Query(("Supplier Nation", "Supplier Name")))
_report("j_block_pairs", "SELECT a.n_name AS customer_nation, s_name AS supplier_name, n AS n_customers FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) a LEFT JOIN (SELECT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) b ON a.n_name = b.n_name", (Block("people", query=Query(("Customer Nation", "# Customers"))), _SUPPLIERS, Block("both", source="people", joins=(BlockJoin("sellers", "left", "@[people].[Customer Nation] = @[sellers].[Supplier Nation]"),), select=("[Customer Nation]", "@[sellers].[Supplier Name]", "[# Customers]"))))
_report("j_null_keys", "SELECT k, a, b FROM (VALUES ('x', 1), (NULL, 2)) l(k, a) FULL JOIN (VALUES ('y', 3), (NULL, 4)) r(j, b) ON k IS NOT DISTINCT FROM j WHERE k IS NOT NULL OR j IS NULL UNION ALL SELECT 'y', NULL, 3", (Block("l", values=(("x", 1), (None, 2)), columns=("k", "a"), dims=("k",)), Block("r", values=(("y", 3), (None, 4)), columns=("k", "b"), dims=("k",)), Block("both", source="l", joins=(BlockJoin("r", "full"),), select=("[k]", "[a]", "@[r].[b]"))))

# Aggregation.
_query("a_global", "SELECT round(sum(o_totalprice), 2) + 0.0 AS order_total, count(o_orderkey) AS n_orders, max(o_totalprice) AS largest_order FROM orders", ("Order Total", "# Orders", "Largest Order"), {"order_total": 2})
_query("a_group", "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, round(sum(l_quantity), 2) + 0.0 AS quantity, count(l_orderkey) AS n_lines FROM lineitem GROUP BY 1, 2", ("Return Flag", "Line Status", "Quantity", "# Lines"), {"quantity": 2})
_query("a_dims_only", "SELECT n_name AS customer_nation, r_name AS customer_region FROM nation JOIN region ON r_regionkey = n_regionkey", ("Customer Nation", "Customer Region"))
_query("a_distinct", "SELECT o_orderstatus AS order_status, count(DISTINCT o_custkey) AS n_buyers FROM orders GROUP BY 1", ("Order Status", "# Buyers"))
_query("a_virtual", "SELECT c_mktsegment AS market_segment, round(sum(o_totalprice) / count(o_orderkey), 4) + 0.0 AS average_order, round(sum(o_totalprice) / count(o_orderkey) / max(o_totalprice), 6) + 0.0 AS order_index FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", ("Market Segment", "Average Order", "Order Index"), {"average_order": 4, "order_index": 6})
_query("a_virtual_two_roots", f"SELECT market_segment, round(rev / n, 4) + 0.0 AS revenue_per_order FROM (SELECT c_mktsegment AS market_segment, sum(l_extendedprice * (1 - l_discount)) AS rev FROM {_LINES} GROUP BY 1) JOIN (SELECT c_mktsegment AS market_segment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) USING (market_segment)", ("Market Segment", "Revenue per Order"), {"revenue_per_order": 4})
_query("a_reference_grain", "SELECT l_returnflag AS return_flag, o_orderstatus AS order_status, round(sum(l_quantity), 2) + 0.0 AS quantity, count(o_orderkey) AS n_orders FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2", ("Return Flag", "Order Status", "Quantity", "# Orders"), {"quantity": 2}, grain="reference")
_query("a_finer_dimension", "SELECT p_brand AS part_brand, count(o_orderkey) AS n_orders FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1", ("Part Brand", "# Orders"))
_report("a_again", f"SELECT market_segment, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM ({_OB}) GROUP BY 1", (_seg, Block("coarse", source="orders_by", select=("[Market Segment]", "[# Orders]"))))
_report("a_again_max", f"SELECT order_status, max(n_orders) AS n_orders FROM ({_OB}) GROUP BY 1", (_seg, Block("coarse", source="orders_by", select=("[Order Status]", "[# Orders]"), again={"# Orders": "max"})))
_report("a_again_joined", f"SELECT market_segment, CAST(sum(n_orders) AS BIGINT) AS n_orders, CAST(max(n_events) AS BIGINT) AS n_events FROM ({_OB}) JOIN ({_EB}) USING (market_segment) GROUP BY 1", (_seg, _ev, Block("coarse", source="orders_by", joins=(BlockJoin("events_by", "inner"),), select=("[Market Segment]", "[# Orders]", "@[events_by].[# Events]"))))
_report("a_again_repeated", "SELECT n_name AS customer_nation, count(DISTINCT c_custkey) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey GROUP BY 1", (Block("people", query=Query(("Customer Nation", "Market Segment", "# Customers"))), _SUPPLIERS, Block("coarse", source="people", joins=(BlockJoin("sellers", "inner", (("Customer Nation", "Supplier Nation"),)),), select=("[Customer Nation]", "[# Customers]"))))
_report("a_again_of_sql", "SELECT k, v FROM (VALUES (7, 5), (8, 3)) t(k, v)", (Block("lines", sql="SELECT * FROM VALUES (7, 'x', 2), (7, 'y', 3), (8, 'x', 3) AS t(k, name, v)", dims=("k", "name")), Block("coarse", source="lines", select=("[k]", "[v]"), again={"[v]": "sum"}), Block("whole", sql="SELECT k, CAST(v AS INT) AS v FROM coarse")))
_table("a_divide_guard", "SELECT p_partkey AS k, round(p_retailprice / NULLIF(p_size % 5, 0), 4) + 0.0 AS q FROM part", "part", {"k": "p_partkey", "q": "p_retailprice / (p_size % 5)"}, digits={"q": 4})


def _aggregates(spark, sf_dir):
    c = star()
    for n, sql in (("Spread", "stddev_pop(p_size)"), ("Sample Spread", "stddev_samp(p_size)"), ("Mean", "avg(p_size)"), ("Least", "min(p_size)"), ("Rows", "count()"), ("Sizes", "count(distinct p_size)"), ("Variance", "var_samp(p_size)")):
        c.add(Measure(n, (FieldExpression(sql, ("part",)),)))
    df = Compiler(spark, c, sf_dir).compile(Query(("Part Brand", "Spread", "Sample Spread", "Mean", "Least", "Rows", "Sizes", "Variance")))
    return _rounded(df, {"spread": 6, "sample_spread": 6, "mean": 6, "variance": 6})


_add("a_functions", "SELECT p_brand AS part_brand, round(stddev_pop(p_size), 6) AS spread, round(stddev_samp(p_size), 6) AS sample_spread, round(avg(p_size), 6) AS mean, min(p_size) AS least, count(*) AS rows, count(DISTINCT p_size) AS sizes, round(var_samp(p_size), 6) AS variance FROM part GROUP BY 1", _aggregates)

# Windows.
_W = "SELECT c_mktsegment AS market_segment, CAST(year(o_orderdate) AS INT) AS order_year, count(o_orderkey) AS n_orders, {} FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"
for _n, _f, _s in (
    ("w_rank", "rank() over (partition by [Market Segment] order by [# Orders] desc)", "CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY count(o_orderkey) DESC) AS INT)"),
    ("w_dense_rank", "dense_rank() over (order by [# Orders])", "CAST(dense_rank() OVER (ORDER BY count(o_orderkey)) AS INT)"),
    ("w_row_number", "row_number() over (partition by [Order Year] order by [# Orders], [Market Segment])", "CAST(row_number() OVER (PARTITION BY CAST(year(o_orderdate) AS INT) ORDER BY count(o_orderkey), c_mktsegment) AS INT)"),
    ("w_lag_lead", "lag([# Orders]) over (partition by [Market Segment] order by [Order Year]) - lead([# Orders], 1, 0) over (partition by [Market Segment] order by [Order Year])", "lag(count(o_orderkey)) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT)) - lead(count(o_orderkey), 1, 0) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT))"),
    ("w_ntile", "ntile(3) over (partition by [Market Segment] order by [Order Year])", "CAST(ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT)) AS INT)"),
    ("w_rows_frame", "sum([# Orders]) over (partition by [Market Segment] order by [Order Year] rows between 2 preceding and current row)", "CAST(sum(count(o_orderkey)) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT) ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)"),
    ("w_range_frame", "max([# Orders]) over (partition by [Market Segment] order by [Order Year] range between 1 preceding and 1 following)", "max(count(o_orderkey)) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT) RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    ("w_one_sided_frame", "sum([# Orders]) over (partition by [Market Segment] order by [Order Year] rows unbounded preceding)", "CAST(sum(count(o_orderkey)) OVER (PARTITION BY c_mktsegment ORDER BY CAST(year(o_orderdate) AS INT) ROWS UNBOUNDED PRECEDING) AS BIGINT)"),
    ("w_over_aggregate", "sum([# Orders]) over (partition by [Order Year])", "CAST(sum(count(o_orderkey)) OVER (PARTITION BY CAST(year(o_orderdate) AS INT)) AS BIGINT)"),
    ("w_pruned", "sum([# Orders]) over (partition by [Market Segment], [Supplier Name] order by [Part Brand] rows unbounded preceding)", "CAST(sum(count(o_orderkey)) OVER (PARTITION BY c_mktsegment) AS BIGINT)"),
):
    _query(_n, _W.format(f"{_s} AS v"), ("Market Segment", "Order Year", "# Orders", Derived("V", _f)))

# Order, limit and top k.
_query("o_order_limit", "SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS order_date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20", ("Order Key", "Order Date"), order=(("Order Date", "desc"), ("Order Key", "asc")), limit=20)
_query("o_top_k_per_group", "SELECT * FROM (SELECT r_name AS customer_region, n_name AS customer_nation, count(o_orderkey) AS n_orders, CAST(row_number() OVER (PARTITION BY r_name ORDER BY count(o_orderkey) DESC, n_name) AS INT) AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2) WHERE place <= 2", ("Customer Region", "Customer Nation", "# Orders", Derived("Place", "row_number() over (partition by [Customer Region] order by [# Orders] desc, [Customer Nation])")), where="[Place] <= 2")
_report("o_nulls_first", f"SELECT * FROM (SELECT market_segment, n_orders, n_events FROM (SELECT c_mktsegment AS market_segment, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) LEFT JOIN (SELECT * FROM ({_EB}) WHERE n_events > 1900) USING (market_segment)) ORDER BY n_events ASC NULLS FIRST, market_segment LIMIT 3", (Block("o", query=Query(("Market Segment", "# Orders"))), Block("e", query=Query(("Market Segment", "# Events"), where="[# Events] > 1900")), Block("both", source="o", joins=(BlockJoin("e", "left"),), select=("[Market Segment]", "[# Orders]", "@[e].[# Events]"), order=(("[# Events]", "asc", "nulls first"), ("[Market Segment]", "asc")), limit=3)))

# Set operations on blocks.
_SETS = {"a": "SELECT c_nationkey AS k, c_mktsegment AS v FROM customer", "b": "SELECT s_nationkey AS k, 'BUILDING' AS v FROM supplier"}


def _sets(make):
    def run(spark, sf_dir):
        c = _compiler(spark, sf_dir)
        return make(c.select("customer", {"k": "c_nationkey", "v": "c_mktsegment"}), c.select("supplier", {"k": "s_nationkey", "v": "'BUILDING'"}))

    return run


for _n, _op, _make in (
    ("u_union_all", "UNION ALL", lambda a, b: B.union([a, b])), ("u_union", "UNION", lambda a, b: B.union([a, b], every=False)),
    ("u_intersect", "INTERSECT", B.intersect), ("u_intersect_all", "INTERSECT ALL", lambda a, b: B.intersect(a, b, every=True)),
    ("u_except", "EXCEPT", B.subtract), ("u_except_all", "EXCEPT ALL", lambda a, b: B.subtract(a, b, every=True)),
):
    _add(_n, f"{_SETS['a']} {_op} {_SETS['b']}", _sets(_make))

# Mathematics.
_X = "(p_size / 60e0)"
_table("m_hyperbolic", f"SELECT p_partkey AS k, round((exp({_X}) - exp(-{_X})) / 2, 8) AS sinh, round((exp({_X}) + exp(-{_X})) / 2, 8) AS cosh, round((exp({_X}) - exp(-{_X})) / (exp({_X}) + exp(-{_X})), 8) AS tanh FROM part", "part", {"k": "p_partkey", "sinh": "sinh(p_size / 60e0)", "cosh": "cosh(p_size / 60e0)", "tanh": "tanh(p_size / 60e0)"}, digits={"sinh": 8, "cosh": 8, "tanh": 8})
_table("m_inverse", f"SELECT p_partkey AS k, round(asin({_X}), 8) AS asin, round(ln({_X} + sqrt({_X} * {_X} + 1)), 8) AS asinh, round(ln((1 + {_X}) + sqrt((1 + {_X}) + 1) * sqrt((1 + {_X}) - 1)), 8) AS acosh, round(0.5 * ln((1 + {_X}) / (1 - {_X})), 8) AS atanh FROM part", "part", {"k": "p_partkey", "asin": "asin(p_size / 60e0)", "asinh": "asinh(p_size / 60e0)", "acosh": "acosh(1 + p_size / 60e0)", "atanh": "atanh(p_size / 60e0)"}, digits={"asin": 8, "asinh": 8, "acosh": 8, "atanh": 8})
_table("m_atan2", "SELECT p_partkey AS k, round(atan2(p_retailprice, p_size), 8) AS a FROM part", "part", {"k": "p_partkey", "a": "atan2(p_size, p_retailprice)"}, digits={"a": 8})
_table("m_power_log", "SELECT p_partkey AS k, round(pow(p_size, 1.5), 6) AS p, round(log10(p_retailprice), 8) AS l, round(ln(p_retailprice), 8) AS n FROM part", "part", {"k": "p_partkey", "p": "power(p_size, 1.5)", "l": "log(p_retailprice)", "n": "ln(p_retailprice)"}, digits={"p": 6, "l": 8, "n": 8})
_table("m_zero_null", "SELECT p_partkey AS k, NULLIF(p_size % 3, 0) AS a, COALESCE(NULLIF(p_size % 4, 1), 0) AS b FROM part", "part", {"k": "p_partkey", "a": "nullifzero(p_size % 3)", "b": "zeroifnull(nullif(p_size % 4, 1))"})
_table("m_tier", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN '< 10' WHEN p_size < 25 THEN '10-25' WHEN p_size < 40 THEN '25-40' ELSE '>= 40' END AS tier, CASE WHEN p_size = 7 THEN 'equal 7' ELSE 'Unknown' END AS one FROM part", "part", {"k": "p_partkey", "tier": "tier(p_size, 10, 25, 40)", "one": "tier(p_size, 7)"})
_table("m_guards", "SELECT p_partkey AS k, round(p_retailprice / NULLIF(p_size - 5, 0), 6) + 0.0 AS a, CAST(p_size % NULLIF(p_size - 7, 0) AS INT) AS b, CAST(NULL AS DOUBLE) AS c, CAST(-(-p_size) AS INT) AS d, round(ln(p_size) / ln(2), 8) + 0.0 AS e FROM part", "part", {"k": "p_partkey", "a": "p_retailprice / (p_size - 5)", "b": "p_size % (p_size - 7)", "c": "p_retailprice / 0e0", "d": "- - p_size", "e": "log(2, p_size)"}, digits={"a": 6, "e": 8})
_table("m_arithmetic", "SELECT p_partkey AS k, CAST(p_size + 3 AS INT) AS a, CAST(-p_size * 2 - 1 AS INT) AS b, CAST(p_size % 7 AS INT) AS c, p_size / 8.0 AS d FROM part", "part", {"k": "p_partkey", "a": "p_size + 3", "b": "-p_size * 2 - 1", "c": "p_size % 7", "d": "CAST(p_size AS DOUBLE) / 8.0"})
_table("m_pass_through", "SELECT p_partkey AS k, round(exp(p_size / 20e0), 6) AS e, round(sqrt(p_retailprice), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(5 - p_size) AS a, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS co, round(atan(p_size), 8) AS at FROM part", "part", {"k": "p_partkey", "e": "exp(p_size / 20e0)", "s": "sqrt(p_retailprice)", "f": "floor(p_retailprice)", "c": "ceil(p_retailprice)", "a": "abs(5 - p_size)", "si": "sin(p_size)", "co": "cos(p_size)", "at": "atan(p_size)"}, digits={"e": 6, "s": 6, "si": 8, "co": 8, "at": 8})

# Text.
_table("t_concat", "SELECT p_partkey AS k, p_brand || '/' || p_type AS a, p_brand || p_name AS b FROM part", "part", {"k": "p_partkey", "a": "concat(p_brand, '/', p_type)", "b": "p_brand || p_name"})
_table("t_trim", "SELECT p_partkey AS k, trim('  ' || p_brand || ' ') AS t, ltrim('  ' || p_brand || ' ') AS l, rtrim('  ' || p_brand || ' ') AS r FROM part", "part", {"k": "p_partkey", "t": "trim('  ' || p_brand || ' ')", "l": "left_trim('  ' || p_brand || ' ')", "r": "right_trim('  ' || p_brand || ' ')"})
_table("t_position", "SELECT p_partkey AS k, CAST(strpos(p_type, 'ER') AS INT) AS p FROM part", "part", {"k": "p_partkey", "p": "position(p_type, 'ER')"})
_table("t_substr_length", "SELECT p_partkey AS k, substr(p_name, 2) AS a, substr(p_name, 2, 3) AS b, CAST(length(p_name) AS INT) AS n FROM part", "part", {"k": "p_partkey", "a": "substr(p_name, 2)", "b": "substr(p_name, 2, 3)", "n": "length(p_name)"})
_table("t_literals", "SELECT r_regionkey AS k, 'it''s (a, b)/c' AS s, upper(r_name) AS u, lower(r_name) AS l, replace(r_name, 'A', '''') AS r FROM region", "region", {"k": "r_regionkey", "s": "'it''s (a, b)/c'", "u": "upper(r_name)", "l": "lower(r_name)", "r": "replace(r_name, 'A', '''')"})

# Calendar.
_D = "CAST(o_orderdate AS DATE)"
_table("c_parts", f"SELECT o_orderkey AS k, CAST(year({_D}) AS INT) AS y, CAST(quarter({_D}) AS INT) AS q, CAST(month({_D}) AS INT) AS m, CAST(day({_D}) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h, CAST(minute(o_orderdate) AS INT) AS mi, CAST(second(o_orderdate) AS INT) AS s FROM orders", "orders", {"k": "o_orderkey", "y": f"year({_D})", "q": f"quarter({_D})", "m": f"month({_D})", "d": f"day({_D})", "h": "hour(o_orderdate)", "mi": "minute(o_orderdate)", "s": "second(o_orderdate)"})
_table("c_datediff", f"SELECT o_orderkey AS k, CAST(date_diff('day', {_D}, DATE '{AS_OF}') AS INT) AS d, CAST(date_sub('month', {_D}, DATE '{AS_OF}') AS BIGINT) AS m, CAST(date_sub('year', {_D}, DATE '{AS_OF}') AS BIGINT) AS y FROM orders", "orders", {"k": "o_orderkey", "d": f"datediff({_D}, DATE'{AS_OF}')", "m": f"datediff({_D}, DATE'{AS_OF}', mm)", "y": f"datediff({_D}, DATE'{AS_OF}', year)"})
_table("c_dateadd", f"SELECT o_orderkey AS k, CAST({_D} + INTERVAL 10 DAY AS DATE) AS a, CAST({_D} + INTERVAL 2 MONTH AS DATE) AS b, CAST({_D} + INTERVAL 1 YEAR AS DATE) AS c, CAST({_D} + INTERVAL 21 DAY AS DATE) AS w, CAST({_D} + INTERVAL 3 MONTH AS DATE) AS q FROM orders", "orders", {"k": "o_orderkey", "a": f"dateadd({_D}, 10)", "b": f"dateadd({_D}, 2, month)", "c": f"dateadd({_D}, 1, yy)", "w": f"dateadd({_D}, 3, wk)", "q": f"dateadd({_D}, 1, qq)"})
_table("c_datesub", f"SELECT o_orderkey AS k, CAST({_D} - INTERVAL 10 DAY AS DATE) AS a, CAST({_D} - INTERVAL 2 MONTH AS DATE) AS b, strftime(CAST({_D} AS TIMESTAMP) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS h FROM orders", "orders", {"k": "o_orderkey", "a": f"datesub({_D}, 10)", "b": f"datesub({_D}, 2, month)", "h": f"date_format(datesub(CAST({_D} AS TIMESTAMP), 5, hh), 'yyyy-MM-dd HH:mm:ss')"})
_table("c_parse", "SELECT r_regionkey AS k, DATE '2020-02-03' AS a, DATE '2020-02-03' AS b, DATE '2020-02-03' AS c, '2020-02-03 10:11:12' AS d, DATE '2020-02-03' AS e FROM region", "region", {"k": "r_regionkey", "a": "d('20200203')", "b": "d('03-02-2020')", "c": "d('03 Feb 2020')", "d": "date_format(d('2020-02-03 10:11:12'), 'yyyy-MM-dd HH:mm:ss')", "e": "d('02|03|2020', 'MM|dd|yyyy')"})
_table("c_current", f"SELECT r_regionkey AS k, DATE '{AS_OF}' AS today FROM region", "region", {"k": "r_regionkey", "today": "CURRENT_DATE"}, as_of=AS_OF)
_table("c_now", f"SELECT r_regionkey AS k, DATE '{AS_OF}' AS d, '10:20:30' AS t, '{AS_OF} 10:20:30' AS s FROM region", "region", {"k": "r_regionkey", "d": "CURRENT_DATE", "t": "CURRENT_TIME", "s": "date_format(CURRENT_TIMESTAMP, 'yyyy-MM-dd HH:mm:ss')"}, as_of=f"{AS_OF} 10:20:30")
_table("c_literals", "SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 36 HOUR AS DATE) AS a, strftime(TIMESTAMP '2001-02-03 04:05:06' + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS b, CAST(CAST(o_orderdate AS DATE) - INTERVAL 14 MONTH AS DATE) AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < DATE '1997-01-01'", "orders", {"k": "o_orderkey", "a": "CAST(o_orderdate + INTERVAL '1 12' DAY TO HOUR AS DATE)", "b": "date_format(TIMESTAMP '2001-02-03 04:05:06' + INTERVAL '01:30' MINUTE TO SECOND, 'yyyy-MM-dd HH:mm:ss')", "c": "CAST(CAST(o_orderdate AS DATE) - INTERVAL '1-2' YEAR TO MONTH AS DATE)"}, "o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' and o_orderdate < DATE '1997-01-01'")
_table("c_extract", f"SELECT o_orderkey AS k, CAST(extract(year FROM {_D}) AS INT) AS y, CAST({_D} + INTERVAL 1 DAY AS DATE) AS t FROM orders WHERE {_D} > DATE '1996-03-04'", "orders", {"k": "o_orderkey", "y": f"extract(year from {_D})", "t": f"{_D} + INTERVAL '1' DAY"}, f"{_D} > DATE '1996-03-04'")

# Conditions, casts and arrays.
_table("e_case", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' END AS a, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS b FROM part", "part", {"k": "p_partkey", "a": "case when p_size > 25 then 'big' when p_size > 10 then 'mid' end", "b": "case p_size when 1 then 'one' else 'more' end"})
_table("e_if_coalesce", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS a, CASE WHEN p_size > 25 THEN 1 END AS b, COALESCE(NULLIF(p_brand, 'Brand#11'), 'none') AS c FROM part", "part", {"k": "p_partkey", "a": "if(p_size > 25, 1, 0)", "b": "if(p_size > 25, 1, null)", "c": "coalesce(nullif(p_brand, 'Brand#11'), 'none')"})
_table("e_cast", "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS a, TRY_CAST(p_brand AS INTEGER) AS b, CAST(true AS BOOLEAN) AS c, CAST(1.5 AS DOUBLE) AS d FROM part", "part", {"k": "p_partkey", "a": "cast(p_size as string)", "b": "try_cast(p_brand as int)", "c": "true", "d": "cast(1.5 as double)"})
_table("e_array", "SELECT p_partkey AS k, [p_size, 7][1] AS a, [p_size, 7][2] AS b FROM part", "part", {"k": "p_partkey", "a": "ARRAY[p_size, 7][1]", "b": "ARRAY[p_size, 7][2]"})
_table("e_quoted", 'SELECT "p_partkey" AS k, p_size AS a FROM part', "part", {"k": '"p_partkey"', "a": "`p_size`"})


# Sampling and limits.
_add("o_sampled_strata", "SELECT c_custkey AS customer_key, c_mktsegment AS market_segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", lambda spark, sf: B.sampled(_compiler(spark, sf).compile(Query(("Customer Key", "Market Segment"))), 0, 7, "market_segment", {"BUILDING": 1.0, "MACHINERY": 1.0, "HOUSEHOLD": 0.0}))
_add("o_sampled_all", "SELECT c_custkey AS customer_key FROM customer", lambda spark, sf: B.sampled(_compiler(spark, sf).compile(Query(("Customer Key",))), 1.0, 7))


def _limited(spark, sf_dir):
    c = star()
    c.project = Project("small", max_result_rows=7)
    return B.ReportRunner(Compiler(spark, c, sf_dir)).result(Report((Block("by", query=Query(("Customer Key", "Order Total"), order=(("Order Total", "desc"), ("Customer Key", "asc")))),)))


_add("o_row_limit", "SELECT o_custkey AS customer_key, round(sum(o_totalprice), 2) + 0.0 AS order_total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 7", lambda spark, sf: _rounded(_limited(spark, sf), {"order_total": 2}))


# The join graph: rows that depend on the model alone.
def _rows(values) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(text, v))})" for v in values)


def _base_paths(spark, sf_dir):
    paths = [(p.field, " > ".join(p.tables), p.cost) for p in Graph(star()).all_base_paths() if p.field in ("Supplier Region", "Part Brand", "Revenue")]
    return spark.createDataFrame(paths, "field string, tables string, cost long")


_PATHS = [("Supplier Region", "supplier_region", 5), ("Supplier Region", "supplier_region > supplier_nation", 25), ("Supplier Region", "supplier_region > supplier_nation > supplier", 10025), ("Supplier Region", "supplier_region > supplier_nation > supplier > lineitem", 6010025), ("Part Brand", "part", 200000), ("Part Brand", "part > lineitem", 6000000), ("Revenue", "lineitem", 6000000)]
_add("g_base_paths", f"SELECT field, tables, CAST(cost AS BIGINT) AS cost FROM (VALUES {_rows(_PATHS)}) t(field, tables, cost)", _base_paths)


def _universe(spark, sf_dir):
    same, more = Graph(star()).universe(["# Events", "Market Segment"])
    rows = [("same", None, n) for n in same] + [("shared", m, d) for m, of in more.items() for d in of if m in ("Revenue", "# Customers")]
    return spark.createDataFrame(rows, "kind string, measure string, field string")


_SHARED = ["Account Key", "Customer Balance", "Customer Key", "Customer Name", "Customer Nation", "Customer Region", "Market Segment"]
_SAME = [*[d for d in _SHARED if d != "Market Segment"], "# Customers", "Account Balance", "Event Day", "Event Type", "Event Value"]
_add("g_universe", f"SELECT kind, measure, field FROM (VALUES {_rows([('same', None, n) for n in _SAME] + [('shared', 'Revenue', d) for d in _SHARED])}) t(kind, measure, field)", _universe)


# Sources and models.
def _folder(spark) -> str:
    """A new folder that all executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/') if shared else tempfile.gettempdir()}/loomsheet-engine-{uuid.uuid4().hex}"


def _saved_model(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # the driver alone writes and reads models
        model = C.load(C.save(star(), folder))
    return _rounded(Compiler(spark, model, sf_dir).compile(Query(("Customer Region", "Order Year", "Revenue"))), {"revenue": 2})


_add("s_saved_model", ORACLE["p_select"], _saved_model)

_SHOP = """{ name: 'shop', maxResultRows: 10, /* small */ }"""
_FILES = {
    "project.json": _SHOP,
    "files/datasource.json": "{'name': 'files', 'kind': 'parquet',}",
    "files/tables/nation.json": "{'name': 'nation', 'tableType': 'DIMENSION', 'rowCount': 25, 'columns': [{'name': 'n_nationkey', 'dataType': 'INTEGER', 'keyType': 'PRIMARY_KEY'}, {'name': 'n_name'},]}",
    "files/tables/supplier.json": "{'name': 'supplier', 'tableType': 'FACT', 'rowCount': 100, 'columns': [{'name': 's_suppkey'}, {'name': 's_nationkey', 'keyType': 'FOREIGN_KEY'}]} // facts",
    "files/joins/one.json": "{'leftTable': 'files.nation', 'rightTable': 'files.supplier', sql: 'tleft.n_nationkey = tright.s_nationkey'}",
    "dimensions/Nation.json": "{'name': 'Nation', 'expressions': [{'sql': 'n_name', 'tables': ['files.nation']}]}",
    "measures/Sellers.json": "{'name': 'Sellers', 'expressions': [{'sql': 'count(s_suppkey)', 'tables': ['files.supplier', 'files.gone']}]}",
    "measures/broken.json": "{nope",
}


def _written_model(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        for name, text in _FILES.items():
            path = C.Path(folder) / "shop" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        model = C.load_all(folder)["shop"]
    return Compiler(spark, model, sf_dir).compile(Query(("Nation", "Sellers"))).withColumn("n_warnings", F.lit(len(model.warnings)))


_add("s_written_model", "SELECT n_name AS nation, count(*) AS sellers, 2 AS n_warnings FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1", _written_model)
_KEYS = {"customer": ("c_custkey",), "orders": ("o_orderkey",), "nation": ("n_nationkey",)}


def _generated_model(spark, sf_dir):
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _KEYS}
    c = G.generate("shop", frames, _KEYS, {"orders": {"o_custkey": ("customer", "c_custkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}})
    return _rounded(Compiler(spark, c, sf_dir).compile(Query(("N Name", "C Mktsegment", "O Totalprice"))), {"o_totalprice": 2})


_add("s_generated_model", "SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) + 0.0 AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2", _generated_model)


def _detected_join(spark, sf_dir):
    frames = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), "lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")}
    c = G.generate("found", frames, {"orders": ("o_orderkey",)}, detect=True)
    return _rounded(Compiler(spark, c, sf_dir).compile(Query(("O Orderstatus", "L Quantity"))), {"l_quantity": 2})


_add("s_detected_join", "SELECT o_orderstatus, round(sum(l_quantity), 2) + 0.0 AS l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1", _detected_join)


def _from(kind: str):
    """Nations written in another format and read through a model of that source."""

    def run(spark, sf_dir):
        nations, folder = spark.read.parquet(f"{sf_dir}/nation.parquet"), _folder(spark)
        if kind == "table":
            name = f"nations_{uuid.uuid4().hex}"
            S.create_table_as(nations, name, path=f"{folder}/{name}")
            source, table = DataSource("s", "table"), Table("nation", star().table("customer_nation").columns, physical=name, source="s")
        else:
            B.load_block(nations, f"{folder}/nation.{kind}", kind, **({"header": "true"} if kind == "csv" else {}))
            source, table = DataSource("s", kind, {"path": folder}), Table("nation", star().table("customer_nation").columns, source="s")
        c = Catalog(Project("p")).add(source, table, Dimension("Region Key", (FieldExpression("CAST(n_regionkey AS INT)", ("nation",)),)), Measure("Nations", (FieldExpression("count(n_name)", ("nation",)),)))
        return Compiler(spark, c).compile(Query(("Region Key", "Nations")))

    return run


for _n in ("csv", "json", "orc", "parquet", "table"):
    _add(f"s_{_n}_source", "SELECT n_regionkey AS region_key, count(n_name) AS nations FROM nation GROUP BY 1", _from(_n))


def _sniffed(spark, sf_dir):
    path = f"{_folder(spark)}/nations.txt"
    B.load_block(spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1), path, "csv", sep=";", header="true", compression="gzip")
    found = G.sniffed(spark, path)
    return G.sample_file(spark, path, 1000, **found).select("n_nationkey", "n_name", F.lit(found["sep"]).alias("sep"), F.lit(G.file_rows(spark, path, **found)).cast("long").alias("n_rows"))


_add("s_sniffed_file", "SELECT n_nationkey, n_name, ';' AS sep, (SELECT count(*) FROM nation) AS n_rows FROM nation", _sniffed)
_add("s_answers", "SELECT * FROM (VALUES ('files', true), ('gone', false), ('tables', true), ('spark', true)) t(source, answers)", lambda spark, sf: spark.createDataFrame([("files", G.test_source(spark, DataSource("a", "parquet", {"path": sf}))), ("gone", G.test_source(spark, DataSource("b", "parquet", {"path": f"{sf}/gone"}))), ("tables", G.test_source(spark, DataSource("c", "table"))), ("spark", G.test_connection(spark))], "source string, answers boolean"))
_add("s_schemas", "SELECT 'supplier' AS name, 'DIMENSION' AS kind, (SELECT count(*) FROM supplier) AS n_rows, 's_suppkey:BIGINT:PRIMARY_KEY, s_name:TEXT:NO_KEY_TYPE, s_nationkey:INTEGER:NO_KEY_TYPE, s_acctbal:DECIMAL:NO_KEY_TYPE' AS columns", lambda spark, sf: spark.createDataFrame([(t.name, t.kind.value, t.row_count, ", ".join(f"{c.name}:{c.data_type}:{c.key.value}" for c in t.columns)) for t in [G.import_table("supplier", spark.read.parquet(f"{sf}/supplier.parquet"), ("s_suppkey",))]], "name string, kind string, n_rows long, columns string"))


# Statements.
def _stated(spark, sf_dir):
    """A table made from a query, inserted into, renamed and read."""
    name = f"made_{uuid.uuid4().hex}"
    df = _compiler(spark, sf_dir).compile(Query(("Customer Nation", "# Customers")))
    S.create_table_as(df, name, path=f"{_folder(spark)}/{name}")
    S.insert_into(df.limit(0).unionByName(spark.createDataFrame([("nowhere", 1)], df.schema)), name)
    S.rename_table(spark, name, f"{name}_again")
    return spark.table(f"{name}_again")


_add("d_create_insert_rename", "SELECT n_name AS customer_nation, count(*) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT 'nowhere', 1", _stated)


def _viewed(spark, sf_dir):
    df, name = _compiler(spark, sf_dir).compile(Query(("Customer Region",), distinct=True)), f"view_{uuid.uuid4().hex}"
    S.create_view(df.limit(0), name)
    S.create_view(df, name, replace=True)
    S.create_table_as(df, f"{name}_t", temporary=True)
    out = spark.table(name).unionByName(spark.table(f"{name}_t"))
    out.schema  # noqa: B018 - both are resolved here, and may be dropped then
    S.drop_view(spark, name)
    S.drop_view(spark, f"{name}_t")
    return out


_add("d_views", "SELECT DISTINCT r_name AS customer_region FROM region UNION ALL SELECT DISTINCT r_name FROM region", _viewed)


def _shown(spark, sf_dir):
    name = f"shown_{uuid.uuid4().hex}"
    S.create_table_as(spark.read.parquet(f"{sf_dir}/region.parquet"), name, path=f"{_folder(spark)}/{name}")
    columns = [r[0] for r in S.show(spark, "columns", name).collect()]
    listed = name in [r.tableName for r in S.show(spark, "tables").collect()]
    S.drop_table(spark, name)
    gone = name not in [r.tableName for r in S.show(spark, "tables").collect()]
    plan = S.explained(_compiler(spark, sf_dir).compile(Query(("Order Status", "# Orders"), where="[Order Status] = 'F'")))
    return spark.createDataFrame([(", ".join(columns), listed, gone, "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan, "o_totalprice" in plan)], "columns string, listed boolean, gone boolean, pushed boolean, unneeded boolean")


_add("d_listed_and_explained", "SELECT 'r_regionkey, r_name' AS columns, true AS listed, true AS gone, true AS pushed, false AS unneeded", _shown)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
