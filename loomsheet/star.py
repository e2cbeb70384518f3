"""A star model of the test tables: customers, orders, line items, suppliers, parts and events.

Nations and regions play two roles each, one for customers and one for suppliers.
"""

from __future__ import annotations

from loomsheet.model import Catalog, Column, DataSource, Dimension, FieldExpression, Join, KeyType, Measure, Project, Table, TableType

P, FK = KeyType.PRIMARY, KeyType.FOREIGN
_COLUMNS = {
    "region": "r_regionkey INTEGER P, r_name TEXT",
    "nation": "n_nationkey INTEGER P, n_name TEXT, n_regionkey INTEGER F",
    "customer": "c_custkey BIGINT P, c_name TEXT, c_nationkey INTEGER F, c_acctbal DECIMAL, c_mktsegment TEXT",
    "supplier": "s_suppkey BIGINT P, s_name TEXT, s_nationkey INTEGER F, s_acctbal DECIMAL",
    "part": "p_partkey BIGINT P, p_name TEXT, p_brand TEXT, p_type TEXT, p_size INTEGER, p_retailprice DECIMAL",
    "orders": "o_orderkey BIGINT P, o_custkey BIGINT F, o_orderstatus TEXT, o_totalprice DECIMAL, o_orderdate TIMESTAMP, o_orderpriority TEXT",
    "lineitem": "l_orderkey BIGINT F, l_partkey BIGINT F, l_suppkey BIGINT F, l_linenumber INTEGER, l_quantity DECIMAL, l_extendedprice DECIMAL, l_discount DECIMAL, l_tax DECIMAL, l_returnflag TEXT, l_linestatus TEXT, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT P, ts TIMESTAMP, user_id BIGINT F, event_type TEXT, value DECIMAL, props TEXT",
}


def columns(table: str) -> tuple[Column, ...]:
    out = []
    for part in _COLUMNS[table].split(", "):
        name, kind, *key = part.split()
        out.append(Column(name, kind, {"P": P, "F": FK}[key[0]] if key else KeyType.NONE))
    return tuple(out)


def star() -> Catalog:
    c = Catalog(Project("star")).add(DataSource("files", "parquet"))
    kinds = {"orders": TableType.FACT, "lineitem": TableType.FACT, "events": TableType.FACT}
    rows = {"region": 5, "nation": 25, "customer": 150_000, "supplier": 10_000, "part": 200_000, "orders": 1_500_000, "lineitem": 6_000_000, "events": 1_000_000}
    for role, physical in (
        ("region", "region"), ("customer_region", "region"), ("supplier_region", "region"), ("customer_nation", "nation"), ("supplier_nation", "nation"),
        ("customer", "customer"), ("supplier", "supplier"), ("part", "part"), ("orders", "orders"), ("lineitem", "lineitem"), ("events", "events"),
    ):
        extra = (Column("net_price", "DECIMAL", sql="l_extendedprice * (1 - l_discount)"),) if role == "lineitem" else ()
        c.add(Table(role, columns(physical) + extra, kinds.get(physical, TableType.DIMENSION), physical, None, rows[physical], "files"))
    for left, right, on in (
        ("customer_region", "customer_nation", "tleft.r_regionkey = tright.n_regionkey"),
        ("supplier_region", "supplier_nation", "tleft.r_regionkey = tright.n_regionkey"),
        ("customer_nation", "customer", "customer_nation.n_nationkey = customer.c_nationkey"),
        ("supplier_nation", "supplier", "supplier_nation.n_nationkey = supplier.s_nationkey"),
        ("customer", "orders", "customer.c_custkey = orders.o_custkey"),
        ("orders", "lineitem", "orders.o_orderkey = lineitem.l_orderkey"),
        ("part", "lineitem", "part.p_partkey = lineitem.l_partkey"),
        ("supplier", "lineitem", "supplier.s_suppkey = lineitem.l_suppkey"),
        ("customer", "events", "customer.c_custkey = events.user_id"),
    ):
        c.add(Join(left, right, on))
    for name, *expressions in (
        ("Customer Region", "r_name", "customer_region"), ("Supplier Region", "r_name", "supplier_region"),
        ("Customer Nation", "n_name", "customer_nation"), ("Supplier Nation", "n_name", "supplier_nation"),
        ("Customer Key", "c_custkey", "customer"), ("Customer Name", "c_name", "customer"), ("Market Segment", "c_mktsegment", "customer"), ("Customer Balance", "c_acctbal", "customer"),
        ("Supplier Name", "s_name", "supplier"), ("Supplier Key", "s_suppkey", "supplier"),
        ("Part Brand", "p_brand", "part"), ("Part Type", "p_type", "part"), ("Part Size", "p_size", "part"), ("Part Name", "p_name", "part"),
        ("Order Status", "o_orderstatus", "orders"), ("Order Priority", "o_orderpriority", "orders"), ("Order Date", "CAST(o_orderdate AS DATE)", "orders"),
        ("Order Year", "CAST(year(o_orderdate) AS INT)", "orders"), ("Order Month", "CAST(month(o_orderdate) AS INT)", "orders"), ("Order Key", "o_orderkey", "orders"),
        ("Return Flag", "l_returnflag", "lineitem"), ("Line Status", "l_linestatus", "lineitem"), ("Ship Year", "CAST(year(l_shipdate) AS INT)", "lineitem"),
        ("Event Type", "event_type", "events"), ("Event Day", "CAST(ts AS DATE)", "events"),
        ("Account Key", "c_custkey", "customer"),
    ):
        sql, table = expressions
        c.add(Dimension(name, (FieldExpression(sql, (table,)),)))
    for name, sql, table in (
        ("Revenue", "sum(l_extendedprice * (1 - l_discount))", "lineitem"), ("Quantity", "sum(l_quantity)", "lineitem"), ("# Lines", "count(l_orderkey)", "lineitem"),
        ("Discount Value", "sum(l_extendedprice * l_discount)", "lineitem"), ("Net Price", "sum(net_price)", "lineitem"),
        ("# Orders", "count(o_orderkey)", "orders"), ("Order Total", "sum(o_totalprice)", "orders"), ("Largest Order", "max(o_totalprice)", "orders"), ("# Buyers", "count(distinct o_custkey)", "orders"),
        ("# Events", "count(event_id)", "events"), ("Event Value", "sum(value)", "events"),
        ("Account Balance", "sum(c_acctbal)", "customer"), ("# Customers", "count(c_custkey)", "customer"),
    ):
        c.add(Measure(name, (FieldExpression(sql, (table,)),)))
    c.add(Measure("Average Order", (FieldExpression("@[Order Total] / @[# Orders]", ()),)))
    c.add(Measure("Revenue per Order", (FieldExpression("@[Revenue] / @[# Orders]", ()),)))
    c.add(Measure("Order Index", (FieldExpression("@[Average Order] / @[Largest Order]", ()),)))
    return c
