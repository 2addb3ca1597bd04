"""The sixteen directions as queries, each ending in one listing of the migrated dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.plans import trade as T
from modelshift.plans.registry import query

# --- the same listings in SQL ----------------------------------------------------------

MONEY = {"supplier_balance", "customer_balance", "unit_price", "total", "quantity", "price",
         "discount", "tax", "order_total"}
DATES = {"order_date", "ship_date"}


def _text(col: str) -> str:
    name = col.split(".")[-1]
    if name in MONEY:
        col = f"CAST({col} AS DECIMAL(18,2))"
    elif name in DATES:
        col = f"CAST({col} AS DATE)"
    return f"coalesce(CAST({col} AS VARCHAR), '~')"


def _row(entity: str, table: str, key: list[str], body: list[str]) -> str:
    def joined(cols: list[str]) -> str:
        return "concat_ws('|', " + ", ".join(
            c if c.startswith("'") else _text(c) for c in cols) + ")"

    return f"SELECT '{entity}' AS entity, {joined(key)} AS id, {joined(body)} AS body FROM {table}"


def _coded(*cols: str) -> str:
    """The surrogate over these columns."""
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in cols]
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


#: The domain with its given keys.
GIVEN = f"""
    WITH t_regions AS (SELECT r_regionkey AS region_id, r_name AS region_name FROM region),
    t_nations AS (SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id
                  FROM nation),
    t_categories AS (SELECT DISTINCT {_coded('p_brand')} AS category_id, p_brand AS category_name
                     FROM part),
    t_suppliers AS (SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
                           s_acctbal AS supplier_balance, s_nationkey AS nation_id FROM supplier),
    t_customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name,
                           c_acctbal AS customer_balance, c_mktsegment AS segment,
                           c_nationkey AS nation_id FROM customer),
    t_products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_type,
                          p_size AS size, p_retailprice AS unit_price,
                          {_coded('p_brand')} AS category_id FROM part),
    t_orders AS (SELECT o_orderkey AS order_id, o_orderstatus AS order_status,
                        o_totalprice AS total, o_orderdate AS order_date,
                        o_orderpriority AS priority, o_custkey AS customer_id FROM orders),
    t_order_details AS (SELECT l_orderkey AS order_id, l_linenumber AS line_number,
                        l_partkey AS product_id, l_suppkey AS supplier_id,
                        l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
                        l_tax AS tax, l_returnflag AS return_flag, l_linestatus AS line_status,
                        l_shipdate AS ship_date FROM lineitem)
"""

_PRODUCT_KEY = _coded("p_name", "p_type", "p_size", "p_retailprice", "p_brand")
_SUPPLIER_KEY = _coded("s_name", "s_acctbal", "n_name")
_NATION_KEY = _coded("n_name", "r_name")

#: What documents give back: only what orders and customers refer to, under surrogate keys.
SURROGATE = f"""
    WITH places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
    lines AS (SELECT * FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
              LEFT JOIN supplier ON l_suppkey = s_suppkey
              LEFT JOIN places ON s_nationkey = n_nationkey),
    homes AS (SELECT * FROM customer LEFT JOIN places ON c_nationkey = n_nationkey),
    t_products AS (SELECT DISTINCT {_PRODUCT_KEY} AS product_id, p_name AS product_name,
                   p_type AS product_type, p_size AS size, p_retailprice AS unit_price,
                   {_coded('p_brand')} AS category_id FROM lines WHERE p_partkey IS NOT NULL),
    t_categories AS (SELECT DISTINCT {_coded('p_brand')} AS category_id, p_brand AS category_name
                     FROM lines WHERE p_partkey IS NOT NULL),
    t_suppliers AS (SELECT DISTINCT {_SUPPLIER_KEY} AS supplier_id, s_name AS supplier_name,
                    s_acctbal AS supplier_balance, {_NATION_KEY} AS nation_id
                    FROM lines WHERE s_suppkey IS NOT NULL),
    t_nations AS (SELECT DISTINCT {_NATION_KEY} AS nation_id, n_name AS nation_name,
                  {_coded('r_name')} AS region_id
                  FROM (SELECT n_name, r_name FROM lines UNION ALL SELECT n_name, r_name FROM homes)
                  WHERE n_name IS NOT NULL),
    t_regions AS (SELECT DISTINCT {_coded('r_name')} AS region_id, r_name AS region_name
                  FROM (SELECT r_name FROM lines UNION ALL SELECT r_name FROM homes)
                  WHERE r_name IS NOT NULL),
    t_customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name,
                    c_acctbal AS customer_balance, c_mktsegment AS segment,
                    {_NATION_KEY} AS nation_id FROM homes),
    t_orders AS (SELECT o_orderkey AS order_id, o_orderstatus AS order_status,
                 o_totalprice AS total, o_orderdate AS order_date, o_orderpriority AS priority,
                 o_custkey AS customer_id FROM orders),
    t_order_details AS (SELECT l_orderkey AS order_id, l_linenumber AS line_number,
                        CASE WHEN p_partkey IS NOT NULL THEN {_PRODUCT_KEY} END AS product_id,
                        CASE WHEN s_suppkey IS NOT NULL THEN {_SUPPLIER_KEY} END AS supplier_id,
                        l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
                        l_tax AS tax, l_returnflag AS return_flag, l_linestatus AS line_status,
                        l_shipdate AS ship_date FROM lines)
"""

TABLES_SQL = " UNION ALL ".join(
    _row(e, f"t_{e}", key, body) for e, (key, body) in T.TABLE_LISTING.items()
)


def _set(table: str, *cols: str) -> str:
    """The rows of a table whose references are set: the others make no edge."""
    return f"(SELECT * FROM {table} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})"


_LINKED_DETAILS = _set("t_order_details", "order_id", "product_id")
_EDGE_SQL = {
    "LOCATED_IN": (_set("t_nations", "region_id"), "nation_id", "region_id"),
    "LIVES_IN": (_set("t_customers", "nation_id"), "customer_id", "nation_id"),
    "BASED_IN": (_set("t_suppliers", "nation_id"), "supplier_id", "nation_id"),
    "PART_OF": (_set("t_products", "category_id"), "product_id", "category_id"),
    "PURCHASED": (_set("t_orders", "customer_id"), "customer_id", "order_id"),
    "SUPPLIES": ("(SELECT DISTINCT supplier_id, product_id FROM t_order_details "
                 "WHERE supplier_id IS NOT NULL AND product_id IS NOT NULL)",
                 "supplier_id", "product_id"),
}
_REFERENCE_OF = {holder: col for _, _, _, holder, col in T.EDGES}


def _vertex_sql(entity: str) -> str:
    key, body = T.TABLE_LISTING[entity]
    kept = [c for c in body if c != _REFERENCE_OF.get(entity)]
    return _row(entity, f"t_{entity}", key, [f"'{entity}'", *kept])


GRAPH_SQL = " UNION ALL ".join(
    [_vertex_sql(v) for v in T.VERTICES]
    + [_row(n, t, [a, b], [a]) for n, (t, a, b) in _EDGE_SQL.items()]
    + [_row("CONTAINS", _LINKED_DETAILS,
            ["order_id", "product_id", "line_number", "supplier_id"],
            T.TABLE_LISTING["order_details"][1])]
)

_JOINED = """(SELECT * FROM t_order_details
    LEFT JOIN (SELECT product_id, product_name, product_type, size, unit_price, category_name
          FROM t_products JOIN t_categories USING (category_id)) USING (product_id)
    LEFT JOIN (SELECT supplier_id, supplier_name, supplier_balance, nation_name, region_name
          FROM t_suppliers JOIN t_nations USING (nation_id) JOIN t_regions USING (region_id))
         USING (supplier_id))"""
_HOMES = "(SELECT * FROM t_customers JOIN t_nations USING (nation_id) JOIN t_regions USING (region_id))"

DOCUMENTS_SQL = " UNION ALL ".join([
    _row("customers", _HOMES, ["customer_id"],
         ["customer_name", "customer_balance", "segment", "nation_name", "region_name"]),
    _row("orders", "t_orders", ["order_id"],
         ["order_status", "total", "order_date", "priority", "customer_id"]),
    _row("orders.details", _JOINED, ["order_id", "line_number"],
         [*T.TABLE_LISTING["order_details"][1], *T.PRODUCT_FIELDS, "category_name",
          "supplier_name", "supplier_balance", "nation_name", "region_name"]),
])


def _direction(name: str, head: str, body: str, list_rows) -> None:
    @query(name, head + body)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return list_rows(T.migrate(spark, d, name))


for _name in ("r2d", "c2d"):
    _direction(_name, GIVEN, DOCUMENTS_SQL, T.document_listing)
_direction("g2d", GIVEN, DOCUMENTS_SQL.replace(
    "FROM t_order_details", f"FROM {_LINKED_DETAILS}"), T.document_listing)
for _name in ("c2r", "r2c"):
    _direction(_name, GIVEN, TABLES_SQL, T.table_listing)
for _name in ("g2r", "g2c"):
    # A detail without its product has no edge to come back from.
    _direction(_name, GIVEN, TABLES_SQL.replace(
        "FROM t_order_details", f"FROM {_LINKED_DETAILS}"), T.table_listing)
for _name in ("d2r", "d2c"):
    _direction(_name, SURROGATE, TABLES_SQL, T.table_listing)
for _name in ("r2g", "c2g"):
    _direction(_name, GIVEN, GRAPH_SQL, T.graph_listing)
_direction("d2g", SURROGATE, GRAPH_SQL, T.graph_listing)


# --- evolution within a model ----------------------------------------------------------

def _evolved_tables(ds: T.Dataset) -> DataFrame:
    """The entities the evolution changed."""
    return T.listings([
        T.listing(ds["products"], "products", ["product_id"],
                  ["name", "product_type", "size", "unit_price", "category_name"]),
        T.listing(ds["customers"], "customers", ["customer_id"], ["customer_name", "nation_id"]),
        T.listing(ds["customer_accounts"], "customer_accounts", ["customer_id"],
                  ["customer_balance", "segment"]),
        T.listing(ds["segments"], "segments", ["segment_id"], ["segment_name"]),
        T.listing(ds["suppliers"], "suppliers", ["supplier_id"],
                  ["supplier_name", "supplier_balance", "nation_id", "email"]),
        T.listing(ds["orders"], "orders", ["order_id"],
                  ["order_status", "order_total", "order_date", "priority", "customer_id", "stage"]),
        T.listing(ds["order_details"], "order_details",
                  ["order_id", "line_number", "product_id", "supplier_id"],
                  ["quantity", "price", "discount", "return_flag", "ship_date"]),
    ])


_WITH_CATEGORY = "(SELECT * FROM t_products JOIN t_categories USING (category_id))"

_direction("r2r", GIVEN, " UNION ALL ".join([
    _row("products", _WITH_CATEGORY, ["product_id"],
         ["product_name", "product_type", "size", "unit_price", "category_name"]),
    _row("customers", "t_customers", ["customer_id"], ["customer_name", "nation_id"]),
    _row("customer_accounts", "t_customers", ["customer_id"], ["customer_balance", "segment"]),
    _row("segments", f"(SELECT DISTINCT segment, {_coded('segment')} AS segment_id FROM t_customers)",
         ["segment_id"], ["segment"]),
    _row("suppliers", "t_suppliers", ["supplier_id"],
         ["supplier_name", "supplier_balance", "nation_id", "'~'"]),
    _row("orders", "t_orders", ["order_id"],
         ["order_status", "total", "order_date", "priority", "customer_id", "'new'"]),
    _row("order_details", "t_order_details",
         ["order_id", "line_number", "product_id", "supplier_id"],
         ["quantity", "price", "discount", "return_flag", "ship_date"]),
]), _evolved_tables)


def _evolved_documents(ds: T.Dataset) -> DataFrame:
    orders = ds["orders"].withColumn("review", F.when(F.col("state.review").isNull(), "none"))
    details = orders.select("_id", F.explode("details").alias("d")).withColumn(
        "n_territories", F.size("d.supplier.territories"))
    return T.listings([
        T.listing(ds["customers"], "customers", ["_id"],
                  ["profile.customer_name", "profile.account.customer_balance",
                   "profile.account.segment", "nation.nation_name"]),
        T.listing(orders.where(f"{T.PART} = 0"), "orders", ["_id"],
                  ["state.order_status", "order_total", "order_date", "state.priority",
                   "customer_id", "stage", "review"]),
        T.listing(details, "orders.details", ["_id", "d.line_number"],
                  ["d.quantity", "d.price", "d.discount", "d.return_flag", "d.ship_date",
                   "d.product.name", "d.product.category_name", "d.supplier.supplier_name",
                   "d.supplier.email", "n_territories"]),
    ])


_direction("d2d", GIVEN, " UNION ALL ".join([
    _row("customers", _HOMES, ["customer_id"],
         ["customer_name", "customer_balance", "segment", "nation_name"]),
    _row("orders", "t_orders", ["order_id"],
         ["order_status", "total", "order_date", "priority", "customer_id", "'new'", "'none'"]),
    _row("orders.details", _JOINED, ["order_id", "line_number"],
         ["quantity", "price", "discount", "return_flag", "ship_date", "product_name",
          "category_name", "supplier_name", "'none'", "'0'"]),
]), _evolved_documents)


def _evolved_graph(ds: T.Dataset) -> DataFrame:
    def labelled(e: str) -> DataFrame:
        return ds[e].withColumn("_label", F.array_join("_labels", ","))

    parts = [
        T.listing(labelled("products"), "products", ["id"],
                  ["_label", "name", "product_type", "size", "unit_price", "category_name"]),
        T.listing(labelled("customers"), "customers", ["id"], ["_label", "customer_name"]),
        T.listing(labelled("accounts"), "accounts", ["id"], ["_label", "balance"]),
        T.listing(labelled("segments"), "segments", ["id"], ["_label"]),
        T.listing(labelled("suppliers"), "suppliers", ["id"],
                  ["_label", "supplier_name", "supplier_balance"]),
        T.listing(labelled("orders"), "orders", ["id"],
                  ["_label", "order_status", "order_total", "order_date", "priority", "stage"]),
    ]
    for e in ("LOCATED_IN", "LIVES_IN", "BASED_IN", "PURCHASED", "SUPPLIES", "HAS_ACCOUNT",
              "IN_SEGMENT"):
        parts.append(T.listing(ds[e], e, ["src", "dst"], ["src"]))
    parts.append(T.listing(ds["CONTAINS"], "CONTAINS", ["src", "dst", "line_number", "supplier_id"],
                           T.TABLE_LISTING["order_details"][1]))
    return T.listings(parts)


_direction("g2g", GIVEN, " UNION ALL ".join([
    _row("products", _WITH_CATEGORY, ["product_id"],
         ["'products'", "product_name", "product_type", "size", "unit_price", "category_name"]),
    _row("customers", "t_customers", ["customer_id"], ["'customers'", "customer_name"]),
    _row("accounts", "t_customers", ["customer_id"],
         ["'accounts'", "customer_balance"]),
    _row("segments", "(SELECT DISTINCT segment FROM t_customers)", ["segment"], ["'segments'"]),
    _row("suppliers", "t_suppliers", ["supplier_id"],
         ["'suppliers,Vendor'", "supplier_name", "supplier_balance"]),
    _row("orders", "t_orders", ["order_id"],
         ["'orders'", "order_status", "total", "order_date", "priority", "'new'"]),
    *[_row(n, t, [a, b], [a]) for n, (t, a, b) in _EDGE_SQL.items() if n != "PART_OF"],
    _row("HAS_ACCOUNT", "t_customers", ["customer_id", "customer_id"], ["customer_id"]),
    _row("IN_SEGMENT", "t_customers", ["customer_id", "segment"], ["customer_id"]),
    _row("CONTAINS", _LINKED_DETAILS, ["order_id", "product_id", "line_number", "supplier_id"],
         T.TABLE_LISTING["order_details"][1]),
]), _evolved_graph)


def _evolved_wide(ds: T.Dataset) -> DataFrame:
    return T.listings([
        T.listing(ds["products"], "products", ["product_id"],
                  ["name", "product_type", "size", "unit_price", "category_name"]),
        T.listing(ds["customers"], "customers", ["customer_id"], ["customer_name", "nation_id"]),
        T.listing(ds["customer_accounts"], "customer_accounts", ["segment", "customer_id"],
                  ["customer_balance"]),
        T.listing(ds["orders"], "orders", ["order_date", "customer_id", "order_id"],
                  ["order_status", "total", "priority", "stage"]),
        T.listing(ds["order_details"], "order_details", *T.TABLE_LISTING["order_details"]),
    ])


_direction("c2c", GIVEN, " UNION ALL ".join([
    _row("products", _WITH_CATEGORY, ["product_id"],
         ["product_name", "product_type", "size", "unit_price", "category_name"]),
    _row("customers", "t_customers", ["customer_id"], ["customer_name", "nation_id"]),
    _row("customer_accounts", "t_customers", ["segment", "customer_id"], ["customer_balance"]),
    _row("orders", "t_orders", ["order_date", "customer_id", "order_id"],
         ["order_status", "total", "priority", "'new'"]),
    _row("order_details", "t_order_details", *T.TABLE_LISTING["order_details"]),
]), _evolved_wide)
