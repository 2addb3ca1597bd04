"""Queries for property and entity operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.dataset import Dataset
from modelshift.functions.keys import natural_key
from modelshift.operators import graph as G
from modelshift.operators import properties as pr
from modelshift.operators.rules import Contract, Key, Reference
from modelshift.plans.registry import query, read
from modelshift.plans.structure_queries import deep_orders, orders_with_customer


@query("add_property", """
    SELECT o_orderkey, 'new' AS stage, CAST(NULL AS INTEGER) AS rating,
           c_name AS customer_name,
           CASE WHEN c_custkey IS NULL THEN NULL ELSE 'gold' END AS customer_tier
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def add_property(spark: SparkSession, d: str) -> DataFrame:
    df = pr.add_property(orders_with_customer(spark, d), "stage", "String", "new")
    df = pr.add_property(df, "rating", "Integer")
    df = pr.add_property(df, "customer.tier", "String", "gold")
    return df.select(
        "o_orderkey", "stage", "rating", F.col("customer.c_name").alias("customer_name"),
        F.col("customer.tier").alias("customer_tier"),
    )


@query("delete_property", """
    SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def delete_property(spark: SparkSession, d: str) -> DataFrame:
    df = pr.delete_property(orders_with_customer(spark, d), "customer.c_acctbal")
    for gone in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        df = pr.delete_property(df, gone)
    return df.select("o_orderkey", "customer.*")


@query("rename_property", """
    SELECT l_orderkey AS order_id, l_quantity AS amount, p_name AS title
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def rename_property(spark: SparkSession, d: str) -> DataFrame:
    """At the top, inside array elements, and inside an object of array elements."""
    df = pr.rename_property(deep_orders(spark, d), "o_orderkey", "order_id")
    df = pr.rename_property(df, "details.l_quantity", "amount")
    df = pr.rename_property(df, "details.product.p_name", "title")
    return df.select("order_id", F.explode("details").alias("x")).select(
        "order_id", "x.amount", "x.product.title"
    )


@query("copy_property", """
    SELECT o_orderkey, o_custkey, c_mktsegment AS segment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def copy_property(spark: SparkSession, d: str) -> DataFrame:
    out = pr.copy_property(
        read(spark, d, "orders"), read(spark, d, "customer"), "c_mktsegment",
        {"o_custkey": "c_custkey"}, "segment",
    )
    return out.select("o_orderkey", "o_custkey", "segment")


@query("copy_property_many", """
    SELECT c_custkey, c_name, top AS top_order
    FROM customer LEFT JOIN
         (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
         ON c_custkey = o_custkey
""")
def copy_property_many(spark: SparkSession, d: str) -> DataFrame:
    """Against the reference, an aggregate picks the value."""
    out = pr.copy_property(
        read(spark, d, "customer"), read(spark, d, "orders"), "o_totalprice",
        {"c_custkey": "o_custkey"}, "top_order", agg="max",
    )
    return out.select("c_custkey", "c_name", "top_order")


@query("move_property", """
    SELECT 'orders' AS entity, CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS segment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT 'customers', CAST(c_custkey AS VARCHAR), NULL FROM customer
""")
def move_property(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset({"orders": read(spark, d, "orders"), "customers": read(spark, d, "customer")})
    ds = ds.move_property("customers.c_mktsegment", "orders.segment", {"o_custkey": "c_custkey"})
    left = ds["orders"].select(
        F.lit("orders").alias("entity"), F.col("o_orderkey").cast("string").alias("id"), "segment"
    )
    # The moved column is gone here; a union by name shows that as null.
    right = ds["customers"].withColumnRenamed("c_mktsegment", "segment").select(
        F.lit("customers").alias("entity"), F.col("c_custkey").cast("string").alias("id"),
        *[c for c in ds["customers"].columns if c == "c_mktsegment"],
    )
    return left.unionByName(right, allowMissingColumns=True)


@query("cast_property", """
    SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, TRY_CAST(p_name AS INTEGER) AS p_name,
           CAST(p_retailprice AS DECIMAL(13,2)) AS p_retailprice
    FROM part
""")
def cast_property(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "part")
    df = pr.cast_property(df, "p_size", "String")
    df = pr.cast_property(df, "p_name", "Integer")
    df = pr.cast_property(df, "p_retailprice", "Decimal")
    return df.select("p_partkey", "p_size", "p_name", "p_retailprice")


@query("cast_losses", """
    SELECT 'url' AS path, 'int' AS new_type, count(*) AS n_values,
           count(*) FILTER (WHERE TRY_CAST(url AS INTEGER) IS NULL) AS lost FROM pages
    UNION ALL
    SELECT 'page_id', 'string', count(*), 0 FROM pages
    UNION ALL
    SELECT 'html', 'double', count(*),
           count(*) FILTER (WHERE TRY_CAST(html AS DOUBLE) IS NULL) FROM pages
""")
def cast_losses(spark: SparkSession, d: str) -> DataFrame:
    return pr.cast_losses(
        read(spark, d, "pages"), {"url": "Integer", "page_id": "String", "html": "Double"}
    )


@query("add_embedded", """
    SELECT c_custkey, true AS no_address, 0 AS n_contacts FROM customer
""")
def add_embedded(spark: SparkSession, d: str) -> DataFrame:
    df = pr.add_embedded(read(spark, d, "customer"), "address", "street string, city string")
    df = pr.add_embedded(df, "contacts", "name string, phone string", many=True)
    return df.select(
        "c_custkey", F.col("address").isNull().alias("no_address"),
        F.size("contacts").alias("n_contacts"),
    )


@query("delete_embedded", """
    SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity, l_suppkey FROM lineitem
""")
def delete_embedded(spark: SparkSession, d: str) -> DataFrame:
    df = pr.delete_embedded(deep_orders(spark, d), "details.product")
    return df.select("o_orderkey", F.explode("details").alias("x")).select("o_orderkey", "x.*")


# --- entities ------------------------------------------------------------------------

def trade_graph(spark: SparkSession, d: str) -> Dataset:
    """Customers and orders as vertices with PURCHASED edges between them."""
    ds = Dataset(
        {"customers": read(spark, d, "customer"), "orders": read(spark, d, "orders")},
        Contract((
            Key("customers", ("c_custkey",)),
            Key("orders", ("o_orderkey",)),
            Reference("orders", ("o_custkey",), "customers", ("c_custkey",)),
        )),
    )
    ds = ds.add_edge("PURCHASED", "customers", "orders", holder="orders",
                     reference=["o_custkey"], drop_reference=True)
    return ds.cast_entity("customers", "graph").cast_entity("orders", "graph")


@query("add_entity", "SELECT DISTINCT c_mktsegment AS segment_name, c_nationkey AS nation FROM customer")
def add_entity(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset({"customers": read(spark, d, "customer")})
    ds = ds.add_entity("segments", source="customers",
                       columns={"c_mktsegment": "segment_name", "c_nationkey": "nation"})
    return ds["segments"]


@query("add_edge", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IS NOT NULL")
def add_edge(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d)["PURCHASED"]


@query("add_self_edge", """
    SELECT md5(concat_ws('|', length(CAST(a.conv_id AS VARCHAR)) || ':' || a.conv_id,
                              length(CAST(a.turn AS VARCHAR)) || ':' || a.turn)) AS src,
           md5(concat_ws('|', length(CAST(b.conv_id AS VARCHAR)) || ':' || b.conv_id,
                              length(CAST(b.turn AS VARCHAR)) || ':' || b.turn)) AS dst
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn
""")
def add_self_edge(spark: SparkSession, d: str) -> DataFrame:
    """Each turn replies to the one before; edges to turns that are not there are left out."""
    turns = read(spark, d, "conversations").withColumn(
        "reply_to", F.when(F.col("turn") > 0, F.col("turn") - 1)
    )
    edges = G.edges_from_reference(turns, ["conv_id", "turn"], ["conv_id", "reply_to"])
    ids = turns.select(natural_key(F.col("conv_id"), F.col("turn")).alias("id"))
    return G.without_dangling(edges, ids, "dst")


@query("delete_entity", """
    SELECT 'order_details' AS entity, count(*) AS n_rows FROM lineitem
    UNION ALL SELECT 'orders', count(*) FROM orders
""")
def delete_entity(spark: SparkSession, d: str) -> DataFrame:
    """Deleting customers takes the edge type that touches them along."""
    ds = trade_graph(spark, d)
    ds = ds.put({"order_details": read(spark, d, "lineitem")}).delete_entity("customers")
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("entity"), "n_rows")
        for n, df in sorted(ds.frames.items())
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("delete_rows", """
    SELECT o_custkey AS src, o_orderkey AS dst
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'
""")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vertices go, and the edges that would dangle go with them."""
    ds = trade_graph(spark, d).delete_rows("customers", F.col("c_mktsegment") == "BUILDING")
    return ds["PURCHASED"]


@query("rename_entity", """
    SELECT c_custkey AS id, c_name, 'clients' AS labels, 'clients' AS edge_source FROM customer
""")
def rename_entity(spark: SparkSession, d: str) -> DataFrame:
    ds = trade_graph(spark, d).rename_entity("customers", "clients")
    return ds["clients"].select(
        "id", "c_name", F.array_join("_labels", ",").alias("labels"),
        F.lit(ds.ends["PURCHASED"].source).alias("edge_source"),
    )


@query("copy_entity", """
    SELECT 'customers_archive' AS entity, c_custkey AS a, CAST(NULL AS BIGINT) AS b FROM customer
    UNION ALL
    SELECT 'BOUGHT', o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL
""")
def copy_entity(spark: SparkSession, d: str) -> DataFrame:
    ds = trade_graph(spark, d).copy_entity("customers", "customers_archive")
    ds = ds.copy_entity("PURCHASED", "BOUGHT", ("customers_archive", "orders"))
    people = ds["customers_archive"].select(
        F.lit("customers_archive").alias("entity"), F.col("id").alias("a"),
        F.lit(None).cast("bigint").alias("b"),
    )
    edges = ds["BOUGHT"].select(
        F.lit("BOUGHT").alias("entity"), F.col("src").alias("a"), F.col("dst").alias("b")
    )
    return people.unionByName(edges)


@query("cast_entity", """
    SELECT vec_id, label, 64 AS n_values, 'embeddings' AS vertex_label FROM embeddings
""")
def cast_entity(spark: SparkSession, d: str) -> DataFrame:
    """A list column becomes JSON text in a table; the vertex form adds id and label."""
    ds = Dataset({"embeddings": read(spark, d, "embeddings")},
                 Contract((Key("embeddings", ("vec_id",)),)))
    flat = ds.cast_entity("embeddings", "relational")["embeddings"]
    ds = ds.put({"embeddings": flat}).cast_entity("embeddings", "graph")
    return ds["embeddings"].select(
        F.col("id").alias("vec_id"), "label",
        F.json_array_length("embedding").alias("n_values"),
        F.array_join("_labels", ",").alias("vertex_label"),
    )


@query("add_label", """
    SELECT c_custkey AS id,
           CASE WHEN c_acctbal > 5000 THEN 'customers,Premium' ELSE 'customers' END AS labels
    FROM customer
""")
def add_label(spark: SparkSession, d: str) -> DataFrame:
    ds = trade_graph(spark, d).add_label("customers", "Premium", F.col("c_acctbal") > 5000)
    return ds["customers"].select("id", F.array_join("_labels", ",").alias("labels"))


@query("delete_label", """
    SELECT o_orderkey AS id,
           CASE WHEN o_orderstatus = 'O' THEN 'orders,Open' ELSE 'orders' END AS labels
    FROM orders
""")
def delete_label(spark: SparkSession, d: str) -> DataFrame:
    ds = trade_graph(spark, d).add_label("orders", "Open")
    ds = ds.delete_label("orders", "Open", F.col("o_orderstatus") != "O")
    return ds["orders"].select("id", F.array_join("_labels", ",").alias("labels"))


@query("edge_to_reference", "SELECT o_orderkey, o_totalprice, o_custkey AS buyer FROM orders")
def edge_to_reference(spark: SparkSession, d: str) -> DataFrame:
    ds = trade_graph(spark, d).edge_to_reference("PURCHASED", "orders", "buyer")
    return ds["orders"].select("o_orderkey", "o_totalprice", "buyer")


__all__ = ["trade_graph"]
