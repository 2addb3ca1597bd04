"""Queries for the structural operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.operators import graph as G
from modelshift.operators import structural as st
from modelshift.plans.registry import query, read
from modelshift.plans.trade import listing, listings

PART = "part"
PER_PART = 100_000  # elements of one array


def orders_with_customer(spark: SparkSession, d: str) -> DataFrame:
    return st.nest_one(
        read(spark, d, "orders"), read(spark, d, "customer"), {"o_custkey": "c_custkey"},
        "customer", ["c_name", "c_mktsegment", "c_acctbal"],
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    """Parts with their brand and type as an embedded category."""
    return st.unflatten(read(spark, d, "part"), ["p_brand", "p_type"], "category")


def details_with_product(spark: SparkSession, d: str) -> DataFrame:
    return st.nest_one(
        read(spark, d, "lineitem"), products(spark, d), {"l_partkey": "p_partkey"}, "product",
        ["p_name", "p_size", "category.p_brand", "category.p_type"],
    )


def deep_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their details; each detail holds its product, which holds its category."""
    return st.nest_many(
        read(spark, d, "orders"), details_with_product(spark, d), {"o_orderkey": "l_orderkey"},
        "details", ["l_linenumber", "l_quantity", "l_suppkey", "product"], part_column=PART, elements_per_part=PER_PART,
        counted_on=read(spark, d, "lineitem"),
    )


def flat_details(spark: SparkSession, d: str) -> DataFrame:
    return st.nest_many(
        read(spark, d, "orders"), read(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"},
        "details", ["l_linenumber", "l_partkey", "l_quantity"], part_column=PART, elements_per_part=PER_PART,
    )


@query("nest_to_one", """
    SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS customer_segment,
           c_acctbal AS customer_balance
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def nest_to_one(spark: SparkSession, d: str) -> DataFrame:
    return orders_with_customer(spark, d).select(
        "o_orderkey",
        F.col("customer.c_name").alias("customer_name"),
        F.col("customer.c_mktsegment").alias("customer_segment"),
        F.col("customer.c_acctbal").alias("customer_balance"),
    )


@query("nest_to_many", """
    SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_details,
           coalesce(sum(l_quantity), 0.0) AS sum_quantity
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY o_orderkey
""")
def nest_to_many(spark: SparkSession, d: str) -> DataFrame:
    nested = flat_details(spark, d)
    quantity = F.aggregate("details", F.lit(0.0), lambda acc, x: acc + x.l_quantity)
    return nested.groupBy("o_orderkey").agg(
        F.sum(F.size("details")).cast("bigint").alias("n_details"),
        F.sum(quantity).alias("sum_quantity"),
    )


@query("nest_deep", """
    SELECT o_orderkey,
           coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS brands,
           coalesce(max(p_size), -1) AS largest
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
         LEFT JOIN part ON l_partkey = p_partkey
    GROUP BY o_orderkey
""")
def nest_deep(spark: SparkSession, d: str) -> DataFrame:
    brands = F.array_distinct(F.transform("details", lambda x: x.product.category.p_brand))
    sizes = F.array_max(F.transform("details", lambda x: x.product.p_size))
    # Parts of one order are few, and each holds at most as many brands as there are.
    return (
        deep_orders(spark, d)
        .select("o_orderkey", brands.alias("b"), sizes.alias("s"))
        .groupBy("o_orderkey")
        .agg(
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))), ",").alias("brands"),
            F.coalesce(F.max("s"), F.lit(-1)).alias("largest"),
        )
    )


@query("nest_in_array", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, s_name
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def nest_in_array(spark: SparkSession, d: str) -> DataFrame:
    nested = st.nest_many(
        read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem"),
        {"o_orderkey": "l_orderkey"}, "details",
        ["l_linenumber", "l_partkey", "l_quantity", "l_suppkey"], part_column=PART, elements_per_part=PER_PART,
    )
    linked = st.nest_in_array(
        nested, read(spark, d, "supplier"), "details", {"l_suppkey": "s_suppkey"}, "supplier",
        ["s_name"], key=["o_orderkey", PART],
    )
    return linked.select("o_orderkey", F.explode("details").alias("x")).select(
        F.col("o_orderkey").alias("l_orderkey"), "x.l_linenumber", "x.l_partkey", "x.l_quantity",
        "x.supplier.s_name",
    )


@query("unnest_object", """
    SELECT o_orderkey AS order_id, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey
""")
def unnest_object(spark: SparkSession, d: str) -> DataFrame:
    new, _ = st.unnest(
        orders_with_customer(spark, d), "customer", ["c_name", "c_mktsegment"],
        {"o_orderkey": "order_id"},
    )
    return new


@query("unnest_array", """
    SELECT l_orderkey AS order_id, l_linenumber, l_partkey, l_quantity FROM lineitem
""")
def unnest_array(spark: SparkSession, d: str) -> DataFrame:
    new, _ = st.unnest(flat_details(spark, d), "details", carry={"o_orderkey": "order_id"})
    return new


@query("unnest_recursive", """
    SELECT l_orderkey AS order_id, l_linenumber AS line_number, p_name,
           p_brand AS category_brand, p_type AS category_type
    FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def unnest_recursive(spark: SparkSession, d: str) -> DataFrame:
    new, _ = st.unnest(
        deep_orders(spark, d), "details.product", ["p_name", "category"],
        {"o_orderkey": "order_id", "details.l_linenumber": "line_number"},
    )
    return new.select(
        "order_id", "line_number", "p_name",
        F.col("category.p_brand").alias("category_brand"),
        F.col("category.p_type").alias("category_type"),
    )


@query("unnest_normalised", """
    SELECT DISTINCT md5(concat_ws('|', length(c_name) || ':' || c_name,
                                  length(c_mktsegment) || ':' || c_mktsegment)) AS customer_key,
           c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey
""")
def unnest_normalised(spark: SparkSession, d: str) -> DataFrame:
    new, _ = st.unnest(
        orders_with_customer(spark, d), "customer", ["c_name", "c_mktsegment"],
        key="customer_key", link="customer_key", distinct=True,
    )
    return new


@query("flatten", """
    SELECT o_orderkey, o_totalprice, c_name AS customer_c_name,
           c_mktsegment AS customer_c_mktsegment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def flatten(spark: SparkSession, d: str) -> DataFrame:
    return st.flatten(orders_with_customer(spark, d), "customer").select(
        "o_orderkey", "o_totalprice", "customer_c_name", "customer_c_mktsegment"
    )


@query("flatten_in_array", """
    SELECT l_orderkey AS o_orderkey, l_linenumber, p_name, p_brand AS category_p_brand,
           p_type AS category_p_type
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def flatten_in_array(spark: SparkSession, d: str) -> DataFrame:
    flat = st.flatten(deep_orders(spark, d), "details.product.category")
    return flat.select("o_orderkey", F.explode("details").alias("x")).select(
        "o_orderkey", "x.l_linenumber", "x.product.p_name", "x.product.category_p_brand",
        "x.product.category_p_type",
    )


@query("unflatten", """
    SELECT c_custkey, c_name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
""")
def unflatten(spark: SparkSession, d: str) -> DataFrame:
    out = st.unflatten(
        read(spark, d, "customer"),
        {"c_acctbal": "balance", "c_mktsegment": "segment", "no_such": "absent"}, "account",
    )
    return out.select("c_custkey", "c_name", "account.balance", "account.segment")


@query("unwind_in_place", """
    SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS embedding FROM embeddings
""")
def unwind_in_place(spark: SparkSession, d: str) -> DataFrame:
    out = st.unwind(read(spark, d, "embeddings"), "embedding")
    return out.select("vec_id", "label", F.col("embedding").cast("double").alias("embedding"))


@query("unwind_into", """
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position,
           CAST(unnest(embedding) AS DOUBLE) AS value
    FROM embeddings
""")
def unwind_into(spark: SparkSession, d: str) -> DataFrame:
    values, _ = st.unwind_into(
        read(spark, d, "embeddings"), "embedding", {"vec_id": "vec_id"}, position="position"
    )
    return values.select("vec_id", "position", F.col("value").cast("double").alias("value"))


@query("wind_wrap", """
    SELECT event_id, event_type AS only_type, 1 AS n_types FROM events
""")
def wind_wrap(spark: SparkSession, d: str) -> DataFrame:
    out = st.wind(read(spark, d, "events"), "event_type")
    return out.select(
        "event_id", F.element_at("event_type", 1).alias("only_type"),
        F.size("event_type").alias("n_types"),
    )


@query("wind_group", """
    SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n_values, min(value) AS lowest,
           max(value) AS highest
    FROM events GROUP BY user_id, event_type
""")
def wind_group(spark: SparkSession, d: str) -> DataFrame:
    lists = st.wind_group(
        read(spark, d, "events").select("user_id", "event_type", "value"), "value",
        part_column=PART, elements_per_part=PER_PART,
    )
    return lists.groupBy("user_id", "event_type").agg(
        F.sum(F.size("value")).cast("bigint").alias("n_values"),
        F.min(F.array_min("value")).alias("lowest"),
        F.max(F.array_max("value")).alias("highest"),
    )


@query("wind_unwind", """
    SELECT user_id, event_type, value FROM events
""")
def wind_unwind(spark: SparkSession, d: str) -> DataFrame:
    """UNWIND undoes a grouped WIND: every row comes back, copies included."""
    lists = st.wind_group(
        read(spark, d, "events").select("user_id", "event_type", "value"), "value",
        part_column=PART, elements_per_part=PER_PART,
    )
    return st.unwind(lists, "value").drop(PART)


@query("merge_join", """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, text, lang, source, n_chars, quality, toxic
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def merge_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return st.merge_join(docs, read(spark, d, "labels"), ["doc_id"])


@query("merge_one_to_many", """
    SELECT o_custkey, c_name, o_orderkey, o_totalprice
    FROM (SELECT c_custkey AS o_custkey, c_name FROM customer) c
         FULL JOIN orders USING (o_custkey)
""")
def merge_one_to_many(spark: SparkSession, d: str) -> DataFrame:
    """Customers merged into orders; customers without orders stay as rows of their own."""
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return st.merge_join(people, orders, ["o_custkey"])


@query("merge_union", """
    SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
    FROM customer
    UNION ALL
    SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    s = read(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return st.merge_union(c, s)


@query("split", """
    SELECT 'kinds' AS entity, p_brand AS id, p_type AS body
    FROM (SELECT DISTINCT p_brand, p_type FROM part)
    UNION ALL
    SELECT 'names', CAST(p_partkey AS VARCHAR), p_name || '|' || p_brand FROM part
    UNION ALL
    SELECT 'prices', CAST(p_partkey AS VARCHAR),
           p_size || '|' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) FROM part
""")
def split(spark: SparkSession, d: str) -> DataFrame:
    parts = st.split(
        read(spark, d, "part"),
        {"names": ["p_partkey", "p_name", "p_brand"], "kinds": ["p_brand", "p_type"],
         "prices": ["p_partkey", "p_size", "p_retailprice"]},
        distinct={"kinds"},
    )
    return listings([
        listing(parts["names"], "names", ["p_partkey"], ["p_name", "p_brand"]),
        listing(parts["kinds"], "kinds", ["p_brand"], ["p_type"]),
        listing(parts["prices"], "prices", ["p_partkey"], ["p_size", "p_retailprice"]),
    ])


@query("split_merge", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def split_merge(spark: SparkSession, d: str) -> DataFrame:
    """MERGE undoes a SPLIT whose parts keep the key."""
    parts = st.split(
        read(spark, d, "part"),
        {"a": ["p_partkey", "p_name", "p_brand"],
         "b": ["p_partkey", "p_type", "p_size", "p_retailprice"]},
    )
    return st.merge_join(parts["a"], parts["b"], ["p_partkey"])


@query("transform_to_edges", """
    SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber, l_suppkey, l_quantity, l_discount
    FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
""")
def transform_to_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount"
    )
    return G.to_edges(lines, ["l_orderkey"], ["l_partkey"])


@query("transform_to_entity", """
    SELECT md5(concat_ws('|', length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey,
                              length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey,
                              length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber,
                              length(CAST(l_suppkey AS VARCHAR)) || ':' || l_suppkey)) AS id,
           l_orderkey AS src, l_partkey AS dst, l_linenumber, l_suppkey, l_quantity
    FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
""")
def transform_to_entity(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity"
    )
    edges = G.to_edges(lines, ["l_orderkey"], ["l_partkey"])
    return G.to_entity(edges, "id", ["src", "dst", "l_linenumber", "l_suppkey"])
