"""Queries for comparison, round trips, step logs and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.dataset import LOG_SCHEMA, Dataset, run_steps, step
from modelshift.functions import checks as C
from modelshift.operators import compare as cmp
from modelshift.operators import graph as G
from modelshift.operators.rules import Check, Contract, Existence, Key, Reference
from modelshift.plans import trade
from modelshift.plans.registry import query, read
from modelshift.plans.rule_queries import _is_key, _union
from modelshift.plans.structure_queries import deep_orders
from modelshift.session import new_folder, remove_folder
from modelshift.sources import models


def altered_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts without the promoted ones, small ones dearer by one, and no brand column."""
    part = read(spark, d, "part").where("p_type <> 'PROMO'").drop("p_brand")
    dearer = F.when(F.col("p_size") < 10, F.col("p_retailprice") + 1)
    return part.withColumn("p_retailprice", F.coalesce(dearer, "p_retailprice"))


@query("dataset_diff", """
    WITH t AS (SELECT count(*) FILTER (WHERE p_type = 'PROMO') AS gone,
                      count(*) FILTER (WHERE p_type <> 'PROMO' AND p_size < 10) AS dearer,
                      count(*) AS n FROM part)
    SELECT 'part' AS entity, v.item, CAST(v.missing AS BIGINT) AS missing,
           CAST(v.extra AS BIGINT) AS extra, CAST(v.changed AS BIGINT) AS changed, v.note
    FROM t, LATERAL (VALUES ('rows', gone, 0, 0, ''), ('p_name', 0, 0, 0, ''),
                            ('p_type', 0, 0, 0, ''), ('p_size', 0, 0, 0, ''),
                            ('p_retailprice', 0, 0, dearer, ''),
                            ('p_brand', n, 0, 0, 'column missing'))
         v(item, missing, extra, changed, note)
""")
def dataset_diff(spark: SparkSession, d: str) -> DataFrame:
    return cmp.dataset_diff(altered_parts(spark, d), read(spark, d, "part"), ["p_partkey"], "part")


@query("bag_diff", """
    WITH a AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1, 2),
         b AS (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_retailprice > 950 GROUP BY 1, 2)
    SELECT p_name, p_type, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus
    FROM a FULL JOIN b USING (p_name, p_type) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
""")
def bag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Without a key: which rows either side has more often."""
    part = read(spark, d, "part")
    return cmp.bag_diff(
        part.where("p_size > 5").select("p_name", "p_type"),
        part.where("p_retailprice > 950").select("p_name", "p_type"),
    )


CONTRACT = Contract((
    Key("orders", ("o_orderkey",)),
    Key("customer", ("c_custkey",)),
    Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Existence("customer", "c_mktsegment"),
))


@query("contract_diff", """
    SELECT 'orders' AS entity, 'primary(o_orderkey)' AS rule, 'both' AS side, 'none' AS severity,
           CAST(0 AS BIGINT) AS actual_violations, CAST(0 AS BIGINT) AS expected_violations
    UNION ALL SELECT 'customer', 'primary(c_custkey)', 'actual', 'error', 0, NULL
    UNION ALL SELECT 'customer', 'unique(c_mktsegment)', 'expected', 'error', NULL,
                     count(*) - count(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 'orders', 'reference(o_custkey)->customer(c_custkey)', 'both', 'none',
                     (SELECT count(*) FROM orders WHERE NOT EXISTS
                         (SELECT 1 FROM customer WHERE c_custkey = o_custkey)),
                     (SELECT count(*) FROM orders WHERE NOT EXISTS
                         (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0))
    UNION ALL SELECT 'customer', 'existence(c_mktsegment)', 'actual', 'error', 0, NULL
    UNION ALL SELECT 'orders', 'check(o_totalprice large)', 'expected', 'error', NULL,
                     count(*) FILTER (WHERE o_totalprice < 1000) FROM orders
""")
def contract_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two contracts, each measured on its own data; the expected data lacks poor customers."""
    actual = {"orders": read(spark, d, "orders"), "customer": read(spark, d, "customer")}
    wanted = Contract((
        Key("orders", ("o_orderkey",)),
        Reference("orders", ("o_custkey",), "customer", ("c_custkey",)),
        Check("orders", "o_totalprice", "large", C.compare(">=", 1000)),
    ))
    rich = {**actual, "customer": actual["customer"].where("c_acctbal > 0")}
    expected = cmp.contract_diff(actual, CONTRACT, rich, wanted)
    segments = cmp.contract_diff(
        actual, Contract(), actual, Contract((Key("customer", ("c_mktsegment",), "unique"),))
    )
    return expected.unionByName(segments)


@query("fingerprint", """
    SELECT 'same' AS pair, (SELECT count(*) FROM lineitem) AS left_rows,
           (SELECT count(*) FROM lineitem) AS right_rows, true AS equal
    UNION ALL
    SELECT 'altered', (SELECT count(*) FROM part), (SELECT count(*) FROM part),
           NOT EXISTS (SELECT 1 FROM part WHERE p_size < 10)
""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Lines in another row and column order are the same; changed prices are not."""
    lines, part = read(spark, d, "lineitem"), read(spark, d, "part")
    shuffled = lines.select(*reversed(lines.columns)).repartition("l_suppkey")
    dearer = part.withColumn(
        "p_retailprice", F.when(F.col("p_size") < 10, F.col("p_retailprice") + 1)
        .otherwise(F.col("p_retailprice")))
    return _union([
        cmp.same_rows(lines, shuffled).select(F.lit("same").alias("pair"), "*"),
        cmp.same_rows(part, dearer).select(F.lit("altered").alias("pair"), "*"),
    ])


@query("round_trip", """
    SELECT l_orderkey AS order_id, l_linenumber, l_quantity, p_name, p_brand,
           CAST(o_orderdate AS DATE) AS order_date
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey
""")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Order documents written as JSON and read back under their declared schema."""
    docs = deep_orders(spark, d).withColumnRenamed("o_orderkey", "_id")
    folder = new_folder(spark, "json")
    models.write_documents(docs, folder)
    back = models.read_documents(spark, folder, docs.schema)
    return back.select("_id", "o_orderdate", F.explode("details").alias("x")).select(
        F.col("_id").alias("order_id"), "x.l_linenumber", "x.l_quantity", "x.product.p_name",
        "x.product.category.p_brand", F.col("o_orderdate").cast("date").alias("order_date"),
    )


@query("round_trip_diff", """
    SELECT true AS same_count, true AS equal
""")
def round_trip_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = deep_orders(spark, d)
    folder = new_folder(spark, "json")
    models.write_documents(docs, folder)
    back = models.read_documents(spark, folder, docs.schema)
    return cmp.same_rows(docs, back).select(
        (F.col("left_rows") == F.col("right_rows")).alias("same_count"), "equal")


@query("integrity", """
    SELECT 'orders' AS entity, 'primary(order_id)' AS rule, count(*) AS n_rows, 0 AS violations,
           true AS passed FROM orders
    UNION ALL SELECT 'customers', 'primary(customer_id)', count(*), 0, true FROM customer
    UNION ALL SELECT 'order_details', 'primary(order_id,line_number)', count(*),
                     count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
                     count(*) = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
              FROM lineitem
    UNION ALL SELECT 'orders', 'reference(customer_id)->customers(customer_id)', count(*),
                     count(*) - count(o_custkey), count(*) = count(o_custkey) FROM orders
    UNION ALL SELECT 'order_details', 'reference(order_id)->orders(order_id)', count(*), 0, true
              FROM lineitem
    UNION ALL SELECT 'order_details', 'reference(product_id)->products(product_id)', count(*),
                     count(*) - count(p_partkey), count(*) = count(p_partkey)
              FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_type <> 'PROMO'
""")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Promoted products are missing and the line number alone is no key."""
    ds = trade.relational(spark, d)
    frames = {**ds.frames, "products": ds["products"].where("product_type <> 'PROMO'")}
    rules = Contract((
        Key("orders", ("order_id",)),
        Key("customers", ("customer_id",)),
        Key("order_details", ("order_id", "line_number")),
        Reference("orders", ("customer_id",), "customers", ("customer_id",)),
        Reference("order_details", ("order_id",), "orders", ("order_id",)),
        Reference("order_details", ("product_id",), "products", ("product_id",)),
        Check("orders", "total", "positive", C.compare(">", 0)),
    ))
    return cmp.integrity(frames, rules)


@query("step_log", """
    SELECT 1 AS step, 'split' AS op, 'customers' AS entity, 'ok' AS status, '' AS reason,
           count(*) AS n_rows FROM customer
    UNION ALL SELECT 1, 'split', 'accounts', 'ok', '', count(*) FROM customer
    UNION ALL SELECT 2, 'add_entity', 'segments', 'ok', '', count(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 3, 'delete_property', '', 'skipped',
                     'customers: no field ''no_such_column''', NULL
    UNION ALL SELECT 4, 'nest', 'orders', 'ok', '', count(*) FROM orders
    UNION ALL SELECT 5, 'delete_rows', 'orders', 'ok', '',
                     count(*) FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 6, 'rename_property', 'orders', 'ok', '',
                     count(*) FROM orders WHERE o_orderstatus <> 'F'
""")
def step_log(spark: SparkSession, d: str) -> DataFrame:
    """What each step did; rows are counted while the results are written."""
    ds = trade.relational(spark, d)
    keep = ("customers", "orders")
    ds = Dataset({k: ds[k] for k in keep}, Contract(tuple(
        r for e in keep for r in ds.contract.of(e, Key))))
    steps = [
        step("split", "customers", {"customers": ["customer_id", "customer_name"],
                                    "accounts": ["customer_id", "customer_balance", "segment"]}),
        step("add_entity", "segments", source="accounts", columns={"segment": "segment"}),
        step("delete_property", "customers.no_such_column"),
        step("nest", "customers", "orders.customer", {"customer_id": "customer_id"},
             ["customer_name"]),
        step("delete_rows", "orders", F.col("order_status") == "F"),
        step("rename_property", "orders.total", "amount"),
    ]
    names = ("customers", "accounts", "segments", "orders")
    ds, log = run_steps(ds, steps, observe=names, strict=False)
    folder = new_folder(spark, "migrated")
    for n in names:
        ds[n].write.parquet(f"{folder}/{n}")
    return spark.createDataFrame(log.rows(names), LOG_SCHEMA)


_RECONCILED = {
    "regions": "region", "nations": "nation", "suppliers": "supplier", "customers": "customer",
    "products": "part", "orders": "orders", "order_details": "lineitem",
}


@query("reconcile", " UNION ALL ".join(
    f"SELECT '{e}' AS entity, count(*) AS source_rows, count(*) AS target_rows, "
    f"CAST(0 AS BIGINT) AS keys_lost, CAST(0 AS BIGINT) AS keys_invented, "
    f"CAST(0 AS BIGINT) AS rows_changed, 'ok' AS verdict FROM {t}"
    for e, t in _RECONCILED.items()
) + """
    UNION ALL SELECT 'altered products', count(*), count(*) FILTER (WHERE p_type <> 'PROMO'),
           count(*) FILTER (WHERE p_type = 'PROMO'), 0,
           count(*) FILTER (WHERE p_type <> 'PROMO' AND p_size < 10), 'rows lost' FROM part
""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Tables to graph and back again, entity by entity; then a migration that went wrong."""
    before = trade.relational(spark, d)
    after = trade.migrate(spark, d, "g2r")
    keys = {k.entity: list(k.columns) for k in trade.KEYS}
    rows = [cmp.reconcile(e, before[e], after[e], keys[e]) for e in _RECONCILED]
    rows.append(cmp.reconcile(
        "altered products", read(spark, d, "part"), altered_parts(spark, d), ["p_partkey"]))
    return _union(rows).select(
        "entity", *[F.col(c).cast("bigint").alias(c) for c in (
            "source_rows", "target_rows", "keys_lost", "keys_invented", "rows_changed")], "verdict")


@query("edge_cardinality", """
    WITH f AS (SELECT CASE WHEN min(n) >= 1 THEN '1' ELSE '0' END || '..' ||
                      CASE WHEN max(n) > 1 THEN 'n' ELSE '1' END AS up
               FROM (SELECT (SELECT count(*) FROM customer WHERE c_custkey = o_custkey) AS n FROM orders)),
         s AS (SELECT CASE WHEN min(n) >= 1 THEN '1' ELSE '0' END || '..' ||
                      CASE WHEN max(n) > 1 THEN 'n' ELSE '1' END AS down
               FROM (SELECT count(o_orderkey) AS n FROM customer
                     LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey))
    SELECT 'target_end' AS reference_end, 'source_end' AS edge_end, up AS reference, up AS edge,
           true AS kept FROM f
    UNION ALL SELECT 'source_end', 'target_end', down, down, true FROM s
""")
def edge_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """PURCHASED runs from customer to order, against the reference, so the ends swap."""
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    edges = G.edges_from_reference(orders, ["o_orderkey"], ["o_custkey"], from_parent=True)
    return cmp.edge_cardinality(orders, ["o_orderkey"], ["o_custkey"], customers, ["c_custkey"],
                                edges, from_parent=True)


@query("entity_summary", """
    SELECT 'customers' AS entity, count(*) AS n_rows, 5 AS n_columns, 'customer_id' AS key,
           1 AS n_references, 0 AS n_nested FROM customer
    UNION ALL SELECT 'orders', count(*), 6, 'order_id', 1, 0 FROM orders
    UNION ALL SELECT 'order_details', count(*), 11, 'order_id,line_number,product_id,supplier_id', 3, 0
              FROM lineitem
    UNION ALL SELECT 'categories', count(DISTINCT p_brand), 2, 'category_id', 0, 0 FROM part
    UNION ALL SELECT 'products', count(*), 6, 'product_id', 1, 0 FROM part
    UNION ALL SELECT 'suppliers', count(*), 4, 'supplier_id', 1, 0 FROM supplier
    UNION ALL SELECT 'nations', count(*), 3, 'nation_id', 1, 0 FROM nation
    UNION ALL SELECT 'regions', count(*), 2, 'region_id', 0, 0 FROM region
""")
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    from modelshift.operators.profile import entity_summary as summary

    ds = trade.relational(spark, d)
    return summary(ds.frames, ds.contract)


@query("contract_check", """
    SELECT 'order_details' AS entity,
           'reference(supplier_id)->suppliers(supplier_id)' AS rule, 'error' AS severity,
           count(*) AS n_rows, 0 AS violations FROM lineitem
    UNION ALL SELECT 'order_details', 'check(quantity few)', 'error', count(*),
                     count(*) FILTER (WHERE l_quantity > 40) FROM lineitem
    UNION ALL SELECT 'order_details', 'check(discount small)', 'error', count(*),
                     count(*) FILTER (WHERE l_discount >= 0.05) FROM lineitem
    UNION ALL SELECT 'suppliers', 'primary(supplier_id)', 'error', count(*), 0 FROM supplier
""")
def contract_check(spark: SparkSession, d: str) -> DataFrame:
    ds = trade.relational(spark, d)
    ds = Dataset({n: ds[n] for n in ("order_details", "suppliers")})
    ds = ds.add_key("suppliers", ["supplier_id"])
    ds = ds.add_reference("order_details", ["supplier_id"], "suppliers", ["supplier_id"])
    ds = ds.add_check("order_details.quantity", "few", C.compare("<=", 40))
    ds = ds.add_check("order_details.discount", "small", C.compare("<", 0.05))
    return ds.check()


PROPOSED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}


def _proposed_sql() -> str:
    rows = []
    for table, cols in PROPOSED.items():
        for i, c in enumerate(cols):
            earlier = " OR ".join(_is_key(table, (x,)) for x in cols[:i]) or "false"
            rows.append(
                f"SELECT '{table}' AS entity, CASE WHEN {earlier} THEN 'unique({c})' "
                f"ELSE 'primary({c})' END AS rule WHERE {_is_key(table, (c,))}")
    pairs = [(t, c, u, x) for t, cs in PROPOSED.items() for c in cs
             for u, xs in PROPOSED.items() for x in xs
             if t != u and c.endswith("name") == x.endswith("name")]
    for t, c, u, x in pairs:
        rows.append(
            f"SELECT '{t}', 'reference({c})->{u}({x})' WHERE {_is_key(u, (x,))} "
            f"AND NOT EXISTS (SELECT {c} FROM {t} EXCEPT SELECT {x} FROM {u})")
    return " UNION ALL ".join(rows)


@query("proposed_contract", _proposed_sql())
def proposed_contract(spark: SparkSession, d: str) -> DataFrame:
    """Keys and references proposed by the data alone; chance inclusions show up too."""
    from modelshift.operators.discovery import proposed_contract as propose

    rules = propose({t: read(spark, d, t).select(*cols) for t, cols in PROPOSED.items()})
    return spark.createDataFrame(
        [(r.entity, r.name) for r in rules.rules], "entity string, rule string")


_SAVED = {
    "relational": ["regions", "nations", "categories", "suppliers", "customers", "products",
                   "orders", "order_details"],
    "document": ["customers", "orders"],
    "graph": ["customers", "orders", "PURCHASED", "CONTAINS"],
    "wide_column": ["orders", "order_details"],
}


@query("round_trip_models", " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{e}' AS entity, true AS same_count, true AS equal"
    for m, es in _SAVED.items() for e in es
))
def round_trip_models(spark: SparkSession, d: str) -> DataFrame:
    """Datasets of all four models, written in their own form, read back and compared.

    Each is compared and deleted before the next is written, so that one lies on disk at a time."""
    sources = {
        "relational": trade.relational, "document": trade.documents, "graph": trade.graph,
        "wide_column": trade.wide,
    }
    rows = []
    for model, make in sources.items():
        ds = make(spark, d)
        folder = new_folder(spark, "dataset")
        models.save_dataset(ds, folder)
        back = models.load_dataset(ds, folder)
        rows += _union([
            cmp.same_rows(ds[e], back[e]).select(
                F.lit(model).alias("model"), F.lit(e).alias("entity"),
                (F.col("left_rows") == F.col("right_rows")).alias("same_count"), "equal")
            for e in _SAVED[model]]).collect()
        remove_folder(spark, folder)
    return spark.createDataFrame(rows, "model string, entity string, same_count boolean, equal boolean")
