"""The trading domain in four models, and the step lists between them.

The relational form is made from the given tables: customers order products from suppliers;
products have a category, customers and suppliers a nation, nations a region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.dataset import Dataset, Step, run_steps, step
from modelshift.functions import paths as P
from modelshift.functions.keys import natural_key
from modelshift.operators.rules import Contract, Key, Reference
from modelshift.plans.registry import read
from modelshift.session import new_folder
from modelshift.sources import models

#: Column that numbers the parts of an order document with very many details.
PART = "part"
PER_PART = 100_000  # elements of one array

# Given column names and the names they have in the domain.
COLUMNS = {
    "regions": ("region", {"r_regionkey": "region_id", "r_name": "region_name"}),
    "nations": (
        "nation",
        {"n_nationkey": "nation_id", "n_name": "nation_name", "n_regionkey": "region_id"},
    ),
    "suppliers": (
        "supplier",
        {"s_suppkey": "supplier_id", "s_name": "supplier_name", "s_acctbal": "supplier_balance",
         "s_nationkey": "nation_id"},
    ),
    "customers": (
        "customer",
        {"c_custkey": "customer_id", "c_name": "customer_name", "c_acctbal": "customer_balance",
         "c_mktsegment": "segment", "c_nationkey": "nation_id"},
    ),
    "products": (
        "part",
        {"p_partkey": "product_id", "p_name": "product_name", "p_type": "product_type",
         "p_size": "size", "p_retailprice": "unit_price", "p_brand": "category_name"},
    ),
    "orders": (
        "orders",
        {"o_orderkey": "order_id", "o_orderstatus": "order_status", "o_totalprice": "total",
         "o_orderdate": "order_date", "o_orderpriority": "priority", "o_custkey": "customer_id"},
    ),
    "order_details": (
        "lineitem",
        {"l_orderkey": "order_id", "l_linenumber": "line_number", "l_partkey": "product_id",
         "l_suppkey": "supplier_id", "l_quantity": "quantity", "l_extendedprice": "price",
         "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag",
         "l_linestatus": "line_status", "l_shipdate": "ship_date"},
    ),
}

KEYS = (
    Key("regions", ("region_id",)),
    Key("nations", ("nation_id",)),
    Key("categories", ("category_id",)),
    Key("suppliers", ("supplier_id",)),
    Key("customers", ("customer_id",)),
    Key("products", ("product_id",)),
    Key("orders", ("order_id",)),
    Key("order_details", ("order_id", "line_number", "product_id", "supplier_id")),
)

REFERENCES = (
    Reference("nations", ("region_id",), "regions", ("region_id",)),
    Reference("suppliers", ("nation_id",), "nations", ("nation_id",)),
    Reference("customers", ("nation_id",), "nations", ("nation_id",)),
    Reference("products", ("category_id",), "categories", ("category_id",)),
    Reference("orders", ("customer_id",), "customers", ("customer_id",)),
    Reference("order_details", ("order_id",), "orders", ("order_id",)),
    Reference("order_details", ("product_id",), "products", ("product_id",)),
    Reference("order_details", ("supplier_id",), "suppliers", ("supplier_id",)),
)


def relational(spark: SparkSession, folder: str) -> Dataset:
    """The eight tables; categories are the distinct brands under a surrogate key."""
    frames = {}
    for entity, (source, names) in COLUMNS.items():
        df = read(spark, folder, source)
        frames[entity] = df.select(*[P.column(c).alias(n) for c, n in names.items()])
    brands = frames["products"]
    key = natural_key(F.col("category_name"))
    frames["products"] = brands.withColumn("category_id", key).drop("category_name")
    frames["categories"] = (
        brands.select("category_name").distinct().select(key.alias("category_id"), "category_name")
    )
    return Dataset(frames, Contract(KEYS + REFERENCES))


#: Entities other entities refer to; their keys must be unique for a nest or a merge.
PARENTS = ("regions", "nations", "categories", "suppliers", "customers", "products", "orders")


# --- relational and document ---------------------------------------------------------

DETAIL_FIELDS = ["line_number", "quantity", "price", "discount", "tax", "return_flag",
                 "line_status", "ship_date"]
PRODUCT_KEY = ["product_name", "product_type", "size", "unit_price", "category.category_name"]
SUPPLIER_KEY = ["supplier_name", "account.supplier_balance", "nation.nation_name"]
PRODUCT_FIELDS = ["product_name", "product_type", "size", "unit_price"]


def tables_to_documents() -> list[Step]:
    """Embed everything an order needs, deepest first; keys of embedded rows are dropped."""
    return [
        step("cast_entity", "orders", "document"),
        step("cast_entity", "customers", "document"),
        step("prove_keys", "regions", "nations", "categories", "products", "suppliers"),
        step("unflatten", "customers", ["customer_balance", "segment"], "account"),
        step("unflatten", "suppliers", ["supplier_balance"], "account"),
        step("unflatten", "orders", ["order_status", "priority"], "state"),
        step("nest", "regions", "nations.region", {"region_id": "region_id"}, ["region_name"],
             drop_source=True),
        step("nest", "nations", "customers.nation", {"nation_id": "nation_id"},
             ["nation_name", "region"]),
        step("nest", "nations", "suppliers.nation", {"nation_id": "nation_id"},
             ["nation_name", "region.region_name"], drop_source=True),
        # Small, but Spark takes a join for as large as its sides' product; a file it can measure.
        step("store", "suppliers"),
        step("nest", "categories", "products.category", {"category_id": "category_id"},
             ["category_name"], drop_source=True),
        step("nest", "products", "order_details.product", {"product_id": "product_id"},
             [*PRODUCT_FIELDS, "category"], drop_source=True),
        step("deal", "order_details", ["order_id"]),
        step("nest", "suppliers", "order_details.supplier", {"supplier_id": "supplier_id"},
             ["supplier_name", "account", "nation"], drop_source=True),
        step("nest", "order_details", "orders.details", {"order_id": "order_id"},
             [*DETAIL_FIELDS, "product", "supplier"], part_column=PART, elements_per_part=PER_PART, drop_source=True,
             dealt=True),
        step("rename_property", "customers.customer_id", "_id"),
        step("cast_constraint", "customers", ["_id"], "document_id"),
        step("rename_property", "orders.order_id", "_id"),
        step("delete_reference", "orders", ["customer_id"]),
        step("add_reference", "orders", ["customer_id"], "customers", ["_id"], enforced=False),
    ]


def documents_to_tables() -> list[Step]:
    """Take the documents apart again. Embedded rows carry no keys, so each gets a surrogate
    over its natural columns, and its holder keeps the same value as the reference.

    Products and suppliers leave first, straight from the stored documents: each is a scan
    of its own nested columns alone."""
    return [
        step("unnest", "orders.details.product", "products", key="product_id",
             key_from=PRODUCT_KEY, distinct=True, keep=True),
        step("unnest", "orders.details.supplier", "suppliers", key="supplier_id",
             key_from=SUPPLIER_KEY, distinct=True, keep=True),
        # Both are distincts over all details, and more entities are taken from them.
        step("store", "products", "suppliers"),
        step("unnest", "orders.details", "order_details",
             [*DETAIL_FIELDS, "product", "supplier"], {"_id": "order_id"}, part_column=PART),
        step("link", "order_details.product", "products", "product_id", "product_id", PRODUCT_KEY),
        step("link", "order_details.supplier", "suppliers", "supplier_id", "supplier_id",
             SUPPLIER_KEY),
        step("join_parts", "orders", PART),
        step("unnest", "products.category", "categories", key="category_id",
             link="category_id", distinct=True),
        step("unnest", "suppliers.nation", "supplier_nations", key="nation_id", link="nation_id",
             key_from=["nation_name", "region.region_name"], distinct=True),
        step("unnest", "customers.nation", "customer_nations", key="nation_id", link="nation_id",
             key_from=["nation_name", "region.region_name"], distinct=True),
        # Nations hang below customers and suppliers; both lists together are the entity.
        step("merge", "customer_nations", "supplier_nations", "nations", ["nation_id"]),
        step("unnest", "nations.region", "regions", key="region_id", link="region_id",
             distinct=True),
        step("flatten", "customers.account"),
        step("rename_property", "customers.account_customer_balance", "customer_balance"),
        step("rename_property", "customers.account_segment", "segment"),
        step("flatten", "suppliers.account"),
        step("rename_property", "suppliers.account_supplier_balance", "supplier_balance"),
        step("flatten", "orders.state"),
        step("rename_property", "orders.state_order_status", "order_status"),
        step("rename_property", "orders.state_priority", "priority"),
        step("cast_entity", "customers", "relational"),
        step("cast_entity", "orders", "relational"),
        step("rename_property", "customers._id", "customer_id"),
        step("cast_constraint", "customers", ["customer_id"], "primary"),
        step("rename_property", "orders._id", "order_id"),
        step("add_key", "order_details",
             ["order_id", "line_number", "product_id", "supplier_id"]),
        step("add_reference", "orders", ["customer_id"], "customers", ["customer_id"]),
    ]


# --- relational and graph ------------------------------------------------------------

#: Edge type, from, to, and the entity and column that hold the reference.
EDGES = (
    ("LOCATED_IN", "nations", "regions", "nations", "region_id"),
    ("LIVES_IN", "customers", "nations", "customers", "nation_id"),
    ("BASED_IN", "suppliers", "nations", "suppliers", "nation_id"),
    ("PART_OF", "products", "categories", "products", "category_id"),
    ("PURCHASED", "customers", "orders", "orders", "customer_id"),
)
VERTICES = ("regions", "nations", "categories", "suppliers", "customers", "products", "orders")


def tables_to_graph() -> list[Step]:
    """References become edges before their columns go; details become edges with properties."""
    steps = [
        step("add_edge", name, src, dst, holder=holder, reference=[col], drop_reference=True)
        for name, src, dst, holder, col in EDGES
    ]
    steps += [
        step("add_entity", "SUPPLIES", source="order_details",
             columns={"supplier_id": "supplier_id", "product_id": "product_id"}),
        step("transform_to_relationship", "SUPPLIES", ("suppliers", ["supplier_id"]),
             ("products", ["product_id"])),
        step("transform_to_relationship", "order_details", ("orders", ["order_id"]),
             ("products", ["product_id"])),
        step("rename_entity", "order_details", "CONTAINS"),
    ]
    for v in VERTICES:
        steps.append(step("cast_entity", v, "graph"))
    return steps


def graph_to_tables() -> list[Step]:
    """Edges become reference columns again, edges with properties become an entity."""
    steps = [step("edge_to_reference", name, holder, col) for name, _, _, holder, col in EDGES]
    steps += [step("cast_entity", v, "relational") for v in VERTICES]
    steps += [
        step("delete_entity", "SUPPLIES"),
        step("transform_to_entity", "CONTAINS", "detail_id"),
        step("rename_entity", "CONTAINS", "order_details"),
        step("rename_property", "order_details.src", "order_id"),
        step("rename_property", "order_details.dst", "product_id"),
        step("delete_key", "order_details", ["detail_id"]),
        step("delete_property", "order_details.detail_id"),
        step("add_key", "order_details",
             ["order_id", "line_number", "product_id", "supplier_id"]),
    ]
    parents = {"region_id": "regions", "nation_id": "nations", "category_id": "categories",
               "customer_id": "customers"}
    for _, _, _, holder, col in EDGES:
        steps.append(step("add_reference", holder, [col], parents[col], [col]))
    for col, parent in (("order_id", "orders"), ("product_id", "products"),
                        ("supplier_id", "suppliers")):
        steps.append(step("add_reference", "order_details", [col], parent, [col]))
    return steps


# --- wide-column ---------------------------------------------------------------------

#: Partition and clustering columns per wide-column table; others partition by their key.
LAYOUT: dict[str, tuple[list[str], list[str | tuple[str, str]]]] = {
    "products": (["category_id"], ["product_id"]),
    "orders": (["customer_id"], ["order_date", "order_id"]),
    "order_details": (["order_id"], ["line_number", "product_id", "supplier_id"]),
}
ENTITIES = ("regions", "nations", "categories", "suppliers", "customers", "products", "orders",
            "order_details")


def tables_to_wide() -> list[Step]:
    """References are given up; every table gets partition and clustering keys."""
    steps = [step("delete_reference", r.entity, list(r.columns)) for r in REFERENCES]
    for e in ENTITIES:
        key = next(k for k in KEYS if k.entity == e)
        partition, cluster = LAYOUT.get(e, (list(key.columns), []))
        steps += [
            step("delete_key", e, list(key.columns)),
            step("add_key", e, partition, "partition"),
        ]
        if cluster:
            names = [c if isinstance(c, str) else " ".join(c) for c in cluster]
            steps.append(step("add_key", e, names, "clustering"))
        steps.append(step("cast_entity", e, "wide_column"))
    return steps


def wide_to_tables() -> list[Step]:
    """Partition and clustering keys give way to primary keys, and references return."""
    steps = []
    for e in ENTITIES:
        key = next(k for k in KEYS if k.entity == e)
        partition, cluster = LAYOUT.get(e, (list(key.columns), []))
        steps.append(step("delete_key", e, partition, "partition"))
        if cluster:
            names = [c if isinstance(c, str) else " ".join(c) for c in cluster]
            steps.append(step("delete_key", e, names, "clustering"))
        steps += [
            step("add_key", e, list(key.columns)),
            step("cast_entity", e, "relational"),
        ]
    for r in REFERENCES:
        steps.append(step("add_reference", r.entity, list(r.columns), r.parent,
                          list(r.parent_columns), r.cardinality))
    return steps


def stored(ds: Dataset) -> Dataset:
    """Write the dataset in its model and go on from what was written."""
    spark = next(iter(ds.frames.values())).sparkSession
    folder = new_folder(spark, "dataset")
    models.save_dataset(ds, folder)
    return models.load_dataset(ds, folder)


# --- evolution within a model --------------------------------------------------------

def evolve_tables() -> list[Step]:
    """Categories into products, customers split, segments as an entity, columns changed."""
    return [
        step("merge", "categories", "products", "products", ["category_id"]),
        step("add_key", "products", ["product_id"]),
        step("delete_property", "products.category_id"),
        step("split", "customers", {
            "customers": ["customer_id", "customer_name", "nation_id"],
            "customer_accounts": ["customer_id", "customer_balance", "segment"]}),
        step("add_reference", "customer_accounts", ["customer_id"], "customers", ["customer_id"]),
        step("add_entity", "segments", source="customer_accounts",
             columns={"segment": "segment_name"}, key=["segment_name"]),
        step("add_key", "segments", ["segment_id"], natural=["segment_name"]),
        step("add_reference", "customer_accounts", ["segment"], "segments", ["segment_name"]),
        step("delete_property", "order_details.tax"),
        step("delete_property", "order_details.line_status"),
        step("add_property", "suppliers.email", "String"),
        step("rename_property", "products.product_name", "name"),
        step("rename_property", "orders.total", "order_total"),
        step("add_property", "orders.stage", "String", "new", not_null=True),
    ]


def evolve_documents() -> list[Step]:
    """Flatten inside the array, regroup customer fields, add and drop embedded parts."""
    return [
        step("flatten", "orders.details.product.category"),
        step("rename_property", "orders.details.product.category_category_name", "category_name"),
        step("unflatten", "customers", ["customer_name", "account"], "profile"),
        step("add_embedded", "orders.details.supplier.territories",
             "territory_id string, description string", "0..n"),
        step("add_embedded", "orders.state.review", "reviewer string, passed boolean", "0..1"),
        step("delete_property", "orders.details.tax"),
        step("delete_property", "orders.details.line_status"),
        step("add_property", "orders.details.supplier.email", "String", "none"),
        step("rename_property", "orders.details.product.product_name", "name"),
        step("rename_property", "orders.total", "order_total"),
        step("add_property", "orders.stage", "String", "new"),
    ]


def evolve_graph() -> list[Step]:
    """Categories into products, accounts as vertices of their own, segments, a second label."""
    return [
        step("edge_to_reference", "PART_OF", "products", "category_id"),
        step("merge", "products", "categories_plain", "products", ["category_id"]),
        step("delete_entity", "categories"),
        step("delete_property", "products.category_id"),
        step("add_entity", "accounts", source="customers",
             columns={"customer_id": "account_id", "customer_balance": "balance",
                      "segment": "segment"}, key=["account_id"]),
        step("add_entity", "segments", source="customers",
             columns={"segment": "segment"}, key=["segment"]),
        step("add_edge", "IN_SEGMENT", "accounts", "segments", holder="accounts",
             reference=["segment"], drop_reference=True),
        step("add_edge", "HAS_ACCOUNT", "accounts", "customers", holder="accounts",
             reference=["account_id"]),
        step("delete_property", "customers.customer_balance"),
        step("delete_property", "customers.segment"),
        step("cast_entity", "accounts", "graph"),
        step("cast_entity", "segments", "graph"),
        step("rename_property", "products.product_name", "name"),
        step("rename_property", "orders.total", "order_total"),
        step("add_property", "orders.stage", "String", "new"),
        step("add_label", "suppliers", "Vendor"),
    ]


def plain_categories(ds: Dataset) -> Dataset:
    """The category columns without vertex form, for merging into products."""
    frame = ds["categories"].drop("id", "_labels")
    return ds.put({"categories_plain": frame})


def evolve_wide() -> list[Step]:
    """Categories into products, customers split, orders keyed by date."""
    return [
        step("delete_key", "products", ["category_id"], "partition"),
        step("delete_key", "products", ["product_id"], "clustering"),
        step("merge", "categories", "products", "products", ["category_id"]),
        step("delete_property", "products.category_id"),
        step("add_key", "products", ["product_id"], "partition"),
        step("delete_key", "customers", ["customer_id"], "partition"),
        step("split", "customers", {
            "customers": ["customer_id", "customer_name", "nation_id"],
            "customer_accounts": ["customer_id", "customer_balance", "segment"]}),
        step("add_key", "customers", ["customer_id"], "partition"),
        step("add_key", "customer_accounts", ["segment"], "partition"),
        step("add_key", "customer_accounts", ["customer_id"], "clustering"),
        step("delete_key", "orders", ["customer_id"], "partition"),
        step("delete_key", "orders", ["order_date", "order_id"], "clustering"),
        step("add_key", "orders", ["order_date"], "partition"),
        step("add_key", "orders", ["customer_id", "order_id"], "clustering"),
        step("rename_property", "products.product_name", "name"),
        step("add_property", "orders.stage", "String", "new"),
    ]


# --- directions ----------------------------------------------------------------------

def documents(spark: SparkSession, folder: str) -> Dataset:
    """Stored documents: each use then reads only the nested columns it needs."""
    return run_steps(relational(spark, folder), tables_to_documents())[0].store()


def graph(spark: SparkSession, folder: str) -> Dataset:
    """Vertices and edges; their sources' keys are proved, so the ends of edges are too."""
    return run_steps(
        relational(spark, folder), [step("prove_keys", *PARENTS), *tables_to_graph()])[0]


def wide(spark: SparkSession, folder: str) -> Dataset:
    return run_steps(relational(spark, folder), tables_to_wide())[0]


#: For each direction how its source is made and the steps that follow.
DIRECTIONS = {
    "r2d": (relational, lambda: tables_to_documents()),
    "d2r": (documents, lambda: documents_to_tables()),
    "r2g": (relational, lambda: tables_to_graph()),
    "g2r": (graph, lambda: graph_to_tables()),
    "r2c": (relational, lambda: [*tables_to_wide(), stored]),
    "c2r": (wide, lambda: [stored, *wide_to_tables()]),
    "d2g": (documents, lambda: [*documents_to_tables(), *tables_to_graph()]),
    "g2d": (graph, lambda: [*graph_to_tables(), *tables_to_documents()]),
    "d2c": (documents, lambda: [*documents_to_tables(), *tables_to_wide()]),
    "c2d": (wide, lambda: [*wide_to_tables(), *tables_to_documents()]),
    "g2c": (graph, lambda: [*graph_to_tables(), *tables_to_wide()]),
    "c2g": (wide, lambda: [*wide_to_tables(), *tables_to_graph()]),
    "r2r": (relational, lambda: evolve_tables()),
    "d2d": (documents, lambda: evolve_documents()),
    "g2g": (graph, lambda: [plain_categories, *evolve_graph()]),
    "c2c": (wide, lambda: [*evolve_wide(), stored]),
}


def migrate(spark: SparkSession, folder: str, direction: str) -> Dataset:
    source, steps = DIRECTIONS[direction]
    return run_steps(source(spark, folder), steps())[0]


# --- one listing over all entities ---------------------------------------------------

def text(col, dtype: T.DataType):
    """A value as text that any engine prints alike: two decimals, plain dates."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = col.cast("decimal(18,2)")
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        col = col.cast("date")
    return F.coalesce(col.cast("string"), F.lit("~"))


def listing(df: DataFrame, entity: str, key: list[str], body: list[str]) -> DataFrame:
    """Rows as entity, key text and body text; paths may lie inside objects."""

    def joined(paths: list[str]):
        return F.concat_ws(
            "|", *[text(P.value(df.schema, p), P.type_at(df.schema, p)) for p in paths]
        )

    return df.select(
        F.lit(entity).alias("entity"), joined(key).alias("id"), joined(body).alias("body")
    )


def listings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Key and body columns of each relational entity in a listing.
TABLE_LISTING = {
    "regions": (["region_id"], ["region_name"]),
    "nations": (["nation_id"], ["nation_name", "region_id"]),
    "categories": (["category_id"], ["category_name"]),
    "suppliers": (["supplier_id"], ["supplier_name", "supplier_balance", "nation_id"]),
    "customers": (["customer_id"],
                  ["customer_name", "customer_balance", "segment", "nation_id"]),
    "products": (["product_id"], [*PRODUCT_FIELDS, "category_id"]),
    "orders": (["order_id"], ["order_status", "total", "order_date", "priority", "customer_id"]),
    "order_details": (["order_id", "line_number", "product_id", "supplier_id"],
                      ["quantity", "price", "discount", "tax", "return_flag", "line_status",
                       "ship_date"]),
}


def table_listing(ds: Dataset, entities: tuple[str, ...] = ENTITIES) -> DataFrame:
    return listings([listing(ds[e], e, *TABLE_LISTING[e]) for e in entities])


def document_listing(ds: Dataset) -> DataFrame:
    """Customers, orders, and every embedded detail with its product and supplier."""
    orders = ds["orders"]
    details = orders.select("_id", F.explode("details").alias("d"))
    detail = [
        "quantity", "price", "discount", "tax", "return_flag", "line_status", "ship_date",
        *[f"product.{f}" for f in PRODUCT_FIELDS], "product.category.category_name",
        "supplier.supplier_name", "supplier.account.supplier_balance",
        "supplier.nation.nation_name", "supplier.nation.region.region_name",
    ]
    return listings([
        listing(ds["customers"], "customers", ["_id"],
                ["customer_name", "account.customer_balance", "account.segment",
                 "nation.nation_name", "nation.region.region_name"]),
        listing(orders.where(f"{PART} = 0"), "orders", ["_id"],
                ["state.order_status", "total", "order_date", "state.priority", "customer_id"]),
        listing(details, "orders.details", ["_id", "d.line_number"],
                [f"d.{f}" for f in detail]),
    ])


def graph_listing(ds: Dataset) -> DataFrame:
    """All vertices with their labels and all edges with their properties."""
    parts = []
    for v in VERTICES:
        key, body = TABLE_LISTING[v]
        df = ds[v].withColumn("_label", F.array_join("_labels", ","))
        here = [c for c in body if c in df.columns]
        parts.append(listing(df, v, ["id"], ["_label", *here]))
    for name, *_ in EDGES:
        parts.append(listing(ds[name], name, ["src", "dst"], ["src"]))
    parts.append(listing(ds["SUPPLIES"], "SUPPLIES", ["src", "dst"], ["src"]))
    parts.append(
        listing(ds["CONTAINS"], "CONTAINS", ["src", "dst", "line_number", "supplier_id"],
                TABLE_LISTING["order_details"][1])
    )
    return listings(parts)
