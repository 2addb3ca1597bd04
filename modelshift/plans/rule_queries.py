"""Queries for keys, layout, constraints and profiling."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.dataset import Dataset
from modelshift.functions import checks as C
from modelshift.functions.keys import natural_key
from modelshift.functions.types import conform_losses
from modelshift.operators import discovery, layout
from modelshift.operators import profile as pf
from modelshift.operators import rules as R
from modelshift.operators import structural as st
from modelshift.plans.registry import SCHEMAS, query, read
from modelshift.plans.structure_queries import deep_orders
from modelshift.session import new_folder


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- keys ----------------------------------------------------------------------------

def _key_sql(name: str, table: str, cols: str) -> str:
    null = " OR ".join(f"{c.strip()} IS NULL" for c in cols.split(","))
    return f"""
    SELECT '{name}' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows,
           count(*) FILTER (WHERE NOT missing) AS n_keys,
           count(*) FILTER (WHERE NOT missing AND n > 1) AS duplicate_groups,
           CAST(coalesce(sum(n) FILTER (WHERE NOT missing AND n > 1), 0) AS BIGINT) AS duplicate_rows,
           CAST(coalesce(sum(n) FILTER (WHERE missing), 0) AS BIGINT) AS null_rows
    FROM (SELECT {cols}, count(*) AS n, ({null}) AS missing FROM {table} GROUP BY {cols})"""


def _check_keys(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return _union([
        R.check_key(df, cols).select(F.lit(name).alias("rule"), "*")
        for name, (df, cols) in frames.items()
    ])


@query("check_primary_key", " UNION ALL ".join([
    _key_sql("orders", "orders", "o_orderkey"),
    _key_sql("lines", "lineitem", "l_orderkey, l_linenumber"),
    _key_sql("lines in full", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey"),
    _key_sql("turns", "conversations", "conv_id, turn"),
]))
def check_primary_key(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    return _check_keys({
        "orders": (read(spark, d, "orders"), ["o_orderkey"]),
        "lines": (lines, ["l_orderkey", "l_linenumber"]),
        "lines in full": (lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
        "turns": (read(spark, d, "conversations"), ["conv_id", "turn"]),
    })


@query("check_unique", " UNION ALL ".join([
    _key_sql("part names", "part", "p_name"),
    _key_sql("page urls", "pages", "url"),
    _key_sql("document texts", "documents", "text"),
    _key_sql("label of documents",
             "(SELECT quality FROM documents LEFT JOIN labels USING (doc_id))", "quality"),
]))
def check_unique(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return _check_keys({
        "part names": (read(spark, d, "part"), ["p_name"]),
        "page urls": (read(spark, d, "pages"), ["url"]),
        "document texts": (docs, ["text"]),
        "label of documents": (
            docs.join(read(spark, d, "labels"), "doc_id", "left"), ["quality"]),
    })


@query("surrogate_key", """
    SELECT md5(concat_ws('|', length(p_brand) || ':' || p_brand,
                              length(p_type) || ':' || p_type)) AS kind_key, p_brand, p_type
    FROM (SELECT DISTINCT p_brand, p_type FROM part)
""")
def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    kinds = read(spark, d, "part").select("p_brand", "p_type").distinct()
    return kinds.select(
        natural_key(F.col("p_brand"), F.col("p_type")).alias("kind_key"), "p_brand", "p_type"
    )


@query("cast_constraint", """
    WITH g AS (SELECT quality, count(*) AS n
               FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality),
         t AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows,
                      CAST(sum(n - 1) FILTER (WHERE quality IS NOT NULL) AS BIGINT) AS extra,
                      CAST(coalesce(sum(n) FILTER (WHERE quality IS NULL), 0) AS BIGINT) AS nulls FROM g)
    SELECT 'unique(quality)' AS rule, n_rows, extra AS violations FROM t
    UNION ALL SELECT 'primary(quality)', n_rows, extra + nulls FROM t
    UNION ALL SELECT 'node(doc_id)', n_rows, 0 FROM t
""")
def cast_constraint(spark: SparkSession, d: str) -> DataFrame:
    """A unique key made primary must also refuse nulls."""
    docs = read(spark, d, "documents").drop("text").join(read(spark, d, "labels"), "doc_id", "left")
    ds = Dataset({"documents": docs}).add_key("documents", ["quality"], "unique")
    ds = ds.add_key("documents", ["doc_id"], "primary")
    as_unique = ds.cast_constraint("documents", ["doc_id"], "node").check()
    as_primary = ds.delete_key("documents", ["doc_id"]).cast_constraint(
        "documents", ["quality"], "primary").check()
    return as_unique.unionByName(as_primary).select("rule", "n_rows", "violations")


# --- references ----------------------------------------------------------------------

def _reference_sql(name: str, child: str, cols: str, parent: str, pcols: str) -> str:
    cs, ps = [c.strip() for c in cols.split(",")], [c.strip() for c in pcols.split(",")]
    null = " OR ".join(f"{c} IS NULL" for c in cs)
    match = " AND ".join(f"c.{c} = p.{p}" for c, p in zip(cs, ps))
    return f"""
    SELECT '{name}' AS rule, count(*) AS n_rows,
           count(*) FILTER (WHERE {null}) AS null_rows,
           count(DISTINCT CASE WHEN orphan THEN ({cols}) END) AS orphan_keys,
           count(*) FILTER (WHERE orphan) AS orphan_rows
    FROM (SELECT {cols}, NOT ({null}) AND NOT EXISTS
                 (SELECT 1 FROM {parent} p WHERE {match}) AS orphan FROM {child} c)"""


def _check_references(refs: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    return _union([
        R.check_reference(*r).select(F.lit(name).alias("rule"), "*") for name, r in refs.items()
    ])


@query("check_foreign_key", " UNION ALL ".join([
    _reference_sql("orders to customers", "orders", "o_custkey", "customer", "c_custkey"),
    _reference_sql("lines to parts in stock", "lineitem", "l_partkey",
                   "(SELECT * FROM part WHERE p_size > 10)", "p_partkey"),
    _reference_sql("lines to suppliers in credit", "lineitem", "l_suppkey",
                   "(SELECT * FROM supplier WHERE s_acctbal > 0)", "s_suppkey"),
]))
def check_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    return _check_references({
        "orders to customers": (
            read(spark, d, "orders"), ["o_custkey"], read(spark, d, "customer"), ["c_custkey"]),
        "lines to parts in stock": (
            lines, ["l_partkey"], read(spark, d, "part").where("p_size > 10"), ["p_partkey"]),
        "lines to suppliers in credit": (
            lines, ["l_suppkey"], read(spark, d, "supplier").where("s_acctbal > 0"), ["s_suppkey"]),
    })


@query("check_foreign_key_composite", _reference_sql(
    "turn to the one before",
    "(SELECT conv_id, CASE WHEN turn > 0 THEN turn - 1 END AS before FROM conversations)",
    "conv_id, before", "(SELECT * FROM conversations WHERE role <> 'system')", "conv_id, turn"))
def check_foreign_key_composite(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    before = turns.withColumn("before", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return _check_references({
        "turn to the one before": (
            before, ["conv_id", "before"], turns.where("role <> 'system'"), ["conv_id", "turn"]),
    })


@query("check_reference", """
    SELECT 'events' AS entity, 'warning' AS severity, count(*) AS n_rows,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM customer
                            WHERE c_custkey = user_id AND c_acctbal > 0)) AS violations
    FROM events WHERE user_id IS NOT NULL
""")
def check_reference(spark: SparkSession, d: str) -> DataFrame:
    """A logical reference only warns."""
    ds = Dataset({"events": read(spark, d, "events"),
                  "customers": read(spark, d, "customer").where("c_acctbal > 0")})
    ds = ds.add_reference("events", ["user_id"], "customers", ["c_custkey"], enforced=False)
    return ds.check().select("entity", "severity", "n_rows", "violations")


@query("orphans", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_partkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type <> 'PROMO')
""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    out = R.orphans(read(spark, d, "lineitem"), ["l_partkey"],
                    read(spark, d, "part").where("p_type <> 'PROMO'"), ["p_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _cardinality_sql(name: str, child: str, col: str, parent: str, pcol: str) -> str:
    return f"""
    SELECT '{name}' AS reference, tmin AS target_min, tmax AS target_max,
           smin AS source_min, smax AS source_max,
           (CASE WHEN tmin >= 1 THEN '1' ELSE '0' END) || '..' ||
           (CASE WHEN tmax > 1 THEN 'n' ELSE '1' END) AS target_end,
           (CASE WHEN smin >= 1 THEN '1' ELSE '0' END) || '..' ||
           (CASE WHEN smax > 1 THEN 'n' ELSE '1' END) AS source_end
    FROM (SELECT min(n) AS tmin, max(n) AS tmax FROM
            (SELECT (SELECT count(*) FROM {parent} p WHERE p.{pcol} = c.{col}) AS n FROM {child} c)),
         (SELECT min(n) AS smin, max(n) AS smax FROM
            (SELECT (SELECT count(*) FROM {child} c WHERE c.{col} = p.{pcol}) AS n FROM {parent} p))"""


REFERENCES = {
    "lineitem to orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lineitem to part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "orders to customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "events to customer": ("events", "user_id", "customer", "c_custkey"),
    "documents to labels": ("documents", "doc_id", "labels", "doc_id"),
    "nation to region": ("nation", "n_regionkey", "region", "r_regionkey"),
}


@query("observe_cardinality", " UNION ALL ".join(
    _cardinality_sql(n, *r) for n, r in REFERENCES.items()))
def observe_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return _union([
        R.observe_cardinality(read(spark, d, c), [cc], read(spark, d, p), [pc]).select(
            F.lit(n).alias("reference"), "*")
        for n, (c, cc, p, pc) in REFERENCES.items()
    ])


@query("recard", """
    SELECT '1..1' AS target_end, '1..n' AS source_end,
           (SELECT count(*) FROM lineitem WHERE NOT EXISTS
                (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS bad_child_rows,
           (SELECT count(*) FROM orders WHERE NOT EXISTS
                (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS bad_parent_rows
    UNION ALL
    SELECT '0..1', '0..1', 0,
           (SELECT count(*) FROM customer WHERE
                (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 1)
""")
def recard(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return _union([
        R.recard(read(spark, d, "lineitem"), ["l_orderkey"], orders, ["o_orderkey"], "1..1", "1..n"),
        R.recard(orders, ["o_custkey"], read(spark, d, "customer"), ["c_custkey"], "0..1", "0..1"),
    ])


# --- layout --------------------------------------------------------------------------

@query("partition_layout", "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2")
def partition_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.partition_sizes(read(spark, d, "events"), ["user_id", "event_type"])


@query("partition_skew", """
    SELECT count(*) AS n_partitions, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS smallest,
           max(n) AS largest
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)
""")
def partition_skew(spark: SparkSession, d: str) -> DataFrame:
    return layout.skew_report(read(spark, d, "lineitem"), ["l_partkey"])


HOT = [("documents", ["source"], 0.1), ("lineitem", ["l_returnflag", "l_linestatus"], 0.2),
       ("lineitem", ["l_suppkey"], 0.0101), ("events", ["user_id"], 0.001)]


@query("partition_hot_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS entity, concat_ws(',', {', '.join(cols)}) AS key, count(*) AS n_rows FROM {t} "
    f"GROUP BY {', '.join(cols)} HAVING count(*) >= {share} * (SELECT count(*) FROM {t})"
    for t, cols, share in HOT))
def partition_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """The partition keys that would make a partition hot, each with its exact number of rows."""
    return _union([
        layout.hot_keys(read(spark, d, t), cols, share).select(
            F.lit(t).alias("entity"), F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("key"),
            "n_rows")
        for t, cols, share in HOT])


@query("clustering_order", """
    SELECT o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position
    FROM orders
""")
def clustering_order(spark: SparkSession, d: str) -> DataFrame:
    """Each order's place within its customer, read off the written layout."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    out = layout.positions(
        orders, new_folder(spark, "clustered"), ["o_custkey"], [("o_orderdate", "desc"), "o_orderkey"]
    )
    return out.select("o_custkey", "o_orderkey", "position")


@query("clustering_check", """
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS wrong FROM events
""")
def clustering_check(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rows of the written files that stand in the wrong order."""
    events = read(spark, d, "events").select("user_id", "ts", "event_id")
    folder, cluster = new_folder(spark, "clustered"), [("ts", "desc"), "event_id"]
    layout.write_layout(events, folder, ["user_id"], cluster)
    files = layout.out_of_order(spark, folder, events.schema, ["user_id"], cluster)
    return files.agg(F.sum("n_rows").alias("n_rows"), F.sum("wrong").alias("wrong"))


@query("clustering_order_appended", """
    SELECT o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position
    FROM orders
""")
def clustering_order_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same places after three appends: one of later orders, one that mixes with the others."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    folder, cluster = new_folder(spark, "appended"), [("o_orderdate", "desc"), "o_orderkey"]
    mixed = (F.col("o_custkey") % 5 == 0) & (F.col("o_orderkey") % 2 == 0)
    later = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    for part in (~mixed & ~later, ~mixed & later, mixed):
        layout.append_layout(orders.where(part), folder, ["o_custkey"], cluster)
    out = layout.read_positions(spark, folder, orders.schema, ["o_custkey"], "position", cluster)
    return out.select("o_custkey", "o_orderkey", "position")


@query("clustering_check_appended", """
    WITH e AS (SELECT user_id, event_id, [-epoch_us(ts), event_id] AS place,
                      ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS late FROM events),
         r AS (SELECT 'later' AS kind, user_id, late AS part, min(place) AS lo, max(place) AS hi
               FROM e GROUP BY ALL
               UNION ALL SELECT 'mixed', user_id, event_id % 2 = 0, min(place), max(place)
               FROM e GROUP BY ALL)
    SELECT a.kind, (SELECT count(*) FROM events) AS n_rows, count(b.lo) > 0 AS contradicted
    FROM r a LEFT JOIN r b ON a.kind = b.kind AND a.user_id = b.user_id AND a.part <> b.part
         AND a.lo <= b.hi AND b.lo <= a.hi
    GROUP BY a.kind
""")
def clustering_check_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two appends that follow each other in every user, and two that contradict each other."""
    events = read(spark, d, "events").select("user_id", "ts", "event_id")
    cluster = [("ts", "desc"), "event_id"]
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("m")).first()["m"]
    parts = []
    for kind, second in (("later", F.col("ts") >= F.lit(middle)), ("mixed", F.col("event_id") % 2 == 0)):
        folder = new_folder(spark, "appended")
        for some in (events.where(~second), events.where(second)):
            layout.append_layout(some, folder, ["user_id"], cluster)
        files = layout.out_of_order(spark, folder, events.schema, ["user_id"], cluster)
        parts.append(files.agg(F.sum("n_rows").alias("n_rows"), (F.sum("wrong") > 0).alias("contradicted"))
                     .select(F.lit(kind).alias("kind"), "n_rows", "contradicted"))
    return _union(parts)


# --- constraints ---------------------------------------------------------------------

def _checks(df: DataFrame, entity: str, rules: list[tuple[str, str, C.Predicate]]) -> DataFrame:
    row_rules = [R.Check(entity, path, text, test) for path, text, test in rules]
    return R.check_rows(df, entity, row_rules).select("rule", "n_rows", "violations")


def _check_sql(table: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE NOT coalesce({cond}, true)) AS violations FROM {table}"
        for name, cond in rules
    )


LABELLED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their label as an object, null where there is none."""
    return st.nest_one(
        read(spark, d, "documents"), read(spark, d, "labels"), {"doc_id": "doc_id"}, "label",
        ["quality", "toxic"], drop_keys=False,
    )


@query("check_cmp", _check_sql("lineitem", [
    ("check(l_quantity > 1)", "l_quantity > 1"),
    ("check(l_quantity <= 45)", "l_quantity <= 45"),
    ("check(l_discount < 0.1)", "l_discount < 0.1"),
    ("check(l_tax >= 0.01)", "l_tax >= 0.01"),
    ("check(l_returnflag == R)", "l_returnflag = 'R'"),
    ("check(l_linestatus != O)", "l_linestatus <> 'O'"),
]))
def check_cmp(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "lineitem"), "lineitem", [
        ("l_quantity", "> 1", C.compare(">", 1)),
        ("l_quantity", "<= 45", C.compare("<=", 45)),
        ("l_discount", "< 0.1", C.compare("<", 0.1)),
        ("l_tax", ">= 0.01", C.compare(">=", 0.01)),
        ("l_returnflag", "== R", C.compare("==", "R")),
        ("l_linestatus", "!= O", C.compare("!=", "O")),
    ])


@query("check_in", _check_sql("customer", [
    ("check(c_mktsegment IN)", "c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"),
    ("check(c_nationkey IN)", "c_nationkey IN (1, 2, 3, 5, 8, 13, 21)"),
]))
def check_in(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "customer"), "customer", [
        ("c_mktsegment", "IN", C.one_of(["BUILDING", "MACHINERY", "HOUSEHOLD"])),
        ("c_nationkey", "IN", C.one_of([1, 2, 3, 5, 8, 13, 21])),
    ])


@query("check_between", _check_sql("part", [
    ("check(p_size BETWEEN 5 AND 40)", "p_size BETWEEN 5 AND 40"),
    ("check(p_retailprice BETWEEN 910 AND 1000)", "p_retailprice BETWEEN 910 AND 1000"),
]))
def check_between(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "part"), "part", [
        ("p_size", "BETWEEN 5 AND 40", C.between(5, 40)),
        ("p_retailprice", "BETWEEN 910 AND 1000", C.between(910, 1000)),
    ])


@query("check_matches", _check_sql("pages", [
    ("check(url MATCHES ^https://)", "regexp_matches(url, '^https://')"),
    ("check(url MATCHES /(en|fr)/[0-9]+)", "regexp_matches(url, '/(en|fr)/[0-9]+')"),
    ("check(html MATCHES <title>[^<]+</title>)", "regexp_matches(html, '<title>[^<]+</title>')"),
]))
def check_matches(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "pages"), "pages", [
        ("url", "MATCHES ^https://", C.matches("^https://")),
        ("url", "MATCHES /(en|fr)/[0-9]+", C.matches("/(en|fr)/[0-9]+")),
        ("html", "MATCHES <title>[^<]+</title>", C.matches("<title>[^<]+</title>")),
    ])


@query("check_is_null", _check_sql(LABELLED, [
    ("check(label.quality IS NULL)", "quality IS NULL"),
    ("check(label.toxic IS NOT NULL)", "toxic IS NOT NULL"),
]))
def check_is_null(spark: SparkSession, d: str) -> DataFrame:
    return _checks(labelled(spark, d), "documents", [
        ("label.quality", "IS NULL", C.is_null()),
        ("label.toxic", "IS NOT NULL", C.not_null()),
    ])


@query("check_boolean", _check_sql(LABELLED, [
    ("check(n_chars long or short)", "(n_chars > 2000 OR n_chars < 100) AND n_chars <> 50"),
    ("check(label.quality not 1)", "NOT (quality = 1)"),
    ("check(lang not two)", "NOT (lang = 'en' OR lang = 'fr')"),
]))
def check_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A condition on a missing value is unknown, and passes."""
    outside = C.any_of(C.compare(">", 2000), C.compare("<", 100))
    return _checks(labelled(spark, d), "documents", [
        ("n_chars", "long or short", C.all_of(outside, C.compare("!=", 50))),
        ("label.quality", "not 1", C.negate(C.compare("==", 1))),
        ("lang", "not two", C.negate(C.any_of(C.compare("==", "en"), C.compare("==", "fr")))),
    ])


@query("check_raw", _check_sql("events", [
    ("check(value RAW)", "value * 10 > user_id"),
    ("check(event_type RAW)", "event_type <> 'error' OR value < 50"),
]))
def check_raw(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "events"), "events", [
        ("value", "RAW", C.raw("value * 10 > user_id")),
        ("event_type", "RAW", C.raw("event_type <> 'error' OR value < 50")),
    ])


@query("check_length", _check_sql("documents", [
    ("check(text max 4000)", "length(text) <= 4000"),
    ("check(source max 4)", "length(source) <= 4"),
    ("check(n_chars decimal(3,0))", "abs(n_chars) <= 999"),
]))
def check_length(spark: SparkSession, d: str) -> DataFrame:
    return _checks(read(spark, d, "documents"), "documents", [
        ("text", "max 4000", C.max_length(4000)),
        ("source", "max 4", C.max_length(4)),
        ("n_chars", "decimal(3,0)", C.fits_decimal(3, 0)),
    ])


@query("check_in_array", """
    SELECT 'check(details.l_quantity < 50)' AS rule, count(*) AS n_rows,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem
               WHERE l_orderkey = o_orderkey AND l_quantity >= 50)) AS violations FROM orders
    UNION ALL
    SELECT 'check(details.product.category.p_brand not first)', count(*),
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
               WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#1')) FROM orders
    UNION ALL
    SELECT 'embedded(details 1..n)', count(*),
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
    FROM orders
""")
def check_in_array(spark: SparkSession, d: str) -> DataFrame:
    """Inside arrays every element must meet the rule; an order counts once whatever its parts."""
    rules = [
        R.Check("orders", "details.l_quantity", "< 50", C.compare("<", 50)),
        R.Check("orders", "details.product.category.p_brand", "not first",
                C.compare("!=", "Brand#1")),
        R.Embedded("orders", "details", "1..n"),
    ]
    df = deep_orders(spark, d)
    flags = [R.row_violation(df, r).alias(f"v{i}") for i, r in enumerate(rules)]
    per_order = df.select("o_orderkey", *flags).groupBy("o_orderkey").agg(
        # A rule on elements breaks if any part breaks it; an empty array only if all are empty.
        F.bool_or("v0").alias("v0"), F.bool_or("v1").alias("v1"), F.bool_and("v2").alias("v2")
    )
    rows = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col("n_rows"), F.col(f"n{i}").alias("violations"))
        for i, r in enumerate(rules)
    ])
    return per_order.agg(
        F.count("*").alias("n_rows"), *[F.count_if(f"v{i}").alias(f"n{i}") for i in range(3)]
    ).select(F.inline(rows))


@query("check_existence", """
    SELECT 'existence(label)' AS rule, count(*) AS n_rows,
           count(*) FILTER (WHERE l.doc_id IS NULL) AS violations
    FROM documents LEFT JOIN labels l USING (doc_id)
    UNION ALL
    SELECT 'existence(label.quality)', count(*), count(*) FILTER (WHERE quality IS NULL)
    FROM documents LEFT JOIN labels l USING (doc_id)
    UNION ALL
    SELECT 'existence(text)', count(*), count(*) FILTER (WHERE text IS NULL) FROM documents
""")
def check_existence(spark: SparkSession, d: str) -> DataFrame:
    ds = Dataset({"documents": labelled(spark, d)})
    for path in ("label", "label.quality", "text"):
        ds = ds.add_existence(f"documents.{path}")
    return ds.check().select("rule", "n_rows", "violations")


QUARANTINE = [
    R.Check("lineitem", "l_quantity", "few", C.compare("<=", 48)),
    R.Check("lineitem", "l_discount", "small", C.compare("<", 0.1)),
    R.Check("lineitem", "l_returnflag", "known", C.one_of(["A", "N", "R"])),
]


@query("quarantine", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           concat_ws(',', CASE WHEN l_quantity > 48 THEN 'check(l_quantity few)' END,
                          CASE WHEN l_discount >= 0.1 THEN 'check(l_discount small)' END,
                          CASE WHEN l_returnflag NOT IN ('A', 'N', 'R')
                               THEN 'check(l_returnflag known)' END) AS broken
    FROM lineitem
    WHERE l_quantity > 48 OR l_discount >= 0.1 OR l_returnflag NOT IN ('A', 'N', 'R')
""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    _, bad = R.quarantine(read(spark, d, "lineitem"), QUARANTINE)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.array_join("_broken", ",").alias("broken"))


@query("quarantine_good", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_quantity <= 48 AND l_discount < 0.1 AND l_returnflag IN ('A', 'N', 'R')
""")
def quarantine_good(spark: SparkSession, d: str) -> DataFrame:
    good, _ = R.quarantine(read(spark, d, "lineitem"), QUARANTINE)
    return good.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- profiling -----------------------------------------------------------------------

@query("profile_nullability", """
    WITH x AS (SELECT d.*, l.doc_id AS lid, quality, toxic
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
         t AS (SELECT count(*) AS n, count(*) - count(doc_id) AS a, count(*) - count(text) AS b,
                      count(*) - count(lang) AS c, count(*) - count(source) AS e,
                      count(*) - count(n_chars) AS f, count(*) - count(lid) AS g,
                      count(*) - count(quality) AS h, count(*) - count(toxic) AS i FROM x)
    SELECT 'documents' AS entity, p.path, n AS n_values, p.nulls, p.nulls > 0 AS optional
    FROM t, LATERAL (VALUES ('doc_id', a), ('text', b), ('lang', c), ('source', e), ('n_chars', f),
                            ('label', g), ('label.quality', h), ('label.toxic', i)) p(path, nulls)
""")
def profile_nullability(spark: SparkSession, d: str) -> DataFrame:
    return pf.nullability(labelled(spark, d), "documents")


KEY_SEARCH = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "conversations": ["conv_id", "turn", "role"],
    "part": ["p_partkey", "p_name", "p_brand"],
}


def _keys_sql(max_size: int) -> str:
    rows, tables = [], []
    for table, cols in KEY_SEARCH.items():
        sets = [s for k in range(1, max_size + 1) for s in combinations(cols, k)]
        for s in sets:
            smaller = [t for t in sets if set(t) < set(s)]
            tests = [_is_key(table, s)] + [f"NOT {_is_key(table, t)}" for t in smaller]
            rows.append(
                f"SELECT '{table}' AS entity, '{','.join(s)}' AS key, {len(s)} AS size, "
                f"(SELECT count(*) FROM {table}) AS n_rows WHERE " + " AND ".join(tests)
            )
        tables.append(table)
    return " UNION ALL ".join(rows)


def _is_key(table: str, cols: tuple[str, ...]) -> str:
    names = ", ".join(cols)
    return (f"(NOT EXISTS (SELECT 1 FROM {table} GROUP BY {names} HAVING count(*) > 1"
            f" OR {' OR '.join(f'{c} IS NULL' for c in cols)}))")


@query("discover_keys", _keys_sql(4))
def discover_keys(spark: SparkSession, d: str) -> DataFrame:
    return _union([
        discovery.discover_keys(read(spark, d, t), t, cols, max_size=4) for t, cols in KEY_SEARCH.items()
    ])


REFERENCE_SEARCH = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
    "events": ["user_id"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
}


def _references_sql() -> str:
    cols = [(t, c) for t, cs in REFERENCE_SEARCH.items() for c in cs]
    return " UNION ALL ".join(
        f"SELECT '{a}.{x}' AS child, '{b}.{y}' AS parent, "
        f"(SELECT count(DISTINCT {x}) FROM {a}) AS n_values "
        f"WHERE NOT EXISTS (SELECT {x} FROM {a} WHERE {x} IS NOT NULL EXCEPT SELECT {y} FROM {b})"
        for (a, x), (b, y) in permutations(cols, 2)
    )


@query("discover_references", _references_sql())
def discover_references(spark: SparkSession, d: str) -> DataFrame:
    frames = {t: read(spark, d, t) for t in REFERENCE_SEARCH}
    return discovery.discover_references(frames, REFERENCE_SEARCH)


FIRST_ROWS = 2000


def _all_keys_sql(tables: dict[str, list[str]]) -> str:
    """Every set of columns of every table, as a mask; then the sets without a smaller key inside.

    Sets with copies among the first rows are left out before all rows are compared.
    """
    parts, unique = [], []
    for table, cols in tables.items():
        value = ", ".join(f"CASE WHEN mask & {1 << i} > 0 THEN {c} END" for i, c in enumerate(cols))
        filled = " AND ".join(f"(mask & {1 << i} = 0 OR {c} IS NOT NULL)" for i, c in enumerate(cols))
        names = ", ".join(f"CASE WHEN mask & {1 << i} > 0 THEN '{c}' END" for i, c in enumerate(cols))

        def good(rows: str, masks: str) -> str:
            return (f"(SELECT mask FROM {rows}, {masks} GROUP BY mask "
                    f"HAVING count(DISTINCT hash({value})) = count(*) AND bool_and({filled}))")

        parts += [
            f"{table}_some AS MATERIALIZED (SELECT * FROM {table} LIMIT {FIRST_ROWS})",
            f"{table}_open AS MATERIALIZED "
            + good(f"{table}_some", f"(SELECT unnest(range(1, {1 << len(cols)})) AS mask)"),
            f"{table}_good AS MATERIALIZED " + good(table, f"{table}_open"),
        ]
        unique.append(
            f"SELECT '{table}' AS entity, concat_ws(',', {names}) AS key, CAST(bit_count(mask) AS INTEGER) AS size, "
            f"(SELECT count(*) FROM {table}) AS n_rows FROM {table}_good u WHERE NOT EXISTS ("
            f"SELECT 1 FROM {table}_good v WHERE v.mask <> u.mask AND v.mask & u.mask = v.mask)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(unique)


ALL_COLUMNS = {t: [c.split()[0] for c in names.split(", ")] for t, names in SCHEMAS.items()}


@query("discover_all_keys", _all_keys_sql(ALL_COLUMNS))
def discover_all_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every minimal key of every table, over all its columns and of any size."""
    return _union([discovery.discover_keys(read(spark, d, t), t) for t in ALL_COLUMNS])


def reference_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Who supplies what (keyed by both), what was ordered of it, a list whose pairs do not match
    although each of their columns does, and staff that report to each other."""
    lines = read(spark, d, "lineitem")
    supplied = lines.select("l_partkey", "l_suppkey").distinct().withColumnsRenamed(
        {"l_partkey": "part", "l_suppkey": "supplier"})
    other = read(spark, d, "supplier").agg(F.max("s_suppkey").alias("n")).first()["n"]
    return {
        "supplied": supplied,
        "ordered": lines.select("l_suppkey", "l_partkey", "l_linenumber").withColumnsRenamed(
            {"l_suppkey": "by_supplier", "l_partkey": "of_part", "l_linenumber": "line"}),
        "mixed": lines.select(F.col("l_partkey").alias("a_part"),
                              (F.col("l_suppkey") % other + 1).alias("a_supplier")),
        "staff": read(spark, d, "customer").select(
            F.col("c_custkey").alias("employee"),
            F.nullif((F.col("c_custkey") / 7).cast("bigint"), F.lit(0)).alias("reports_to")),
    }


_FRAMES_SQL = """WITH supplied AS MATERIALIZED (
    SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem),
ordered AS MATERIALIZED (
    SELECT l_suppkey AS by_supplier, l_partkey AS of_part, l_linenumber AS line FROM lineitem),
mixed AS MATERIALIZED (SELECT l_partkey AS a_part,
    l_suppkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS a_supplier FROM lineitem),
staff AS MATERIALIZED (
    SELECT c_custkey AS employee, nullif(c_custkey // 7, 0) AS reports_to FROM customer)
"""
FRAME_COLUMNS = {"supplied": ["part", "supplier"], "ordered": ["by_supplier", "of_part", "line"],
                 "mixed": ["a_part", "a_supplier"], "staff": ["employee", "reports_to"]}


def _tuple_references(least: int) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """Every way that columns of one frame, in order, may correspond to columns of another."""
    return [
        (a, xs, b, ys)
        for a, cols in FRAME_COLUMNS.items() for k in range(least, len(cols) + 1)
        for xs in combinations(cols, k)
        for b, others in FRAME_COLUMNS.items() for ys in permutations(others, k)
        if a != b or all(x != y for x, y in zip(xs, ys))]


def _holds_sql(a: str, xs: tuple[str, ...], b: str, ys: tuple[str, ...]) -> str:
    """All tuples of the one occur in the other; where nulls leave tuples out, each column does."""
    if len(xs) > 1 and a == "staff":
        parts = [_holds_sql(a, (x,), b, (y,)) for x, y in zip(xs, ys)]
        return " AND ".join([*parts, _tuples_sql(a, xs, b, ys)])
    return _tuples_sql(a, xs, b, ys)


def _tuples_sql(a: str, xs: tuple[str, ...], b: str, ys: tuple[str, ...]) -> str:
    filled = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    return (f"EXISTS (SELECT 1 FROM {a} WHERE {filled}) AND NOT EXISTS ("
            f"SELECT {', '.join(xs)} FROM {a} WHERE {filled} EXCEPT SELECT {', '.join(ys)} FROM {b})")


def _tuple_references_sql() -> str:
    return _FRAMES_SQL + " UNION ALL ".join(
        f"SELECT '{a}.{','.join(xs)}' AS child, '{b}.{','.join(ys)}' AS parent, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(xs)} FROM {a} "
        f"WHERE {' AND '.join(f'{x} IS NOT NULL' for x in xs)})) AS n_values "
        f"WHERE {_holds_sql(a, xs, b, ys)}"
        for a, xs, b, ys in _tuple_references(2))


@query("discover_composite_references", _tuple_references_sql())
def discover_composite_references(spark: SparkSession, d: str) -> DataFrame:
    return discovery.discover_composite_references(reference_frames(spark, d))


def _composite_contract_sql() -> str:
    sets, refs = [], []
    for t, cols in FRAME_COLUMNS.items():
        for k in range(1, len(cols) + 1):
            for s in combinations(cols, k):
                smaller = [c for j in range(1, k) for c in combinations(s, j)]
                good = " AND ".join([_is_key(t, s), *[f"NOT {_is_key(t, c)}" for c in smaller]])
                place = [k, *[cols.index(c) for c in s]]
                sets.append(f"SELECT '{t}' AS entity, '{','.join(s)}' AS key, {place} AS place WHERE {good}")
    for a, xs, b, ys in _tuple_references(1):
        # A key is named in its frame's order; a reference in the child's.
        key = ",".join(c for c in FRAME_COLUMNS[b] if c in ys)
        refs.append(
            f"SELECT '{a}', 'reference({','.join(xs)})->{b}({','.join(ys)})' WHERE EXISTS ("
            f"SELECT 1 FROM keys WHERE entity = '{b}' AND key = '{key}') AND {_holds_sql(a, xs, b, ys)}")
    return (
        f"{_FRAMES_SQL}, keys AS MATERIALIZED ({' UNION ALL '.join(sets)}) "
        "SELECT entity, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY place) = 1 "
        "THEN 'primary(' ELSE 'unique(' END || key || ')' AS rule FROM keys UNION ALL "
        + " UNION ALL ".join(refs))


@query("proposed_composite_contract", _composite_contract_sql())
def proposed_composite_contract(spark: SparkSession, d: str) -> DataFrame:
    """Keys of any size, references to composite keys and of an entity to itself, from the data."""
    rules = discovery.proposed_contract(reference_frames(spark, d), max_size=None, self_references=True)
    return spark.createDataFrame(
        [(r.entity, r.name) for r in rules.rules], "entity string, rule string")


@query("nested_paths", """
    WITH s AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders
               LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
         p AS (SELECT o_orderkey, count(p_partkey) AS n FROM orders
               LEFT JOIN lineitem ON o_orderkey = l_orderkey
               LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT 'orders' AS entity, 'details' AS path, 'array' AS kind, count(*) AS n, min(n) AS fewest,
           max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM s
    UNION ALL
    SELECT 'orders', 'details.product', 'object', CAST(sum(n) AS BIGINT), min(n), max(n),
           CAST(sum(n) AS BIGINT) FROM p
    UNION ALL
    SELECT 'orders', 'details.product.category', 'object', CAST(sum(n) AS BIGINT), min(n), max(n),
           CAST(sum(n) AS BIGINT) FROM p
""")
def nested_paths(spark: SparkSession, d: str) -> DataFrame:
    return pf.nested_paths(deep_orders(spark, d), "orders", key=["o_orderkey"])


@query("conform_types", """
    SELECT 'l_quantity' AS column_name, 'double' AS old_type, 'int' AS new_type,
           count(*) FILTER (WHERE l_quantity <> trunc(l_quantity)) AS lost FROM lineitem
    UNION ALL
    SELECT 'l_extendedprice', 'double', 'int',
           count(*) FILTER (WHERE l_extendedprice <> trunc(l_extendedprice)) FROM lineitem
    UNION ALL
    SELECT 'l_discount', 'double', 'decimal(13,2)', 0
    UNION ALL
    SELECT 'l_shipdate', 'timestamp_ntz', 'date',
           count(*) FILTER (WHERE l_shipdate <> date_trunc('day', l_shipdate)) FROM lineitem
    UNION ALL
    SELECT 'embedding', 'array<float>', 'string', 0
    UNION ALL
    SELECT 'embedding', 'array<float>', 'array<double>', 0
""")
def conform_types(spark: SparkSession, d: str) -> DataFrame:
    """What a relational table and a document can hold of these columns, and what is lost."""
    lines = read(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    vectors = read(spark, d, "embeddings")
    return _union([
        conform_losses(lines, "relational", {
            "l_quantity": "Integer", "l_extendedprice": "Integer", "l_discount": "Decimal",
            "l_shipdate": "Date"}),
        conform_losses(vectors, "relational"),
        conform_losses(vectors, "document"),
    ])
