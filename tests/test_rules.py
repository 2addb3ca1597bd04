"""Rules measured on rows that break them, layout, comparison."""

import pytest
from pyspark.sql import functions as F

from modelshift.dataset import Dataset
from modelshift.functions import checks as C
from modelshift.functions.keys import natural_key
from modelshift.functions.types import conform, conform_losses, spark_type
from modelshift.operators import compare as cmp
from modelshift.operators import discovery, layout
from modelshift.operators import properties as pr
from modelshift.operators import rules as R
from modelshift.operators.grouping import DuplicateKey
from modelshift.operators.rules import (
    Check, Contract, Embedded, Existence, Key, Reference, check_contract, row_violation)
from modelshift.session import new_folder
from modelshift.sources import models


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def bad(spark):
    return spark.createDataFrame(
        [(1, 1, "a"), (1, 1, "b"), (2, None, "c"), (3, 9, None), (None, 2, "dd")],
        "id int, ref int, t string")


def test_check_key(bad):
    assert one(R.check_key(bad, ["id"])) == {
        "n_rows": 5, "n_keys": 3, "duplicate_groups": 1, "duplicate_rows": 2, "null_rows": 1}


def test_check_reference_ignores_nulls(spark, bad):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert one(R.check_reference(bad, ["ref"], parent, ["k"])) == {
        "n_rows": 5, "null_rows": 1, "orphan_keys": 1, "orphan_rows": 1}
    assert [r.ref for r in R.orphans(bad, ["ref"], parent, ["k"]).collect()] == [9]


def test_reference_needs_as_many_columns():
    with pytest.raises(ValueError):
        R.Reference("a", ("x", "y"), "b", ("k",))


def test_observe_cardinality(spark, bad):
    parent = spark.createDataFrame([(1,), (2,), (7,)], "k int")
    got = one(R.observe_cardinality(bad, ["ref"], parent, ["k"]))
    assert (got["target_end"], got["source_end"]) == ("0..1", "0..n")
    assert (got["source_min"], got["source_max"]) == (0, 2)


def test_check_passes_on_null(spark, bad):
    rules = [R.Check("e", "t", "short", C.max_length(1)),
             R.Check("e", "ref", "not one", C.negate(C.compare("==", 1))),
             R.Existence("e", "t")]
    got = {r.rule: r.violations for r in R.check_rows(bad, "e", rules).collect()}
    assert got == {"check(t short)": 1, "check(ref not one)": 2, "existence(t)": 1}


def test_checks_inside_arrays(spark):
    df = spark.createDataFrame(
        [([(1,), (5,)],), ([],), (None,), ([(None,)],)], "a array<struct<v int>>")
    rules = [R.Check("e", "a.v", "< 5", C.compare("<", 5)), R.Existence("e", "a.v"),
             R.Embedded("e", "a", "1..n")]
    got = [r.violations for r in R.check_rows(df, "e", rules).collect()]
    assert got == [1, 1, 2]


def test_quarantine_splits_without_loss(bad):
    rules = [R.Existence("e", "ref"), R.Check("e", "t", "one letter", C.matches("^.$"))]
    good, broken = R.quarantine(bad, rules)
    assert good.count() + broken.count() == bad.count()
    assert {r.id: r._broken for r in broken.collect()} == {
        2: ["existence(ref)"], None: ["check(t one letter)"]}


def test_contract_check_counts_required_reference_nulls(spark, bad):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    contract = R.Contract((
        R.Key("e", ("id",)), R.Key("e", ("id",), "unique"),
        R.Reference("e", ("ref",), "p", ("k",)),
        R.Reference("e", ("id",), "p", ("k",), "0..1", enforced=False)))
    got = {r.rule: (r.severity, r.violations)
           for r in R.check_contract({"e": bad, "p": parent}, contract).collect()}
    assert got["primary(id)"] == ("error", 2)
    assert got["unique(id)"] == ("error", 1)
    assert got["reference(ref)->p(k)"] == ("error", 2)
    assert got["reference(id)->p(k)"] == ("warning", 1)


def test_natural_key_tells_rows_apart(spark):
    df = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("N", None)], "x string, y string")
    keys = df.select(natural_key(F.col("x"), F.col("y")).alias("k"))
    assert keys.distinct().count() == 5


def test_layout_positions_with_hot_partition(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11).cast("int").alias("p"),
        (F.col("id") * 7919 % 5000).cast("int").alias("c"))
    out = layout.positions(df, new_folder(spark, "t"), ["p"], [("c", "desc")])
    by_key = {}
    for r in out.collect():
        by_key.setdefault(r.p, []).append((r.position, r.c))
    for rows in by_key.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [c for _, c in rows] == sorted((c for _, c in rows), reverse=True)


def test_out_of_order_finds_disorder(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 5)], "p int, c int").coalesce(1)
    folder = new_folder(spark, "t")
    df.write.parquet(folder)
    assert layout.out_of_order(spark, folder, df.schema, ["p"], ["c"]).first().wrong == 1


def test_hot_keys_are_exact_among_many(spark):
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id) END AS k", "id % 2 AS j")
    got = {(r.k, r.j): r.n_rows for r in layout.hot_keys(df, ["k", "j"], 0.005).collect()}
    want = {(r.k, r.j): r["count"] for r in df.groupBy("k", "j").count().where("count >= 150").collect()}
    assert got == want and ("hot", 0) in got
    assert layout.hot_keys(df.limit(0), ["k"], 0.5).count() == 0


def test_appends_keep_places_and_show_contradictions(spark):
    cluster = [("c", "desc")]
    folder, mixed = new_folder(spark, "t"), new_folder(spark, "t")
    schema = "p int, c int"

    def appended(to, *parts):
        for rows in parts:
            layout.append_layout(spark.createDataFrame(rows, schema), to, ["p"], cluster)
        read = layout.read_positions(spark, to, spark.createDataFrame([], schema).schema, ["p"], "at", cluster)
        wrong = layout.out_of_order(spark, to, read.drop("at").schema, ["p"], cluster)
        return sorted((r.p, -r.c if r.c is not None else 99, r["at"]) for r in read.collect()), sum(
            r.wrong for r in wrong.collect())

    # Task numbers repeat over appends, and the second append comes first in the order.
    rows, wrong = appended(folder, [(1, 3), (1, 2), (2, 9)], [(1, 5), (1, 4), (3, 1)], [(1, 1), (1, None)])
    assert [at for p, _, at in rows if p == 1] == [1, 2, 3, 4, 5, 6] and wrong == 0
    rows, wrong = appended(mixed, [(1, 5), (1, 1), (2, 4)], [(1, 3), (1, 2), (2, 3)])
    assert [at for p, _, at in rows if p == 1] == [1, 2, 3, 4] and wrong == 1
    assert [at for p, _, at in rows if p == 2] == [1, 2]


def test_cast_keeps_going_and_counts_losses(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert [r.a for r in pr.cast_property(df, "a", "Integer").collect()] == [1, None, None]
    assert one(pr.cast_losses(df, {"a": "Integer"})) == {
        "path": "a", "new_type": "int", "n_values": 2, "lost": 1}


def test_type_names(spark):
    assert spark_type("DateTime").simpleString() == "timestamp_ntz"
    assert spark_type("whatever").simpleString() == "string"
    assert spark_type("Decimal").simpleString() == "decimal(13,2)"


def test_conform(spark):
    df = spark.createDataFrame(
        [([1, 2], {"b": 1, "a": 2}, 1.5)], "l array<int>, m map<string,int>, f float")
    flat = conform(df, "relational").first()
    assert flat.l == "[1,2]" and '"a"' in flat.m
    assert conform(df, "document").schema["f"].dataType.simpleString() == "double"
    assert {r.column_name: r.lost for r in conform_losses(df, "relational").collect()} == {
        "l": 0, "m": 0}


def test_dataset_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "x", 2), (3, "z", None)], "k int, t string, n int")
    got = {r.item: (r.missing, r.extra, r.changed) for r in cmp.dataset_diff(a, b, ["k"]).collect()}
    assert got == {"rows": (1, 1, 0), "t": (0, 0, 0), "n": (0, 0, 1)}
    with pytest.raises(DuplicateKey):
        cmp.dataset_diff(a.unionByName(a), b, ["k"])


def test_fingerprint_sees_value_moving_to_null_column(spark):
    a = spark.createDataFrame([(1, None)], "x int, y int")
    b = spark.createDataFrame([(None, 1)], "x int, y int")
    assert not cmp.same_rows(a, b).first().equal
    assert cmp.same_rows(a, a.select("y", "x")).first().equal


def test_fingerprint_with_maps(spark):
    a = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>")
    b = spark.createDataFrame([({"b": 2, "a": 1},)], "m map<string,int>")
    assert cmp.same_rows(a, b).first().equal


def test_reconcile_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, t string")
    got = one(cmp.reconcile("e", a, a.distinct(), ["k"]))
    assert got["rows_changed"] == 1 and got["verdict"] == "rows changed"
    assert one(cmp.reconcile("e", a, a, ["k"]))["verdict"] == "ok"


def test_reconcile_compares_numbers_exactly(spark):
    big = spark.createDataFrame([(1, 9007199254740993)], "k int, n bigint")
    def against(value, kind):
        other = big.select("k", F.lit(value).cast(kind).alias("n"))
        return {one(cmp.reconcile("e", *x, ["k"]))["verdict"] for x in ((big, other), (other, big))}
    assert against("9007199254740992", "decimal(20,0)") == {"rows changed"}
    assert against("9007199254740993", "decimal(20,0)") == against("9007199254740993", "decimal(25,3)") == {"ok"}
    assert against("9007199254740993", "decimal(38,19)") == {"ok"}
    assert against("9007199254740993.5", "decimal(38,19)") == {"rows changed"}
    small = big.select("k", F.lit(5).alias("n"))
    for kind in ("decimal(10,2)", "double", "smallint", "decimal(38,37)"):
        other = small.select("k", F.col("n").cast(kind).alias("n"))
        assert one(cmp.reconcile("e", small, other, ["k"]))["verdict"] == "ok"
    keys = spark.createDataFrame([(9007199254740993, 1)], "k bigint, v int")
    other = keys.select((F.col("k") - 1).cast("decimal(20,0)").alias("k"), "v")
    assert one(cmp.reconcile("e", keys, other, ["k"]))["verdict"] == "rows lost"


def test_discovery(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, None)], "x int, y int, t string")
    got = {r.key for r in discovery.discover_keys(df, "e").collect()}
    assert got == {"x,y"}
    refs = discovery.discover_references({"e": df, "f": df.where("x = 1")}, {"e": ["x"], "f": ["x", "y"]})
    assert {(r.child, r.parent) for r in refs.collect()} == {
        ("f.x", "e.x"), ("f.x", "f.y"), ("f.y", "e.x"), ("e.x", "f.y")}


def test_documents_round_trip(spark):
    df = spark.createDataFrame(
        [(1, [("a", 1.5)], None), (2, [], (3,))], "k int, l array<struct<n string, v double>>, o struct<z int>")
    folder = new_folder(spark, "json")
    models.write_documents(df, folder, "k")
    schema = df.withColumnRenamed("k", "_id").schema
    back = models.read_documents(spark, folder, schema)
    assert cmp.same_rows(back, df.withColumnRenamed("k", "_id")).first().equal


def test_graph_round_trip(spark):
    v = spark.createDataFrame([(1, ["p"], "a")], "id int, _labels array<string>, n string")
    e = spark.createDataFrame([(1, 1, 2.0)], "src int, dst int, w double")
    folder = new_folder(spark, "graph")
    models.write_vertices(v, folder, "p")
    models.write_edges(e, folder, "KNOWS")
    vs, es = models.read_graph(spark, folder, {"p": v.schema}, {"KNOWS": e.schema})
    assert vs["p"].first()._labels == ["p"] and es["KNOWS"].first().w == 2.0


def test_reference_from_inside_objects_and_arrays(spark):
    orders = spark.createDataFrame(
        [(1, (5,), [(1, "a"), (9, "b")]), (2, (6,), [(2, "c")]), (3, None, None)],
        "id int, who struct<boss int>, items array<struct<gid int, t string>>")
    goods = spark.createDataFrame([(1,), (2,)], "gid int")
    people = spark.createDataFrame([((5,),)], "p struct<id int>")
    assert one(R.check_reference(orders, ["items.gid"], goods, ["gid"])) == {
        "n_rows": 3, "null_rows": 0, "orphan_keys": 1, "orphan_rows": 1}
    assert one(R.check_reference(orders, ["who.boss"], people, ["p.id"])) == {
        "n_rows": 3, "null_rows": 1, "orphan_keys": 1, "orphan_rows": 1}
    assert one(R.check_key(orders, ["id", "items.gid"]))["n_keys"] == 3
    contract = R.Contract((R.Reference("o", ("who.boss",), "p", ("p.id",)),))
    assert contract.renamed_column("o", "who", "whom").rules[0].columns == ("whom.boss",)
    assert not contract.without_column("o", "who").rules


def test_bounds_are_measured(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    kids = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "kid int, pid int")
    ds = Dataset({"parents": parents, "kids": kids}, Contract((Key("parents", ("id",)),)))

    def broken(source):
        rule = Reference("kids", ("pid",), "parents", ("id",), "0..1", source)
        return check_contract(ds.frames, Contract((rule,))).first()["violations"]

    assert [broken(x) for x in ("0..n", "1..n", "0..1", "1..1")] == [0, 1, 1, 2]


def test_edge_cardinality_is_a_rule(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    things = spark.createDataFrame([(5,), (6,)], "tid int")
    owns = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "p int, t int")
    ds = Dataset({"people": people, "things": things, "owns": owns}, Contract(
        (Key("people", ("id",)), Key("things", ("tid",)))))
    out = ds.transform_to_relationship(
        "owns", ("people", ["p"]), ("things", ["t"]), cardinality="1..1")
    assert out["owns"].count() == 2
    assert [tuple(r) for r in out.rejected["owns"].collect()] == [(2, None)]

    def violations(d):
        return {r["rule"]: r["violations"] for r in d.check().where("entity = 'owns'").collect()}

    assert violations(out)["reference(src)->people(id)"] == 2  # one with two edges, one with none
    assert violations(out.recard("owns", ["src"], "0..n"))["reference(src)->people(id)"] == 0


def test_edges_take_the_cardinality_of_a_deleted_reference(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    orders = spark.createDataFrame([(5, 1), (6, 1)], "oid int, p int")
    rule = Reference("orders", ("p",), "people", ("id",), "1..1", "1..n")
    ds = Dataset({"people": people, "orders": orders}, Contract(
        (Key("people", ("id",)), Key("orders", ("oid",)), rule)))
    ds = ds.delete_reference("orders", ["p"]).add_edge(
        "BOUGHT", "people", "orders", holder="orders", reference=["p"])
    ends = {r.columns: r.source_cardinality for r in ds.contract.of("BOUGHT", Reference)}
    assert ends == {("src",): "1..n", ("dst",): "1..1"}


def test_checks_are_what_they_say(spark):
    df = spark.createDataFrame([(1,), (7,)], "v int")
    ds = Dataset({"t": df}).add_check("t.v", "small", C.compare("<", 5)).add_check(
        "t.v", "small", C.compare("<", 99))
    assert sorted(r["violations"] for r in ds.check().collect()) == [0, 1]
    assert len(ds.add_check("t.v", "small", C.compare("<", 5)).contract.rules) == 2
    one = Contract((Check("t", "v", "small", C.compare("<", 5)),))
    two = Contract((Check("t", "v", "small", C.compare("<", 99)),))
    sides = {r["side"] for r in cmp.contract_diff({"t": df}, one, {"t": df}, two).collect()}
    assert sides == {"actual", "expected"}
    assert str(C.all_of(C.between(1, 3), C.negate(C.is_null()))) == "(between 1 and 3 and not is null)"


def test_rules_follow_their_field(spark):
    df = spark.createDataFrame([(1, (7, "x"), [(1, "a")])],
                               "id int, o struct<n: int, s: string>, l array<struct<m: int, t: string>>")
    ds = Dataset({"e": df}, Contract((Key("e", ("id",)),)))
    ds = ds.add_check("e.o.n", "small", C.compare("<", 5)).add_existence("e.o.s")
    flat = ds.flatten("e.o")
    assert {getattr(r, "path", None) for r in flat.contract.of("e")} == {None, "o_n", "o_s"}
    assert flat.check().where("rule like 'check%'").first()["violations"] == 1
    out = ds.add_check("e.l.m", "small", C.compare("<", 1)).unnest("e.l", "items", carry={"id": "id"})
    assert [r.path for r in out.contract.of("items", Check)] == ["m"]
    assert out.check().where("entity = 'items' and rule like 'check%'").first()["violations"] == 1


def test_arrays_in_arrays_are_judged_per_element(spark):
    kind = "id int, d array<struct<t: array<struct<v: int>>>>"
    df = spark.createDataFrame([
        (1, [([(1,)],), ([(2,)],)]), (2, [([(1,)],), ([],)]), (3, []), (4, [([(None,)],)]), (5, None),
        (6, [(None,)]),
    ], kind)

    def broken(rule):
        return [r["id"] for r in df.where(row_violation(df, rule)).orderBy("id").collect()]

    assert broken(Embedded("e", "d.t", "1..n")) == [2, 6]
    assert broken(Existence("e", "d.t")) == [6]
    assert broken(Existence("e", "d.t.v")) == [4]
    assert broken(Embedded("e", "d", "1..n")) == [3, 5]


def test_wider_types_are_no_change(spark):
    a = spark.createDataFrame([(1, 7, 1.5), (2, 8, None)], "k int, n int, x float")
    b = a.selectExpr("cast(k as bigint) k", "cast(n as bigint) n", "cast(x as double) x")
    assert cmp.reconcile("t", a, b, ["k"]).first()["verdict"] == "ok"
    assert cmp.same_rows(a, b).first()["equal"]
    assert cmp.fingerprint(a).collect() == cmp.fingerprint(b).collect()
    c = b.withColumn("n", F.when(F.col("k") == 1, 99).otherwise(F.col("n")))
    assert cmp.reconcile("t", a, c, ["k"]).first()["rows_changed"] == 1
    d = a.withColumn("x", F.col("x").cast("decimal(9,2)"))
    assert cmp.reconcile("t", a, d, ["k"]).first()["verdict"] == "ok"


def test_type_names(spark):
    from modelshift.functions.types import spark_type

    names = {"smallint": "smallint", "tinyint": "tinyint", "short": "smallint", "timestamp_ltz": "timestamp",
             "array<int>": "array<int>", "Integer": "int", "no such type": "string", "nosuch": "string"}
    assert {n: spark_type(n).simpleString() for n in names} == names


def test_labels_are_a_set(spark):
    a = spark.createDataFrame([(1, ["x", "y"])], "id int, _labels array<string>")
    b = spark.createDataFrame([(1, ["y", "x"])], "id int, _labels array<string>")
    assert cmp.dataset_diff(a, b, ["id"]).where("changed > 0").count() == 0
